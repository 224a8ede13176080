"""Session helper for tests and benches, and the one place that cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests; on a cluster use the session the cluster gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("launchlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="launchlens-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not hasattr(spark.sparkContext, "_launchlens_folder"):
        spark.sparkContext._launchlens_folder = tempfile.mkdtemp(prefix="launchlens-")
    return spark.sparkContext._launchlens_folder


def cut_lineage(df: DataFrame, parts_a_file: int = 1) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs a re-read, not a recompute.

    With `parts_a_file` about so many shuffle partitions go to a file, one after the other, but four files a core are written at least.
    On a local file system without native code each file costs processes that the executor's JVM starts.
    """
    sc = df.sparkSession.sparkContext
    if parts_a_file > 1:
        df = df.coalesce(max(4 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts_a_file))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
