"""Target and frequency encoding as stages of an ML pipeline, and the lookup of values in a table of categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from launchlens.session import cut_lineage

UNKNOWN = "<UNK>"
#: Categories up to which a lookup table is sent to every executor; a row of it is a value and a few numbers.
BROADCAST_ROWS = 50_000


def category(column: str) -> Column:
    """The value as text, missing ones as a value of their own."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(UNKNOWN))


def category_rows(df: DataFrame, columns: Sequence[str], *keep: Column) -> DataFrame:
    """(keep..., column, value): one row per row and column."""
    structs = [F.struct(F.lit(c).alias("column"), category(c).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*structs)))


def lookup(df: DataFrame, columns: Sequence[str], table: DataFrame, payload: Sequence[str], n_rows: int) -> DataFrame:
    """Adds for every column <column>_<payload> from `table` (column, value, payload...), null where the value is not listed.

    `n_rows` is the counted size of the table. Up to BROADCAST_ROWS the table goes to every executor and no row
    moves. Beyond, each column is a join on the value, whose large categories Spark's skew join splits.
    """
    out = df
    for c in columns:
        mine = table.where(F.col("column") == c).select(F.col("value").alias("_value"), *[F.col(p).alias(f"{c}_{p}") for p in payload])
        out = out.join(F.broadcast(mine) if n_rows <= BROADCAST_ROWS else mine, category(c) == F.col("_value"), "left").drop("_value")
    return out


class _EncoderParams(HasInputCols, HasLabelCol):
    alpha = Param(Params._dummy(), "alpha", "rows that the overall mean weighs in a category's mean", typeConverter=TypeConverters.toFloat)


class TargetFreqEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Smoothed target mean (n * m + alpha * g) / (n + alpha) and frequency n / N per category, as <col>_te and <col>_fe."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, labelCol: str = "purchase", alpha: float = 10.0) -> None:
        super().__init__()
        self._setDefault(labelCol="purchase", alpha=10.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "TargetFreqModel":
        cols, label, alpha = list(self.getInputCols()), self.getLabelCol(), self.getOrDefault(self.alpha)
        y = F.col(f"`{label}`").cast("double")
        counts = cut_lineage(category_rows(df, cols, y.alias("_y")).groupBy("column", "value").agg(F.count("*").alias("n"), F.sum("_y").alias("s")))
        # every column's categories add up to all rows
        totals = counts.where(F.col("column") == cols[0]).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
        total = totals["n"] or 1
        mean = totals["s"] / total if totals["s"] is not None else 0.5
        mapping = counts.select(
            "column", "value",
            ((F.col("s") + alpha * mean) / (F.col("n") + alpha)).alias("te"),
            (F.col("n") / F.lit(float(total))).alias("fe"),
        )
        model = TargetFreqModel(mapping, float(mean), counts.count())
        return self._copyValues(model)


class TargetFreqModel(Model, _EncoderParams, MLReadable, MLWritable):
    """A fitted encoder: (column, value, te, fe) plus the overall mean. Unseen values get the overall mean and 0."""

    def __init__(self, mapping: DataFrame | None = None, global_mean: float = 0.5, n_values: int = 0) -> None:
        super().__init__()
        self._setDefault(labelCol="purchase", alpha=10.0)
        self.mapping, self.global_mean, self.n_values = mapping, global_mean, n_values

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = list(self.getInputCols())
        out = lookup(df, cols, self.mapping, ["te", "fe"], self.n_values)
        fills = {}
        for c in cols:
            fills |= {f"{c}_te": F.coalesce(F.col(f"`{c}_te`"), F.lit(self.global_mean)), f"{c}_fe": F.coalesce(F.col(f"`{c}_fe`"), F.lit(0.0))}
        return out.withColumns(fills)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    """Parameters and the overall mean as metadata, the mapping as Parquet beside them."""

    def __init__(self, model: TargetFreqModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"globalMean": m.global_mean, "values": m.n_values})
        m.mapping.write.parquet(f"{path}/mapping")


class _ModelReader(MLReader):
    def load(self, path: str) -> TargetFreqModel:
        spark: SparkSession = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = TargetFreqModel(spark.read.parquet(f"{path}/mapping"), meta["globalMean"], meta["values"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
