"""Scans and sinks: order fact, CSV, agent registry, business definition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from launchlens.plans.skew import last_row


def _as_timestamp(df: DataFrame, col: str) -> Column:
    """Any time-like column as timestamp, unreadable text as null."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.trim(F.col(col)))
    return F.col(col).cast("timestamp")


def scan_orders(
    spark: SparkSession, path: str, names: Mapping[str, str], ts_cols: Sequence[str] = ()
) -> DataFrame:
    """Parquet order fact with trimmed, canonical column names and timestamps coerced (bad -> null).

    Columns absent from the file are left out, since the input's schema has drifted.
    """
    raw = spark.read.parquet(path)
    trimmed = raw.select(*[F.col(f"`{c}`").alias(names.get(c.strip(), c.strip())) for c in raw.columns])
    return trimmed.withColumns({c: _as_timestamp(trimmed, c) for c in ts_cols if c in trimmed.columns})


# Encodings tried in order.
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030")
# Charsets Spark's CSV reader takes, and the one that keeps every byte.
SPARK_CHARSETS = ("utf-8", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32")
BYTES = "iso-8859-1"


def newest_file(spark: SparkSession, glob: str) -> str:
    """Path of the most recently modified file of a glob, from file listings alone."""
    files = spark.read.format("binaryFile").load(glob).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    if row is None or row["p"] is None:
        raise FileNotFoundError(glob)
    return row["p"]


def _charset(encoding: str) -> str:
    """What Spark's CSV reader is told: bytes are kept as they are for a charset it does not take."""
    plain = "utf-8" if encoding == "utf-8-sig" else encoding.lower()
    return plain if plain in SPARK_CHARSETS else BYTES


def file_encodings(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> dict[str, str]:
    """File -> the first encoding under which all of its lines read cleanly; the last one if none does.

    Every line of every file is looked at, each file by itself. What reaches the driver is a
    row for each file, as in a file listing.
    """
    left: set[str] | None = None
    out: dict[str, str] = {}
    for enc in encodings[:-1]:
        if _charset(enc) == "utf-8":
            lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.is_valid_utf8("value").alias("ok"))
        else:
            lines = spark.read.option("encoding", _charset(enc)).option("sep", "\u0001").schema("line string").csv(path)
            lines = lines.select(F.col("_metadata.file_path").alias("f"), (~F.coalesce(F.col("line"), F.lit("")).contains("\ufffd")).alias("ok"))
        seen = {r["f"]: r["ok"] for r in lines.groupBy("f").agg(F.bool_and("ok").alias("ok")).collect()}
        left = set(seen) if left is None else left
        for f in sorted(left):
            if seen.get(f, True):
                out[f] = enc
                left = left - {f}
        if not left:
            break
    return out | {f: encodings[-1] for f in left or ()}


def _decoder(encoding: str):
    @F.pandas_udf("string")
    def decode(text: pd.Series) -> pd.Series:
        return text.map(lambda v: None if v is None else v.encode("latin-1").decode(encoding, "replace"))

    return decode


def scan_csv(
    spark: SparkSession,
    glob: str,
    schema: T.StructType | str | None = None,
    encodings: Sequence[str] = ENCODINGS,
    latest: bool = True,
    header: bool = True,
) -> DataFrame:
    """CSV; the newest match of the glob, or all of them, each file in the first encoding that reads cleanly.

    A byte-order mark is dropped from the first column name; names and text are trimmed. Files of one scan
    have the same columns.
    """
    path = newest_file(spark, glob) if latest else glob
    by_encoding: dict[str, list[str]] = {}
    for file, enc in sorted(file_encodings(spark, path, encodings).items()):
        by_encoding.setdefault(enc, []).append(file)
    parts = [_scan_encoded(spark, files, schema, enc, header) for enc, files in by_encoding.items()] or [_scan_encoded(spark, [path], schema, encodings[0], header)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _scan_encoded(spark: SparkSession, files: Sequence[str], schema: T.StructType | str | None, enc: str, header: bool) -> DataFrame:
    charset = _charset(enc)
    # a doubled quote is the escape: a backslash may be half of a character
    reader = spark.read.option("header", header).option("encoding", charset).option("escape", '"')
    df = reader.schema(schema).csv(list(files)) if schema is not None else reader.csv(list(files))
    if charset == BYTES:
        decode = _decoder(enc)
        names = df.columns if schema is not None else [c.encode("latin-1").decode(enc) for c in df.columns]
        df = df.select(
            *[(decode(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(n) for f, n in zip(df.schema.fields, names)]
        )
    return df.toDF(*[c.replace("\ufeff", "").strip() for c in df.columns])


# Field names of the registry's documents.
_REGISTRY_FIELDS = {
    "Member Name": "agent_name", "Member Code": "agent_code", "Id Card": "agent_card", "Dealer Name Fc": "dealer",
    "Dealer_type": "dealer_type", "Status": "status", "Phone": "phone",
}
REGISTRY_SCHEMA = T.StructType(
    [T.StructField("data", T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in _REGISTRY_FIELDS])))]
)


def scan_registry(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Agents from JSON documents {"data": [...]}: trimmed, all three keys present, the last duplicate kept.

    One document per file, or one per line (splittable) with multi_line off; files
    count in the order of their names.
    """
    raw = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", multi_line).json(path)
    placed = raw.select("data", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = placed.select("_file", "_block", "_line", F.posexplode("data").alias("_pos", "a")).select(
        "_file", "_block", "_line", "_pos", *[F.trim(F.coalesce(F.col("a").getField(k), F.lit(""))).alias(v) for k, v in _REGISTRY_FIELDS.items()]
    )
    keys = ["agent_name", "agent_code", "agent_card"]
    full = rows.where((F.col("agent_name") != "") & (F.col("agent_code") != "") & (F.col("agent_card") != ""))
    order = ["_file", "_block", "_line", "_pos"]
    return last_row(full, keys, [F.col(c) for c in order]).drop(*order)


def _definition(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    return spark.read.text(path, wholetext=not lines)


def load_periods(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(grp, start_date, end_date) from the `time_periods` objects; rows with an unreadable date are dropped.

    One document per file, or with `lines` one per line, which is read by many tasks.
    """
    kind = "map<string,struct<start:string,end:string>>"
    body = F.from_json(F.get_json_object("value", "$.time_periods"), kind)
    rows = _definition(spark, path, lines).select(F.explode(body).alias("grp", "w"))
    day = lambda c: F.to_date(F.try_to_timestamp(F.col(c)))
    return rows.select("grp", day("w.start").alias("start_date"), day("w.end").alias("end_date")).dropna()


def load_attr_map(spark: SparkSession, path: str, key: str, lines: bool = False) -> DataFrame:
    """(product, attr) from objects of lists such as battery_types, or (product, price) from vehicle_prices.

    One document per file, or with `lines` one per line, which is read by many tasks.
    """
    text = F.get_json_object("value", f"$.{key}")
    doc = _definition(spark, path, lines)
    if key == "vehicle_prices":
        return doc.select(F.explode(F.from_json(text, "map<string,bigint>")).alias("product", "price"))
    lists = doc.select(F.explode(F.from_json(text, "map<string,array<string>>")).alias("attr", "names"))
    return lists.select(F.explode("names").alias("product"), "attr").select(F.trim("product").alias("product"), "attr")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """parquet, csv or json; arrays and maps are written to CSV as JSON text. Each task writes its own file."""
    if fmt == "csv":
        flat = [
            F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
        df = df.select(*flat)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
