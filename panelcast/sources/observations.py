"""Observation payloads and landed series files.

Re-aims the reference's download-and-cache client at landed files: the
normaliser, date bounds, freshness rule and tolerant loading all run as
Spark reads and column expressions, parsed on executors.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.schemas import CACHED_SERIES

# Fixed value: the publisher's missing-observation marker.
MISSING_MARKER = "."


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat raw observations derived from ``events``: (series_id, date text,
    value text); the missing marker stands in for every 17th event id."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select(
        "event_id", "event_type", "ts", "value")
    return ev.select(
        F.col("event_type").alias("series_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.when(F.col("event_id") % 17 == 0, F.lit(MISSING_MARKER))
         .otherwise(F.col("value").cast("string")).alias("value"),
    )


def explode_payload(payload: DataFrame) -> DataFrame:
    """Nested payload rows ``(series_id, observations[])`` -> flat text rows.
    A payload without ``observations`` is an error, as in the source API."""
    if "observations" not in payload.columns:
        raise ValueError("payload has no 'observations' field")
    return payload.select("series_id", F.inline("observations"))


def normalise(obs: DataFrame, series_id: str | None = None) -> DataFrame:
    """SC1: drop missing markers, text -> DOUBLE, text -> DATE, optional series
    id literal. Output (series_id, date, value). A row whose date does not
    parse is kept aside (:func:`rejected`), never a failed job; a value that
    does not parse is NULL."""
    if "observations" in obs.columns:
        obs = explode_payload(obs)
    sid = F.lit(series_id) if series_id is not None else F.col("series_id")
    return (obs.filter(F.col("value") != F.lit(MISSING_MARKER))
               .select(sid.cast("string").alias("series_id"),
                       F.col("date").try_cast("date").alias("date"),
                       F.col("value").try_cast("double").alias("value"))
               .filter(F.col("date").isNotNull()))


def rejected(obs: DataFrame) -> DataFrame:
    """The rows that :func:`normalise` keeps aside, as landed, with a reason:
    a date or a value that does not parse."""
    if "observations" in obs.columns:
        obs = explode_payload(obs)
    bad_date = F.col("date").try_cast("date").isNull()
    bad_value = (F.col("value") != F.lit(MISSING_MARKER)) & F.col("value").try_cast("double").isNull()
    return obs.withColumn("reason", F.when(bad_date, F.lit("date")).when(bad_value, F.lit("value"))) \
              .filter(F.col("reason").isNotNull())


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """SC2: inclusive date bounds, each optional; a plain filter Catalyst pushes to the scan."""
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df


def repair_date(df: DataFrame, col: str = "date") -> DataFrame:
    """SC8: parse ``date`` only when it arrives as text (NULL if it does not parse)."""
    if isinstance(df.schema[col].dataType, T.StringType):
        return df.withColumn(col, F.col(col).try_cast("date"))
    return df


def read_series_files(spark: SparkSession, path: str,
                      schema: T.StructType | None = None) -> DataFrame:
    """SC5: one scan over a folder of per-series Parquet files; the series
    key is the file stem (``_metadata.file_name`` without ``.parquet``), and
    a text ``date`` is repaired to DATE (SC8)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    key = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[a-z0-9]+)*\.parquet$", 1)
    return repair_date(df.select("*", key.alias("key")))


def read_cached_series(spark: SparkSession, path: str) -> DataFrame:
    """SC3: JSON array-of-records files (one array per file), explicit schema."""
    return spark.read.schema(CACHED_SERIES).option("multiLine", True).json(path)


def read_series_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines records as written by ``sinks.write_series_json``."""
    return spark.read.schema(CACHED_SERIES).json(path)


def read_fresh_series(spark: SparkSession, path: str, max_age_days: int = 1,
                      now: _dt.datetime | None = None, multi_line: bool = True) -> DataFrame:
    """SC4: only files whose age in whole days is <= ``max_age_days`` (so a
    file is usable until just under max_age_days + 1 days old). ``multi_line``:
    one JSON array per file; otherwise a record per line."""
    now = now or _dt.datetime.now()
    horizon = now - _dt.timedelta(days=max_age_days + 1)
    df = spark.read.schema(CACHED_SERIES).option("multiLine", multi_line).json(path)
    return df.filter(F.col("_metadata.file_modification_time") > F.lit(horizon))


def read_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC6: tolerant JSON-lines load. Returns (good rows, rejected raw lines);
    a malformed record is kept aside instead of failing the job."""
    schema = T.StructType(CACHED_SERIES.fields + [T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    df = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE",
                                                    "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    bad = F.col("_corrupt_record").isNotNull()
    return df.filter(~bad).drop("_corrupt_record"), df.filter(bad).select("_corrupt_record")


def read_parquet_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """SC6: tolerant Parquet load. Returns (rows of the readable files, paths
    of the files that gave none: unreadable or empty)."""
    good = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    read = good.select(F.col("_metadata.file_path").alias("path")).distinct()
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return good, listed.join(read, "path", "left_anti")


def require_source(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType | None = None) -> DataFrame:
    """SC7: read a source or fail with a clear error when it is missing/empty."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.load(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no data at {path}") from e
    if df.isEmpty():
        raise ValueError(f"source {path} has no rows")
    return df
