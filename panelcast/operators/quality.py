"""Statistics and data-quality reporting per series.

Each report is one grouped aggregate (partial + final); distinct counts are
planned by Spark as a two-level aggregate keyed by the distinct value, so a
large series spreads over many tasks before it is combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.windows import SERIES_KEYS
from panelcast.operators.quantiles import exact_quantiles
from panelcast.session import materialize

# The quality rule threshold and issue texts.
SHORT_SPAN_DAYS = 365
NO_ISSUES = "No issues detected"
NO_DATA = "No data available"


def value_stats(df: DataFrame, value: str = "value", keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """A1 / A2: count, mean, std (ddof 1), min, max of non-null values."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))


def describe(df: DataFrame, value: str = "value", keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """A3: count, mean, std, min, 25 / 50 / 75 % (exact, interpolated), max."""
    df = materialize(df.select(*keys, value))
    q = exact_quantiles(df, keys, value, (0.25, 0.5, 0.75))
    return value_stats(df, value, keys).join(q, list(keys), "left")


def date_ranges(df: DataFrame, keys: Sequence[str] = SERIES_KEYS, date: str = "date") -> DataFrame:
    """A4: first and last date per series."""
    return df.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def _row_struct(df: DataFrame) -> F.Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def duplicate_count(df: DataFrame, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Rows minus distinct whole rows per series. The whole row is one
    struct, so rows with NULL fields are still counted as duplicates."""
    return df.groupBy(*keys).agg(
        (F.count(F.lit(1)) - F.count_distinct(_row_struct(df))).alias("duplicate_rows"))


def null_count(df: DataFrame) -> F.Column:
    """A5: total NULL cells across all columns of a row (to be summed)."""
    total = F.lit(0)
    for c in df.columns:
        total = total + F.col(f"`{c}`").isNull().cast("int")
    return total


def quality_report(df: DataFrame, catalog: DataFrame | None = None,
                   keys: Sequence[str] = SERIES_KEYS, date: str = "date") -> DataFrame:
    """One row per series of an entity: entity_id, name, status, rows, date_range, issues[].

    Issues: missing cells, span under 365 days, duplicate rows; otherwise
    ``No issues detected``. Series (entity_id, series_id) listed in ``catalog``
    without rows get status ``empty`` and ``No data available``.
    """
    keys = list(keys)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(null_count(df)).alias("_nulls"),
        F.min(date).alias("_first"), F.max(date).alias("_last"),
        F.count_distinct(_row_struct(df)).alias("_distinct"))
    if catalog is not None:           # read twice below: keep the small aggregate
        agg = materialize(agg)
    span = F.datediff("_last", "_first")
    dups = F.col("rows") - F.col("_distinct")
    issues = F.filter(F.array(
        F.when(F.col("_nulls") > 0, F.format_string("Missing values: %d", F.col("_nulls"))),
        F.when(span < SHORT_SPAN_DAYS, F.format_string("Short time series: %d days", span)),
        F.when(dups > 0, F.format_string("Duplicate rows: %d", dups)),
    ), lambda x: x.isNotNull())
    rep = agg.select(
        "entity_id", F.col("series_id").alias("name"), F.lit("ok").alias("status"), F.col("rows").cast("bigint"),
        F.concat_ws(" to ", F.col("_first").cast("string"), F.col("_last").cast("string")).alias("date_range"),
        F.when(F.size(issues) == 0, F.array(F.lit(NO_ISSUES))).otherwise(issues).alias("issues"))
    if catalog is None:
        return rep
    empty = (catalog.select("entity_id", F.col("series_id").alias("name")).distinct()
             .join(rep.select("entity_id", "name"), ["entity_id", "name"], "left_anti")
             .select("entity_id", "name", F.lit("empty").alias("status"), F.lit(0).cast("bigint").alias("rows"),
                     F.lit(None).cast("string").alias("date_range"),
                     F.array(F.lit(NO_DATA)).alias("issues")))
    return rep.unionByName(empty)


def collection_summary(panel: DataFrame) -> DataFrame:
    """A10: series per category plus the grand total (``rollup``)."""
    return (panel.rollup("category").agg(F.count_distinct("series_id").alias("n_series"),
                                         F.grouping("category").alias("_g"))
            .select(F.when(F.col("_g") == 1, F.lit("total"))
                     .otherwise(F.col("category")).alias("category"), "n_series"))


def head_sample(df: DataFrame, n: int = 5, keys: Sequence[str] = SERIES_KEYS,
                order: str = "date") -> DataFrame:
    """First n rows of each series (planned as a per-group limit)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def dirty_panel(panel: DataFrame) -> DataFrame:
    """Quality fixture derived from a panel: January rows duplicated and June
    values blanked to NULL."""
    blank = panel.withColumn("value", F.when(F.month("date") == 6, F.lit(None).cast("double"))
                             .otherwise(F.col("value")))
    return blank.unionByName(blank.filter(F.month("date") == 1))
