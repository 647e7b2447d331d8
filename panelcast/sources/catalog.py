"""Series catalog: (series_id, category, role, key) dimension, and the union
of source groups into one panel with a ``category`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.views import month_of, panel_view, read_table

# Source group names of the collection.
TARGET_CATEGORY = "target"
GROUPS = ("market_returns", "bond_market", "macro_indicators")
EMPTY_SERIES = "NO-OBSERVATIONS"


def collected_panel(spark: SparkSession, sf_dir: str, target: str = "1-URGENT") -> DataFrame:
    """SC10 / T8: target + three groups in one panel, each row tagged with its
    category; each landed table is read once. Orders are summed per (customer,
    priority, month) first; each such sum then counts for its priority and for
    its customer's nation."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice"])
    part = (o.groupBy("o_custkey", "o_orderpriority", month_of("o_orderdate").alias("date"))
             .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("part")))
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    named = c.join(n, c.c_nationkey == n.n_nationkey)
    priority = F.struct(F.when(F.col("o_orderpriority") == target, F.lit(TARGET_CATEGORY))
                        .otherwise(F.lit(GROUPS[0])).alias("category"), F.col("o_orderpriority").alias("series_id"))
    nation = F.struct(F.lit(GROUPS[2]).alias("category"), F.col("n_name").alias("series_id"))
    both = F.when(F.col("n_name").isNull(), F.array(priority)).otherwise(F.array(priority, nation))
    orders = (part.join(named, part.o_custkey == named.c_custkey, "left")
              .select("date", "part", F.inline(both))
              .groupBy(F.lit("all").alias("entity_id"), "series_id", "date", "category")
              .agg(F.sum("part").cast("double").alias("value")))
    ship = panel_view(spark, sf_dir, "daily_ship").withColumn("category", F.lit(GROUPS[1]))
    return orders.select("entity_id", "series_id", "date", "value", "category").unionByName(ship)


def series_keys(panel: DataFrame) -> DataFrame:
    """SK3 names: ``{category}_{lower(series)}`` per distinct series."""
    return (panel.select("category", "series_id").distinct()
            .withColumn("key", F.concat_ws("_", "category", F.lower("series_id"))))


def catalog(panel: DataFrame, extra_empty: bool = True) -> DataFrame:
    """SC9: the catalog dimension from a categorised panel; role ``target`` for
    the target category. Optionally lists one id with no observations."""
    keys = series_keys(panel)
    if extra_empty:
        spark = panel.sparkSession
        empty = spark.createDataFrame([(GROUPS[2], EMPTY_SERIES)], "category string, series_id string")
        keys = keys.unionByName(empty.withColumn(
            "key", F.concat_ws("_", "category", F.lower("series_id"))))
    return keys.select(
        "series_id", "category",
        F.when(F.col("category") == TARGET_CATEGORY, F.lit("target"))
         .otherwise(F.lit("predictor")).alias("role"),
        "key")


def catalog_join(panel: DataFrame, cat: DataFrame) -> DataFrame:
    """Attach catalog attributes. A series is named by (category, series_id):
    one id may occur in several categories."""
    return panel.join(cat, ["category", "series_id"])


def role_of_key(df: DataFrame) -> DataFrame:
    """PF6: role by key prefix (``target_`` -> target, rest predictors)."""
    return df.withColumn("role", F.when(F.col("key").startswith("target_"), F.lit("target"))
                         .otherwise(F.lit("predictor")))
