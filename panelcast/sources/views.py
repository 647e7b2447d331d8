"""Panel views over the landed tables.

Each view aggregates raw rows to the panel contract
``(entity_id, series_id, date, value)``, unique on the first three. Values
are summed as DECIMAL(18,2) and cast to DOUBLE so that every engine gets the
same bits. The aggregation is a partial + final hash aggregate, so a key
holding a large share of the raw rows is combined map-side before it
shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def read_table(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    """Column-pruned Parquet scan of one landed table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def to_panel(df: DataFrame, entity: Column, series: Column, date: Column,
             value: Column) -> DataFrame:
    return (df.groupBy(entity.cast("string").alias("entity_id"),
                       series.cast("string").alias("series_id"),
                       date.alias("date"))
              .agg(F.sum(value.cast("decimal(18,2)")).cast("double").alias("value")))


def bound_days(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Inclusive day bounds on a raw timestamp column, written as range
    predicates on the column itself so they push down to the scan."""
    c = F.col(ts)
    if start is not None:
        df = df.filter(c >= F.lit(start).cast("date").cast(df.schema[ts].dataType))
    if end is not None:
        df = df.filter(c < F.date_add(F.lit(end).cast("date"), 1).cast(df.schema[ts].dataType))
    return df


def month_of(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "month")


def _all() -> Column:
    return F.lit("all")


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per priority and month (flagship; target ``1-URGENT``)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderpriority", "o_orderdate", "o_totalprice"])
    return to_panel(o, _all(), F.col("o_orderpriority"), month_of("o_orderdate"),
                    F.col("o_totalprice"))


def _orders_by_nation(spark: SparkSession, sf_dir: str, entity: str, series: str) -> DataFrame:
    """Order value per (entity, series, month) where entity / series come
    from the customer's nation. Orders are pre-aggregated per (customer,
    priority, month) *before* the customer join, so a customer holding a
    large share of the orders reaches the join as a handful of rows; the
    DECIMAL partial sums add up exactly, so the result is unchanged."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice"])
    part = (o.groupBy("o_custkey", "o_orderpriority", month_of("o_orderdate").alias("month"))
             .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("part")))
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    if "n_name" in (entity, series):
        n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
        c = c.join(n, c.c_nationkey == n.n_nationkey)
    j = part.join(c, part.o_custkey == c.c_custkey)
    ent = _all() if entity == "all" else F.col(entity)
    return (j.groupBy(ent.cast("string").alias("entity_id"), F.col(series).cast("string").alias("series_id"),
                      F.col("month").alias("date"))
             .agg(F.sum("part").cast("double").alias("value")))


def nation_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per customer nation and month: many predictors."""
    return _orders_by_nation(spark, sf_dir, "all", "n_name")


def nation_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation (entity): order value per priority and month; has gaps."""
    return _orders_by_nation(spark, sf_dir, "c_nationkey", "o_orderpriority")


def supplier_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped value per supplier and month: the many-series scale view."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice"])
    return to_panel(li, _all(), F.col("l_suppkey"), month_of("l_shipdate"),
                    F.col("l_extendedprice"))


def daily_ship(spark: SparkSession, sf_dir: str, start: str | None = None,
               end: str | None = None) -> DataFrame:
    """Shipped value per return flag and day: long daily series. Optional
    inclusive day bounds are applied to the raw timestamp column, where the
    Parquet reader can use them (row-group statistics)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_returnflag", "l_shipdate", "l_extendedprice"])
    li = bound_days(li, "l_shipdate", start, end)
    return to_panel(li, _all(), F.col("l_returnflag"), F.col("l_shipdate").cast("date"),
                    F.col("l_extendedprice"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value per type and hour; ``date`` is an hour TIMESTAMP here."""
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    return to_panel(ev, _all(), F.col("event_type"),
                    F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")), F.col("value"))


def user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value per user and day: many short series."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "value"])
    return to_panel(ev, _all(), F.col("user_id"), F.col("ts").cast("date"), F.col("value"))


VIEWS = {
    "monthly_orders": monthly_orders,
    "nation_monthly": nation_monthly,
    "nation_priority": nation_priority,
    "supplier_monthly": supplier_monthly,
    "daily_ship": daily_ship,
    "hourly_events": hourly_events,
    "user_daily": user_daily,
}


def panel_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)
