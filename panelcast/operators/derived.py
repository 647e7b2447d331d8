"""Second-tier derived features: long lags, calendar-window volatility,
regimes, interactions, calendar effects and spreads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.windows import SERIES_KEYS, series_window, strict_mean


def day_number(date: str = "date") -> F.Column:
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))


def rolling_vol_days(panel: DataFrame, days: Sequence[int] = (30, 91, 182),
                     keys: Sequence[str] = SERIES_KEYS, value: str = "value") -> DataFrame:
    """Sample std of the values observed within the last ``d`` calendar
    days (range frame on the day number, so gaps do not stretch a window)."""
    w = Window.partitionBy(*keys).orderBy(day_number())
    return panel.select("*", *[F.stddev_samp(value).over(w.rangeBetween(-(d - 1), 0)).alias(f"vol{d}d")
                               for d in days])


def regimes(panel: DataFrame, window: int = 6, keys: Sequence[str] = SERIES_KEYS,
            value: str = "value") -> DataFrame:
    """Regime flag: ``high`` when the value is above its strict rolling
    mean, ``low`` otherwise; NULL during warm-up."""
    w = series_window(keys)
    ma = strict_mean(value, w, window)
    return panel.withColumn("regime", F.when(ma.isNull(), F.lit(None).cast("string"))
                            .when(F.col(value) > ma, F.lit("high")).otherwise(F.lit("low")))


def regime_stats(df: DataFrame, col: str, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Statistics of ``col`` conditional on the regime."""
    return (df.filter(F.col("regime").isNotNull())
              .groupBy(*keys, "regime")
              .agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std")))


def interactions(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Products of named column pairs (only the requested pairs)."""
    return wide.select("*", *[(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}_x_{b}") for a, b in pairs])


def calendar_effects(df: DataFrame, col: str, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Mean of ``col`` per month of year, with the quarter-end flag."""
    m = F.month("date")
    return (df.groupBy(*keys, m.cast("bigint").alias("month"))
              .agg(F.count(col).alias("n"), F.avg(col).alias("mean"))
              .withColumn("quarter_end", F.col("month") % 3 == 0))


def spread(panel: DataFrame, a: str, b: str, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """value(a) - value(b) on the dates both series have (e.g. 10y - 2y)."""
    keys = list(keys)
    sa = panel.filter(F.col("series_id") == a).select(*keys, "date", F.col("value").alias("a"))
    sb = panel.filter(F.col("series_id") == b).select(*keys, "date", F.col("value").alias("b"))
    return sa.join(sb, keys + ["date"]).withColumn("spread", F.col("a") - F.col("b"))
