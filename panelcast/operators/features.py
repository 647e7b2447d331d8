"""Change, lag, rolling and momentum features over a panel.

All windows are partitioned by the series key and ordered by ``date``; the
columns of one feature set are written in one ``select`` so the planner
merges them into a single Window node over one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.ieee import ieee_div, ieee_ln, ratio_minus_one
from panelcast.functions.windows import (
    SERIES_KEYS, ordered_lag, series_window, strict_mean, strict_std,
)


def pct_change(value: str | Column, w: Window, periods: int = 1) -> Column:
    """Percent-change ratio (not x100): NULLs are forward-filled first, then
    ``(cur - prev) / prev`` against the value ``periods`` rows back."""
    v = F.col(value) if isinstance(value, str) else value
    if periods == 1:
        prev = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        cur = F.coalesce(v, prev)
    else:  # filled value k rows back: last non-null up to that row
        prev = F.last(v, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -periods))
        cur = F.coalesce(v, F.last(v, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
    return ieee_div(cur - prev, prev)


def mom_pct(df: DataFrame, value: str = "value", keys: Sequence[str] = SERIES_KEYS,
            out: str = "mom_pct") -> DataFrame:
    """Month-on-month percent change x100; first row of a series is NULL."""
    w = series_window(keys)
    return df.withColumn(out, pct_change(value, w) * F.lit(100.0))


def yoy_change(df: DataFrame, value: str = "value", keys: Sequence[str] = SERIES_KEYS,
               periods: int = 12, out: str = "yoy_change") -> DataFrame:
    """``v / v[t-12] - 1`` as a fraction (positional, not calendar)."""
    w = series_window(keys)
    return df.withColumn(out, ratio_minus_one(F.col(value), ordered_lag(value, w, periods)))


def log_value(df: DataFrame, value: str = "value", out: str = "log_value") -> DataFrame:
    """natural log with IEEE results for 0 and negatives."""
    return df.withColumn(out, ieee_ln(value))


def date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """calendar year, month and quarter as BIGINT."""
    d = F.col(date)
    return df.select("*", F.year(d).cast("bigint").alias("year"),
                     F.month(d).cast("bigint").alias("month"),
                     F.quarter(d).cast("bigint").alias("quarter"))


def rolling_features(df: DataFrame, value: str = "value", keys: Sequence[str] = SERIES_KEYS,
                     means: Sequence[int] = (3,), stds: Sequence[int] = (3,),
                     prefix: str | None = None) -> DataFrame:
    """Strict rolling means ``ma{n}`` and sample stds ``vol{n}``."""
    w = series_window(keys)
    p = f"{prefix}_" if prefix else ""
    cols = [strict_mean(value, w, n).alias(f"{p}ma{n}") for n in means]
    cols += [strict_std(value, w, n).alias(f"{p}vol{n}") for n in stds]
    return df.select("*", *cols)


def lags(df: DataFrame, value: str, max_lag: int, keys: Sequence[str] = SERIES_KEYS,
         prefix: str | None = None) -> DataFrame:
    """``{value}_lag1 .. _lag{max_lag}`` in one select."""
    w = series_window(keys)
    p = prefix or value
    return df.select("*", *[ordered_lag(value, w, k).alias(f"{p}_lag{k}")
                            for k in range(1, max_lag + 1)])


def momentum(df: DataFrame, value: str = "value", keys: Sequence[str] = SERIES_KEYS,
             diff_periods: int = 3, ratio_periods: int = 6,
             prefix: str | None = None) -> DataFrame:
    """W8 ``v - v[t-3]`` and W9 ``v / v[t-6] - 1``."""
    w = series_window(keys)
    p = f"{prefix}_" if prefix else ""
    v = F.col(value)
    return df.select(
        "*",
        (v - ordered_lag(value, w, diff_periods)).alias(f"{p}mom{diff_periods}"),
        ratio_minus_one(v, ordered_lag(value, w, ratio_periods)).alias(f"{p}mom{ratio_periods}"),
    )


def target_features(target: DataFrame, keys: Sequence[str] = SERIES_KEYS,
                    value: str = "value") -> DataFrame:
    """Target frame: value plus mom_pct (x100), log_value, yoy_change
    (fraction) and year / month / quarter, in one Window stage. Keyed by
    (entity, series): the target is one series per entity, and a series key
    keeps the window hash-partitioned even when the entity is constant."""
    w = series_window(keys)
    v = F.col(value)
    return target.select(
        "*",
        (pct_change(value, w) * F.lit(100.0)).alias("mom_pct"),
        ieee_ln(v).alias("log_value"),
        ratio_minus_one(v, ordered_lag(value, w, 12)).alias("yoy_change"),
        F.year("date").cast("bigint").alias("year"),
        F.month("date").cast("bigint").alias("month"),
        F.quarter("date").cast("bigint").alias("quarter"),
    )


def predictor_features(panel: DataFrame, keys: Sequence[str] = SERIES_KEYS,
                       value: str = "value") -> DataFrame:
    """Per predictor series: level, mom_pct, ma3, vol3 (one Window stage)."""
    w = series_window(keys)
    return panel.select(
        *keys, "date",
        F.col(value).alias("level"),
        (pct_change(value, w) * F.lit(100.0)).alias("mom_pct"),
        strict_mean(value, w, 3).alias("ma3"),
        strict_std(value, w, 3).alias("vol3"),
    )
