"""Mergeable quantile sketches (A3 past the size where ranking every value pays).

Each day's rows of a series are summarised once, in a KLL sketch of bounded size beside exact counts.
Any span of days, any roll-up of series, is then a merge of small rows; raw rows are
not read again, and a new day only adds its own sketch. The estimate for
probability p is a value whose true rank is within ``rank_error(k)`` of p (with about 99 % confidence; the
bound does not grow with rows, days or merges); smallest and largest value and all counts are exact. The exact path is
:func:`quantiles.exact_quantiles`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.windows import SERIES_KEYS

K = 800                       # accuracy of a sketch, about 3 k bytes at any size


def rank_error(k: int = K) -> float:
    """Stated bound on the normalised rank error of a sketch and of its merges (two-sided, about 99 %)."""
    return 2.446 / k ** 0.9433


def day_sketches(rows: DataFrame, keys: Sequence[str] = SERIES_KEYS, day: str | Column = "date", value: str = "value", k: int = K) -> DataFrame:
    """(keys, day, sketch, n, n_missing): one row for each series and day. NULL and NaN values are counted as missing and not
    summarised; a day with nothing else has a NULL sketch. Partial sketches are merged map-side, so a day that holds most
    rows is no hot key."""
    v = F.col(value).cast("double")
    known = F.when(v.isNotNull() & ~F.isnan(v), v)
    d = F.col(day) if isinstance(day, str) else day
    return rows.groupBy(*keys, d.cast("date").alias("day")).agg(
        F.count(known).alias("n"), F.count(F.lit(1)).alias("_all"), F.kll_sketch_agg_double(known, F.lit(k)).alias("_s")).select(
        *keys, "day", F.when(F.col("n") > 0, F.col("_s")).alias("sketch"), "n", (F.col("_all") - F.col("n")).alias("n_missing"))


def merged(sketches: DataFrame, keys: Sequence[str] = SERIES_KEYS, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """(keys, sketch, n, n_missing) over a span of days, both ends included; ``keys`` may leave out some of the sketches' own."""
    if first_day is not None:
        sketches = sketches.filter(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        sketches = sketches.filter(F.col("day") <= F.lit(last_day).cast("date"))
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"), F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing")).select(
        *keys, F.when(F.col("n") > 0, F.col("_s")).alias("sketch"), "n", "n_missing")


def quantiles(sketches: DataFrame, probs: Sequence[float], keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """(keys, n, n_missing, min, max, q<percent>...) of merged sketches; NULL where nothing is known."""
    def at(p: float) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))
    return sketches.select(*keys, "n", "n_missing", at(0.0).alias("min"), at(1.0).alias("max"),
                           *[at(p).alias(f"q{int(round(p * 100))}") for p in probs])
