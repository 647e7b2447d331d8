"""Chronological splits and expanding-window folds, per series.

Positions come from ``row_number`` over (series keys) ordered by date; the
partition is one series, bounded by its number of periods. Folds are
returned as a fold table (boundaries), not as exploded copies of the
training rows, so their size is O(folds), not O(rows x folds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.windows import SERIES_KEYS


def positions(df: DataFrame, keys: Sequence[str] = SERIES_KEYS, order: str = "date") -> DataFrame:
    """Adds 0-based ``rn`` and series length ``n``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("rn"),
                     F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))


def ts_split(df: DataFrame, keys: Sequence[str] = SERIES_KEYS, train_size: float = 0.7,
             validation_size: float = 0.15, order: str = "date") -> DataFrame:
    """V1: first int(n*0.7) rows train, next int(n*0.15) validation, rest test
    (``int`` truncation, no shuffling)."""
    return assign_split(positions(df, keys, order), train_size, validation_size)


def assign_split(p: DataFrame, train_size: float = 0.7, validation_size: float = 0.15) -> DataFrame:
    """Split label from 0-based position ``rn`` and length ``n`` columns."""
    n_train = (F.col("n") * F.lit(float(train_size))).cast("bigint")
    n_val = (F.col("n") * F.lit(float(validation_size))).cast("bigint")
    split = (F.when(F.col("rn") < n_train, F.lit("train"))
             .when(F.col("rn") < n_train + n_val, F.lit("validation"))
             .otherwise(F.lit("test")))
    return p.withColumn("split", split)


def split_counts(split_df: DataFrame, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Rows per split per series (A13), one aggregate."""
    return split_df.groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("rows"),
                                                F.min("date").alias("first_date"),
                                                F.max("date").alias("last_date"))


def expanding_folds(df: DataFrame, keys: Sequence[str] = SERIES_KEYS, min_train_size: int = 60,
                    step: int = 12, horizon: int = 12, order: str = "date") -> DataFrame:
    """V2 fold table: fold f trains on the first e = m + step*f rows and tests
    on the next ``horizon`` rows, for every e < n - horizon (the upper bound
    is exclusive, as in ``range(m, n - 12, 12)``). One window pass: a fold
    starts at each row whose position is a fold boundary."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = positions(df, keys, order).select(
        *keys, "rn", "n", F.col(order).alias("_d"),
        F.lag(order, 1).over(w).alias("train_end"),
        F.lead(order, horizon - 1).over(w).alias("test_end"),
        F.first(order).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("train_start"))
    is_boundary = ((F.col("rn") >= min_train_size)
                   & ((F.col("rn") - min_train_size) % step == 0)      # fold definition
                   & (F.col("rn") < F.col("n") - horizon))
    return p.filter(is_boundary).select(
        *keys, ((F.col("rn") - min_train_size) / step).cast("bigint").alias("fold"),
        F.col("rn").alias("n_train"), F.lit(horizon).cast("bigint").alias("n_test"),
        "train_start", "train_end", F.col("_d").alias("test_start"), "test_end")

