"""Window specs and strict rolling statistics.

Every positional operation names its partition and ordering key; there is
no unpartitioned window anywhere in the library. Under the panel contract
(one row per entity, series and date) a partition holds at most one row per
period, so window partitions are bounded by the calendar, not by data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES_KEYS = ("entity_id", "series_id")


def series_window(keys: Sequence[str] = SERIES_KEYS, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rolling(w: WindowSpec, size: int) -> WindowSpec:
    """Trailing frame of ``size`` rows ending at the current row."""
    return w.rowsBetween(-(size - 1), 0)


def strict_mean(c, w: WindowSpec, size: int) -> Column:
    """Rolling mean that is NULL until ``size`` non-null values fill the frame
    (a NULL inside the frame also gives NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    fw = rolling(w, size)
    return F.when(F.count(c).over(fw) == size, F.avg(c).over(fw))


def strict_std(c, w: WindowSpec, size: int) -> Column:
    """Rolling sample standard deviation (ddof 1) with the strict NULL rule."""
    c = F.col(c) if isinstance(c, str) else c
    fw = rolling(w, size)
    return F.when(F.count(c).over(fw) == size, F.stddev_samp(c).over(fw))


def ordered_lag(c, w: WindowSpec, k: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lag(c, k).over(w)
