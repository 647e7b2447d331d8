"""Frequency alignment, release-delay (as-of) alignment and vintages.

None of these needs a range join: monthly alignment is a grouped
aggregate; as-of alignment is a union of the two sides ordered by date in
one window per series, carrying the last available value forward; the
bitemporal join is one sweep over both in the order in which things became known.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.windows import SERIES_KEYS
from panelcast.session import materialize


def to_monthly(panel: DataFrame, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Daily (or any) series -> month start: mean, last value of the month
    (``max_by`` on date), first and last observation date, count."""
    m = F.trunc("date", "month")
    return (panel.groupBy(*keys, m.alias("date"))
            .agg(F.avg("value").alias("mean_value"), F.max_by("value", "date").alias("last_value"),
                 F.count("value").alias("n_obs"), F.min("date").alias("first_obs"),
                 F.max("date").alias("last_obs")))


def asof_align(targets: DataFrame, predictors: DataFrame, delay_days: int = 0,
               keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """R2: for each target date and predictor series, the latest predictor
    value already *released* on that date (observation date + ``delay_days``
    <= target date). ``targets`` has (keys, date); ``predictors`` has (keys,
    series_id, date, value). Output (keys, series_id, date, value,
    source_date); NULL when nothing was released yet.

    Implementation: an entity's target dates meet its series in a join on the
    entity (the result has a row for each of those pairs), are unioned with
    the releases, and ``last(ignorenulls)`` over each (keys, series) ordered by
    date carries the last release forward, releases sorting before targets on
    the same day. No range or cross join."""
    keys = list(keys)
    predictors = materialize(predictors)          # read for the names and for the releases
    pairs = predictors.select(*keys, "series_id").distinct()
    grid = materialize(targets.select(*keys, "date").distinct()).join(pairs, keys)
    t = grid.select(*keys, "series_id", F.col("date").alias("_d"), F.lit(1).alias("_kind"),
                    F.lit(None).cast("double").alias("_v"), F.lit(None).cast("date").alias("_src"))
    r = predictors.select(*keys, "series_id", F.date_add("date", delay_days).alias("_d"),
                          F.lit(0).alias("_kind"), F.col("value").alias("_v"),
                          F.col("date").alias("_src"))
    w = (Window.partitionBy(*keys, "series_id").orderBy("_d", "_kind")
         .rowsBetween(Window.unboundedPreceding, 0))
    both = t.unionByName(r).select(
        "*", F.last("_v", ignorenulls=True).over(w).alias("value"),
        F.last("_src", ignorenulls=True).over(w).alias("source_date"))
    return both.filter(F.col("_kind") == 1).select(*keys, "series_id", F.col("_d").alias("date"),
                                                   "value", "source_date")


def latest_vintage(obs: DataFrame, keys: Sequence[str] = ("series_id", "date"),
                   vintage: str = "vintage", tie: str | None = None) -> DataFrame:
    """Keep the latest revision of each observation (``max_by`` on the
    vintage, with an optional tie-breaker) plus the number of revisions."""
    order = F.struct(vintage, tie) if tie else F.col(vintage)
    return obs.groupBy(*keys).agg(F.max_by("value", order).alias("value"),
                                  F.max(vintage).alias("vintage"),
                                  F.count(F.lit(1)).alias("n_revisions"))


def known_then(requests: DataFrame, vintages: DataFrame, keys: Sequence[str] = ("series_id",), valid: str = "latest",
               tie: str | None = None) -> DataFrame:
    """R2 + R3, point in time: what was known about a series at the moment ``known`` of each request,
    revisions included, and nothing that came later.

    ``vintages``: (keys, date, known, value): the value published at ``known`` for ``date``; a later one for the same date
    is its revision, and dates may become known in any order. ``requests``: (keys, known), and ``date`` except for
    ``latest``; other columns come along. ``valid`` says which date is asked for:

    * ``exact``: the request's own date, in its last revision by then (the window's partition holds one date);
    * ``latest``: the latest date known by then, in its last revision by then: a running maximum of (date, known);
    * ``upto``: the latest date not after the request's that was known by then: the sweep carries the dates known so
      far in order, each with its last value.

    Adds ``value``, ``source_date`` and ``source_known``, NULL where nothing was known. Requests stay as they are, repeated ones
    too. A vintage published at the very moment of a request counts; of vintages published at one moment for one date the
    largest ``tie`` (or value) counts. A null ``known`` or date is never known; a request with a null ``known``, or a null date where one is
    asked for, finds nothing. One exchange on the keys (and the date for ``exact``); no grid of dates and series, no range join.
    """
    if valid not in ("exact", "latest", "upto"):
        raise ValueError(f"unknown kind of request {valid!r}")
    keys = list(keys)
    asked = [c for c in requests.columns if c not in keys]
    order = F.col(tie) if tie else F.col("value")
    v = vintages.filter(F.col("known").isNotNull() & F.col("date").isNotNull()).select(
        *keys, F.lit(0).alias("_kind"), F.col("known").alias("_known"), F.col("date").alias("_date"), order.alias("_tie"),
        F.col("value").alias("_value"), F.lit(None).cast(requests.select(F.struct(*asked)).schema[0].dataType).alias("_ask"))
    date = F.col("date") if valid != "latest" else F.lit(None)
    r = requests.select(*keys, F.lit(1).alias("_kind"), F.col("known").cast(v.schema["_known"].dataType).alias("_known"),
                        date.cast(v.schema["_date"].dataType).alias("_date"), F.lit(None).cast(v.schema["_tie"].dataType).alias("_tie"),
                        F.lit(None).cast("double").alias("_value"), F.struct(*asked).alias("_ask"))
    both = v.withColumn("_value", F.col("_value").cast("double")).unionByName(r)
    if valid == "upto":
        found = _sweep(both, keys)
    else:
        part = [*keys, "_date"] if valid == "exact" else keys
        w = Window.partitionBy(*part).orderBy(F.col("_known").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
        seen = F.when(F.col("_kind") == 0, F.struct("_date", "_known", "_tie", "_value"))
        found = both.withColumn("_got", F.max(seen).over(w)).filter("_kind = 1").select(
            *keys, "_ask", F.col("_got._value").alias("value"), F.col("_got._date").alias("source_date"),
            F.col("_got._known").alias("source_known"))
    return found.select(*keys, *[F.col("_ask")[c].alias(c) for c in asked], "value", "source_date", "source_known")


def _sweep(both: DataFrame, keys: list[str]) -> DataFrame:
    """``upto``: per series, the dates known so far in order; a request looks up the last one not after its own. What is carried is
    bounded by the dates of one series."""
    out = both.select(*keys, "_ask", F.col("_value").alias("value"), F.col("_date").alias("source_date"),
                      F.col("_known").alias("source_known")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, dates, last = object(), [], {}
        for b in batches:
            cols = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            rows = list(zip(*[cols[k].to_pylist() for k in keys]))
            kind, known, date, value = (cols[c].to_pylist() for c in ("_kind", "_known", "_date", "_value"))
            at, got = [], []
            for i, key in enumerate(rows):
                if key != open_:
                    open_, dates, last = key, [], {}
                if kind[i] == 0:
                    if date[i] not in last:
                        dates.insert(bisect_right(dates, date[i]), date[i])
                    last[date[i]] = (value[i], date[i], known[i])          # published in order, ties ascending
                else:
                    k = bisect_right(dates, date[i]) if date[i] is not None and known[i] is not None else 0
                    at.append(i)
                    got.append(last[dates[k - 1]] if k else (None, None, None))
            if at:
                take = pa.array(at)
                found = list(zip(*got))
                yield pa.record_batch([*[cols[k].take(take) for k in keys], cols["_ask"].take(take), pa.array(found[0], pa.float64()),
                                       pa.array(found[1], cols["_date"].type), pa.array(found[2], cols["_known"].type)], out.names)
    return (both.repartition(*keys).sortWithinPartitions(*keys, F.col("_known").asc_nulls_first(), "_kind", "_date", "_tie", "_value")
            .mapInArrow(run, out))
