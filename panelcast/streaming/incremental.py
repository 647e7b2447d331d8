"""Incremental data updates with Structured Streaming.

New observation files land in a folder; each micro-batch is reduced to the
events not seen before, whose additive partial sums per (series, period) are
written with ``foreachBatch`` into a folder of the batch (overwrite per batch
id, so a replayed batch is idempotent). There are two ways to know an event again:

* :func:`start_hourly_updates` keeps the ids of a batch beside its sums, and a batch looks up
  only the days it holds. Nothing is dropped for being late: late events are summed like all
  others and counted in ``n_late``. The panel does not depend on how files
  were dealt to batches; the ids grow with the events.
* :func:`start_state_updates` keeps them in Spark's state store
  (``dropDuplicatesWithinWatermark``) and lets them expire with the watermark, so the state is bounded by
  the events of one horizon. An event that is older than the newest one of an earlier
  batch by more than the horizon is rejected and counted; one whose id has expired is older than that
  by itself, so no event is ever summed twice.

An event without an id is known by all its columns. An event without a time belongs
to no hour: the first way sums it under a NULL date, the second rejects it.

The current panel is the base plus the partials after it. :func:`compact` folds the
partials of committed batches into a new base beside the old one and then marks it; only
marked bases are read and only what a mark covers is deleted, so a crash at any point, or the replay of
a batch whose commit was lost, changes nothing. Checkpoints and outputs live under the session's shared
folder.
"""

from __future__ import annotations

import uuid

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import Spool, checkpoint_dir

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
IDS = "event_id long, anon string, day date, batch_id long"
SUMS = [("value_sum", "decimal(38,2)"), ("n_events", "long"), ("n_late", "long")]
PARTIALS = ("entity_id string, series_id string, date timestamp_ntz, value_sum decimal(38,2), n_events long,"
            " n_late long, batch_id long")


def _anonymous() -> Column:
    """What an event without an id is known by; NULL for the others."""
    whole = F.to_json(F.struct(*[F.col(f.name) for f in EVENTS.fields]), {"ignoreNullFields": "false"})
    return F.when(F.col("event_id").isNull(), F.sha2(F.encode(whole, "UTF-8"), 256))


def _fresh(spark: SparkSession, batch: DataFrame, batch_id: int, out_dir: str) -> DataFrame:
    """One row for each event of the batch that no earlier batch has."""
    key = ["event_id", "anon", "day"]
    one = batch.groupBy("event_id", _anonymous().alias("anon"), F.col("ts").cast("date").alias("day")).agg(
        F.min(F.struct("ts", "event_type", "value")).alias("_e")).select(*key, "_e.*")
    if batch_id == 0:
        return one
    days = [r.day for r in one.select("day").distinct().collect()]           # bounded by the calendar
    of_days = F.col("day").isin([d for d in days if d is not None]) | (F.lit(None in days) & F.col("day").isNull())
    seen = spark.read.schema(IDS).parquet(f"{out_dir}/ids").filter((F.col("batch_id") < batch_id) & of_days).select(
        *[F.col(c).alias(f"_{c}") for c in key])
    return one.join(seen, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]), "left_anti")


def _write_sums(events: DataFrame, late: Column, batch_id: int, out_dir: str) -> None:
    (events.groupBy(F.lit("all").alias("entity_id"), F.col("event_type").alias("series_id"),
                    F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("date"))
     .agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("value_sum"),
          F.count(F.lit(1)).alias("n_events"), F.sum(F.coalesce(late, F.lit(False)).cast("long")).alias("n_late"))
     .write.mode("overwrite").parquet(f"{out_dir}/partials/batch_id={batch_id}"))


def start_hourly_updates(spark: SparkSession, source_glob: str, out_dir: str, lateness: str = "1 day",
                         max_files_per_trigger: int | None = None):
    """Start the stream (trigger ``availableNow``: process what has landed,
    then stop; the next start goes on from there). Returns the
    ``StreamingQuery``."""
    reader = spark.readStream.schema(EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        sp = Spool(own)
        fresh = sp.put(_fresh(own, batch, batch_id, out_dir))
        newest = None
        if batch_id:
            newest = partials(own, out_dir).filter(F.col("batch_id") < batch_id).agg(F.max("date")).first()[0]
        late = (F.col("ts") < F.lit(newest) - F.expr(f"INTERVAL {lateness}")) if newest else F.lit(False)
        fresh.select("event_id", "anon", "day").write.mode("overwrite").parquet(f"{out_dir}/ids/batch_id={batch_id}")
        _write_sums(fresh, late, batch_id, out_dir)
        sp.drop()

    return (reader.parquet(source_glob).writeStream.foreachBatch(upsert)
            .option("checkpointLocation", f"{out_dir}/_checkpoint")
            .trigger(availableNow=True).start())


def start_state_updates(spark: SparkSession, source_glob: str, out_dir: str, horizon: str = "2 days",
                        max_files_per_trigger: int | None = None):
    """As :func:`start_hourly_updates`, with the ids in the state store for the length of ``horizon``."""
    reader = spark.readStream.schema(EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    once = (reader.parquet(source_glob).filter("ts IS NOT NULL")
            .select("*", _anonymous().alias("anon"), F.col("ts").cast("timestamp").alias("event_time"))
            .withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(["event_id", "anon"]))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        _write_sums(batch, F.lit(False), batch_id, out_dir)
    return (once.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{out_dir}/_checkpoint")
            .trigger(availableNow=True).start())


def run_state_updates(spark: SparkSession, source_glob: str, out_dir: str, **options) -> dict[str, int]:
    """Runs what has landed to its end; (events, duplicates, rejected as late, ids left in the state) of the run."""
    q = start_state_updates(spark, source_glob, out_dir, **options)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    out = {"events": 0, "duplicates": 0, "rejected": 0, "ids": 0}
    for p in q.recentProgress:
        out["events"] += p["numInputRows"]
        for o in p["stateOperators"]:
            out["duplicates"] += o["customMetrics"].get("numDroppedDuplicateRows", 0)
            out["rejected"] += o["numRowsDroppedByWatermark"]
            out["ids"] = o["numRowsTotal"]
    return out


def _folder(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """Numbers in the names ``prefix<number>`` of a folder."""
    p, fs = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def partials(spark: SparkSession, out_dir: str) -> DataFrame:
    """The marked base, as batch ``upto``, and the partial sums of the batches after it."""
    parts = spark.read.schema(PARTIALS).parquet(f"{out_dir}/partials")
    done = _numbers(spark, f"{out_dir}/base", "done-")
    if not done:
        return parts
    base = spark.read.schema(parts.drop("batch_id").schema).parquet(f"{out_dir}/base/upto={done[-1]}")
    return parts.filter(F.col("batch_id") > done[-1]).unionByName(base.withColumn("batch_id", F.lit(done[-1]).cast("long")))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("entity_id", "series_id", "date").agg(*[F.sum(c).cast(t).alias(c) for c, t in SUMS])


def compact(spark: SparkSession, out_dir: str) -> None:
    """Fold the committed batches into a new base; call between runs."""
    commits = _numbers(spark, f"{out_dir}/_checkpoint/commits")
    done = _numbers(spark, f"{out_dir}/base", "done-")
    if commits and (not done or commits[-1] > done[-1]):
        last = commits[-1]
        _summed(partials(spark, out_dir).filter(F.col("batch_id") <= last)).write.mode("overwrite").parquet(
            f"{out_dir}/base/upto={last}")
        mark, fs = _folder(spark, f"{out_dir}/base/done-{last}")
        fs.create(mark, True).close()                      # from here on the new base counts
        done = [*done, last]
    if done:                                               # also clears what an earlier crash left behind
        for folder, prefix, end in (("partials", "batch_id=", done[-1] + 1), ("base", "done-", done[-1]), ("base", "upto=", done[-1])):
            for n in _numbers(spark, f"{out_dir}/{folder}", prefix):
                if n < end:
                    p, fs = _folder(spark, f"{out_dir}/{folder}/{prefix}{n}")
                    fs.delete(p, True)


def read_panel(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current panel = sum of all partial sums."""
    return _summed(partials(spark, out_dir)).select(
        "entity_id", "series_id", "date", F.col("value_sum").cast("double").alias("value"), "n_events", "n_late")


def run_updates(spark: SparkSession, source_glob: str, out_dir: str, **options) -> None:
    q = start_hourly_updates(spark, source_glob, out_dir, **options)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def hourly_panel_incremental(spark: SparkSession, sf_dir: str, state: bool = False) -> DataFrame:
    """Run the incremental job over the landed ``events`` table to completion
    and return the resulting panel (equal to the batch hourly view); the job's
    own files are removed once the panel is written. ``state``: ids in the state store."""
    out_dir = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    (run_state_updates if state else run_updates)(spark, f"{sf_dir.rstrip('/')}/events*.parquet", out_dir)
    compact(spark, out_dir)
    sp = Spool(spark)
    sp.append(out_dir)
    panel = sp.put(read_panel(spark, out_dir).drop("n_events", "n_late"))
    sp.drop(keep_last=1)
    return panel
