"""Mixing sources to target weights with nested hash-threshold histograms.

Every document has a 60-bit hash of its id. A source takes all its documents
``floor(target / size)`` times and once more those whose hash lies under the
source's threshold. The threshold is found without sorting: words are summed
by source and the top 12 hash bits, the bucket in which the running sum passes
the budget is refined by the next 12 bits, and so on, until the boundary bucket
holds a single hash value, which goes in if that comes nearer to the budget.
At most five levels; each is one partial + final aggregate over the rows of the
boundary buckets only, so a source with a third of all rows is combined
map-side like any other.

DataFrame functions only.

Defined results: null or empty text has size 0; a null source is a source of
its own, last in order; a null ``doc_id`` hashes as the empty string; rows that
repeat a ``doc_id`` share its fate; sources without words get target 0; an
empty table gives an empty result; other columns pass through (those named
size, source_size, target, taken are replaced), and names beginning with
``_mx_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import spool
from panelcast.session import Spool

STEP = 12                     # hash bits of a level
LEVELS = 5
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with size and the id hash."""
    md5 = F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    return docs.withColumns({
        "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "_mx_hash": F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")})


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): ``share`` of
    all words by weight; sources whose part exceeds ``cap`` times their size
    stop there and the excess goes to the others. One row for each source."""
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_r", rank).withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    # in the order of cap / weight the sources that stop come first
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_r").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "_i": F.row_number().over(Window.orderBy(F.col("_cap") / F.col("_w"), "_r")),
        "_level": (F.sum("source_size").over(every) * F.lit(float(share))
                   - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))})
    stops = F.col("_level") * F.col("_w") >= F.col("_cap")
    first = F.min(F.when(~stops, F.struct("_i", "_level"))).over(every)
    return s.withColumn("_open", first).select(
        "source", "source_size",
        F.when(F.col("_open").isNull() | (F.col("_i") < F.col("_open._i")), F.col("_cap"))
        .otherwise(F.col("_open._level") * F.col("_w")).alias("target"))


def thresholds(rows: DataFrame, goal: DataFrame, sp: Spool) -> DataFrame:
    """(source, source_size, target, _mx_times, _mx_cut) from rows of (source, size, _mx_hash)."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = sp.put(goal.withColumn("_mx_times", times.cast("long")).withColumns({
        "_budget": F.col("target") - F.col("_mx_times") * F.col("source_size"),
        "_base": F.lit(0).cast("long"), "_prefix": F.lit(0).cast("long"), "_mx_cut": F.lit(None).cast("long")}))
    for level in range(LEVELS):
        shift = STEP * (LEVELS - 1 - level)
        still = state.filter("_mx_cut IS NULL")
        if still.isEmpty():
            break
        inside = rows.alias("d").join(
            still.select(F.col("source").alias("_s"), "_prefix"),
            F.col("d.source").eqNullSafe(F.col("_s")) & (F.shiftright("_mx_hash", shift + STEP) == F.col("_prefix")))
        hist = inside.groupBy("source", F.shiftright("_mx_hash", shift).alias("_bucket")).agg(
            F.sum("size").alias("_n"), F.min("_mx_hash").alias("_lo"), F.max("_mx_hash").alias("_hi"))
        hist = hist.select(F.col("source").alias("_s"), "_bucket", "_n", "_lo", "_hi",
                           F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket")).alias("_sum"))
        both = still.join(hist, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
            "_after", F.col("_base") + F.col("_sum")).withColumn("_before", F.col("_after") - F.col("_n"))
        edge = (F.col("_before") < F.col("_budget")) & (F.col("_budget") < F.col("_after"))
        found = both.groupBy("source").agg(
            F.max(F.when(edge, F.struct("_bucket", "_before", "_after", "_lo", "_hi"))).alias("_edge"),
            F.max(F.when(F.col("_after") <= F.col("_budget"), F.col("_bucket"))).alias("_full"))
        e = F.col("_edge")
        nearer = e["_before"] + e["_after"] <= 2 * F.col("_budget")
        cut = (F.when(F.col("_mx_cut").isNotNull(), F.col("_mx_cut"))
               .when(e.isNull(), F.shiftleft(F.coalesce(F.col("_full") + 1, F.shiftleft("_prefix", STEP)), shift))
               .when(e["_lo"] == e["_hi"], F.when(nearer, e["_lo"] + 1).otherwise(e["_lo"])))
        state = sp.put(state.join(found.withColumnRenamed("source", "_s"),
                                  F.col("source").eqNullSafe(F.col("_s")), "left")
                       .select("source", "source_size", "target", "_mx_times", "_budget",
                               F.coalesce(e["_before"], F.col("_base")).alias("_base"),
                               F.coalesce(e["_bucket"], F.col("_prefix")).alias("_prefix"),
                               cut.alias("_mx_cut")))
    return state.select("source", "source_size", "target", "_mx_times", "_mx_cut")


def mix_sized(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
              cap: float = 2.0) -> DataFrame:
    """As :func:`mix` for documents that :func:`sized` has seen."""
    sp = spool(spark)
    docs = docs.drop("source_size", "target", "taken")
    rows = sp.put(docs.select("source", "size", "_mx_hash"))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    per = thresholds(rows, goal, sp).withColumnRenamed("source", "_mx_source")
    times = F.col("_mx_times") + (F.col("_mx_hash") < F.col("_mx_cut")).cast("long")
    return (docs.join(per, docs.source.eqNullSafe(per._mx_source), "left")
            .withColumn("taken", F.col("size") * times)
            .drop("_mx_source", "_mx_times", "_mx_cut", "_mx_hash"))


def mix(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
        cap: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target and taken.

    Sources in code point order weigh ``weights``, repeating, and share
    ``share`` of all words, none above ``cap`` (at most 2) times its size."""
    return mix_sized(spark, sized(docs), weights, share, cap)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, r) AS i,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER p, 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS lvl
  FROM s WINDOW p AS (ORDER BY 2.0 * source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT min(i) AS i0 FROM o WHERE lvl * w < 2.0 * source_size),
t AS (
  SELECT o.source, o.source_size,
         CASE WHEN i0 IS NULL OR i < i0 THEN 2.0::DOUBLE * source_size
              ELSE (SELECT lvl FROM o o2 WHERE o2.i = i0) * w END AS target
  FROM o, f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t
), v AS (
  SELECT d.source, h, sum(size) AS n FROM d GROUP BY d.source, h
), c AS (
  SELECT v.source, v.h, 2 * sum(n) OVER (PARTITION BY v.source ORDER BY h) - n AS twice FROM v
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.times + CASE WHEN c.twice <= 2 * (b.target - b.times * b.source_size) THEN 1 ELSE 0 END)
            AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
