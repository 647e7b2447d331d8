"""Exact grouped quantiles without gathering a group.

Equal values are counted first (a partial + final aggregate, so a value that
holds a large share of the rows is combined map-side). The distinct values are
range-partitioned by (group, value): a group of any size spreads over as many
tasks as its values need. A value's rank is its running count within its task
plus the counts of the group in earlier tasks, a small table. One path for
groups of every size; infinities are ordinary values, NULL and NaN are left
out. Interpolation follows ``percentile_cont`` / pandas ``describe``:
h = (n - 1) p.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import materialize


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Returns ``keys`` + one DOUBLE column ``q{int(p*100)}`` per probability."""
    keys = list(keys)
    clean = df.select(*keys, F.col(value).cast("double").alias("_v")) \
              .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # written once: a recomputed range exchange could cut its partitions elsewhere
    d = materialize(clean.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
                    .repartitionByRange(*keys, "_v").withColumn("_t", F.spark_partition_id()))
    in_task = Window.partitionBy("_t", *keys).orderBy("_v")
    group = Window.partitionBy(*keys)
    tasks = d.groupBy("_t", *keys).agg(F.sum("_c").alias("_tc")).select(
        "_t", *keys, F.sum("_tc").over(group).alias("_n"),
        F.coalesce(F.sum("_tc").over(group.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    r = d.withColumn("_in", F.sum("_c").over(in_task)).join(tasks, ["_t", *keys])
    r = r.withColumn("_hi", F.col("_in") + F.col("_before")).withColumn("_lo", F.col("_hi") - F.col("_c"))

    def at(rank):
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))
    aggs = []
    for p in probs:
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi, frac = at(F.floor(h)), at(F.ceil(h)), F.first(h - F.floor(h))
        infinite = F.greatest(F.abs(lo), F.abs(hi)) == F.lit(float("inf"))
        aggs.append(F.when((lo == hi) | (frac == 0), lo)
                    .when(infinite, lo * (F.lit(1.0) - frac) + hi * frac)
                    .otherwise(lo + (hi - lo) * frac).alias(f"q{int(round(p * 100))}"))
    return r.groupBy(*keys).agg(*aggs)
