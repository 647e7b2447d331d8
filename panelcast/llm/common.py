"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import Spool, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spool(spark: SparkSession) -> Spool:
    """A place for intermediate tables; also gives the workers this package."""
    ship_package(spark)
    return Spool(spark)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def doc_mod(c: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % F.lit(n)


def shielded(docs: DataFrame, needed: Sequence[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn(docs)`` where only the ``needed`` columns keep their names, so a
    column that happens to be named like one of an operator's own comes through
    unchanged. Returns the columns of ``docs``."""
    names = {c: c if c in needed else f"_x{i}" for i, c in enumerate(docs.columns)}
    out = fn(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None],
                schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch (or none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield from (out.to_batches() if isinstance(out, pa.Table) else [out])
    return df.mapInArrow(run, schema)


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes by the edges (a, b):
    minimum propagation along the edges with pointer jumping."""
    lab = np.arange(n)
    while len(a):
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], m)
        np.minimum.at(new, lab[b], m)
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, lab):
            break
        lab = new
    return lab


def groups_of_sorted(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Re-cuts a stream sorted by ``keys`` so that each group lies in one table.

    Yields tables of many whole groups each; the open group at the end of a
    batch is held back. A table is as large as one batch plus its largest
    group, so callers bound their groups first (:func:`split_hot`).
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held:
            last = held[-1]
            same = all(last.column(last.schema.get_field_index(k))[-1].as_py() == c[0]
                       for k, c in zip(keys, cols))
            if not same and cut == 0:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def group_pairs(keys: Sequence[np.ndarray], max_pairs: int = 1 << 20
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of rows with equal keys in key-sorted arrays.

    The pairs at row distance 1, 2, 3, ... come as vectors, so many small
    groups cost as little as one large one; at most ``max_pairs`` at a time.
    """
    n = len(keys[0])
    if n < 2:
        return
    change = np.ones(n, bool)
    same = np.ones(n - 1, bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    change[1:] = ~same
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, n))
    end = np.repeat(start + size, size)          # one past each row's group
    rows = np.arange(n)
    held_i: list[np.ndarray] = []
    held_j: list[np.ndarray] = []
    held = 0
    shift = 1
    while True:
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            break
        held_i.append(rows)
        held_j.append(rows + shift)
        held += len(rows)
        if held >= max_pairs:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held_i, held_j, held = [], [], 0
        shift += 1
    if held:
        yield np.concatenate(held_i), np.concatenate(held_j)


def split_hot(rows: DataFrame, keys: Sequence[str], member: Column, block: int,
              sp: Spool) -> DataFrame:
    """Bounds the groups of a bucket table without losing a pair.

    A bucket of more than ``block`` rows is cut into sub-blocks by a hash of
    the member; each pair of sub-blocks becomes a group of its own (columns
    ``_i``, ``_j``), so any two members still meet. Small buckets get (0, 0).
    ``_b`` is the row's own sub-block: two rows of one sub-block meet in
    several groups, of which ``_i = _j`` is the first.
    """
    hot = sp.put(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
                 .select(*keys, F.ceil(F.col("_n") / F.lit(float(block))).cast("int").alias("_nb")))
    if hot.isEmpty():
        return rows.withColumns({"_b": F.lit(0), "_i": F.lit(0), "_j": F.lit(0)})
    b = F.pmod(F.xxhash64(F.lit(11), member), F.col("_nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_nb"), F.lit(1)) - 1))
    return (rows.join(hot, list(keys), "left")
            .withColumn("_b", F.coalesce(b, F.lit(0))).withColumn("_o", other)
            .withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
            .drop("_o", "_nb"))


def components(edges: DataFrame, sp: Spool, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list with orderable ids.

    Alternating large-star and small-star steps, each a partial + final MIN
    and one join back, written to the shared folder. The neighbours of a node
    are never gathered; a hot centre's rows only meet its one minimum, and
    both join sides are plain exchanges that AQE may split. Returns (node,
    component) for every node that occurs in an edge, component = its
    smallest member. Raises if the rounds do not suffice.
    """
    sp = Spool(sp.spark)             # its tables go as soon as the next round is written
    e = sp.put(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
               .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = sp.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = sp.put(both.join(least, "u").filter("v > u and v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct())     # u > v now
        least = sp.put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
                 .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        e = sp.put(small)
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        sp.drop(keep_last=1)
        if seen == mark:
            return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
                e.select(F.col("u"), F.col("u")).distinct())
        mark = seen
    raise RuntimeError("components did not settle")


def sample_rows(df: DataFrame, by: str | None, key: str, n: int) -> DataFrame:
    """About ``n`` rows (per value of ``by``) with the smallest id hashes: a
    count, then a hash threshold with a small margin; never a sort. The bound
    is the caller's documented parameter for fitting a model."""
    h = F.pmod(F.xxhash64(F.lit(5), F.col(key)), F.lit(1 << 30))
    if by is None:
        total = df.count()
        return df.filter(h < int(min(1.0, n / max(total, 1)) * (1 << 30)))
    keep = F.lit(False)
    for r in df.groupBy(by).count().collect():      # one row per class
        keep = keep | ((F.col(by) == r[by]) & (h < int(min(1.0, n / r["count"]) * (1 << 30))))
    return df.filter(keep)
