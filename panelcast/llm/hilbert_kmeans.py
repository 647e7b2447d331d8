"""Exact centroid clustering over Hilbert-ordered blocks with zone maps.

Components become integers, floor(scale * x). Vectors are ordered along a Hilbert
curve through their main axes (fitted on a bounded sample; they decide the order,
never a result) by a range exchange, and cut into blocks of ``BLOCK`` rows. The first
row of a block carries its zone map, the smallest and largest value of each component.

A round takes the centroids (k rows) to every task. Over the box of a block,
|x - c_j|^2 - |x - c_i|^2 is linear in x, so its minimum is exact integer arithmetic:
where it is above zero for the centroid i nearest to the middle of the box, no vector
of the block can belong to j. Only the centroids that are left are compared, exactly and
vectorised. A task emits one row of count and sums for each centroid; their total (k rows)
gives the next centroids, componentwise floor(sum / count). Nothing but blocks of rows,
and k rows, is ever held; a run of equal vectors may be as long as it likes.

Defined results: only vectors of exactly ``dim`` components, none null or non-finite,
take part, each row as its own, also where a ``vec_id`` repeats. Components beyond
2^27 in size take that value, so that every squared distance fits a long.
Starting centroids are the kept vectors with the smallest hash of their id, ties by
components; a null ``vec_id`` starts none. With fewer than k such vectors there are fewer
centroids; with none every result column is null. An empty centroid stays. An empty table gives an
empty result. Sums over clusters take the largest long where they exceed it. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import map_batches, spool

BLOCK = 128                   # rows that share a zone map
SAMPLE = 4096                 # rows that the axes of the curve are fitted on
AXES = 8                      # axes of the curve
BITS = 8                      # bits of each axis; AXES * BITS = 64
TOP = float(1 << 27)
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows, axes) with ``bits`` bits
    each, as unsigned 64-bit integers: the bit-plane exchanges that undo the curve's
    reflections and rotations, a Gray decoding, then the planes interleaved."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(len(x)):
            flip = (x[i] & np.uint64(q)) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(flip, low, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << np.uint64(1)) | (((c ^ turn) >> np.uint64(b)) & np.uint64(1))
    return key


def fit_curve(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(axes, edges): the directions of largest variance and their quantile edges."""
    x = x[:SAMPLE]
    vecs = np.linalg.eigh(np.atleast_2d(np.cov((x - x.mean(0)).T)))[1] if len(x) > 1 else np.eye(x.shape[1])
    axes = vecs[:, ::-1][:, :AXES]
    return axes, np.quantile(x @ axes, np.arange(1, 1 << BITS) / (1 << BITS), axis=0)


def integers(col: pa.Array, scale: float, dim: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -TOP, TOP)


def candidates(lo: np.ndarray, hi: np.ndarray, cents: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to, or tie for, some point of the box."""
    c2 = (cents * cents).sum(1)
    mid = lo + hi                                              # twice the middle
    i = int((2 * c2 - 2 * (cents @ mid)).argmin())
    way = cents - cents[i]
    far = np.where(way > 0, hi, lo)                            # the corner that favours the other one most
    return np.flatnonzero(c2 - c2[i] - 2 * (way * far).sum(1) <= 0)


def nearest(x: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid, ties to the smaller number; exact."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ cents.T) + (cents * cents).sum(1)[None, :]
    near = d.argmin(1)
    return near, d[np.arange(len(x)), near]


class Assigner:
    """Assigns a stream of block-ordered batches; keeps the last zone map over a batch's end."""

    def __init__(self, cents: np.ndarray):
        self.cents, self.zone = cents, None
        self.compared = 0

    def assign(self, x: np.ndarray, lo: list, hi: list) -> tuple[np.ndarray, np.ndarray]:
        size = max(float(np.abs(x).max()), float(np.abs(self.cents).max())) if len(x) else 0.0
        kind = np.float64 if 8 * x.shape[1] * size * size < EXACT else np.int64
        x, cents = x.astype(kind), self.cents.astype(kind)
        number, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        starts = [i for i, z in enumerate(lo) if z is not None]
        for a, b in zip([0, *starts], [*starts, len(x)]):
            if a == b:
                continue
            if lo[a] is not None:
                self.zone = np.asarray(lo[a]), np.asarray(hi[a])
            zone = self.zone if self.zone is not None else (x[a:b].min(0), x[a:b].max(0))
            left = candidates(zone[0].astype(kind), zone[1].astype(kind), cents)
            self.compared += len(left) * (b - a)
            near, d = nearest(x[a:b], cents[left])
            number[a:b], dist[a:b] = left[near], d
        return number, dist


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list, list]]:
    for b in batches:
        if b.num_rows:
            comp = b.column(b.schema.get_field_index("comp")).flatten().to_numpy().reshape(-1, dim)
            zones = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lo", "hi")]
            yield b, comp.astype(np.float64), *zones


def blocks(spark: SparkSession, vectors: DataFrame, dim: int, scale: float, sp, block: int = BLOCK) -> DataFrame:
    """(vec_id, comp, lo, hi) of the kept vectors along the curve, written; ``lo`` and
    ``hi`` are set on the first row of each block."""
    good = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & good))
    n = rows.count()
    fit = rows.select("embedding").sample(fraction=min(1.0, SAMPLE / max(n, 1)), seed=8).limit(2 * SAMPLE).toArrow().combine_chunks()
    if not fit.num_rows:
        fit = rows.select("embedding").limit(1).toArrow().combine_chunks()
    x = integers(fit.column(0).combine_chunks(), scale, dim) if fit.num_rows else np.zeros((1, dim))
    axes, edges = fit_curve(x)

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch:
        x = integers(b.column(1), scale, dim)
        along = x @ axes
        cells = np.stack([np.searchsorted(edges[:, i], along[:, i]) for i in range(axes.shape[1])], 1)
        key = (hilbert_key(cells, BITS) ^ np.uint64(1 << 63)).view(np.int64)       # signed, in the same order
        return pa.record_batch([b.column(0), pa.array(key), _lists(x)], ["vec_id", "key", "comp"])
    order = ["key", "vec_id", "comp"]
    along = (map_batches(rows, keyed, "vec_id long, key long, comp array<int>")
             .repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "comp"))

    def zoned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            first = np.arange(0, len(x), block)
            lo, hi = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
            at = np.zeros(len(x) + 1, np.int32)
            at[first + 1] = dim
            at = np.cumsum(at, dtype=np.int32)
            none = np.ones(len(x), bool)
            none[first] = False
            yield pa.record_batch([*b.columns, *(pa.ListArray.from_arrays(pa.array(at), pa.array(z.ravel()), mask=pa.array(none))
                                                 for z in (lo, hi))], ["vec_id", "comp", "lo", "hi"])
    return sp.put(along.mapInArrow(zoned, "vec_id long, comp array<int>, lo array<int>, hi array<int>"))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]),
                                    pa.array(x.astype(np.int32).ravel()))


def first_centroids(table: DataFrame, k: int, salt: str) -> np.ndarray:
    h = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    got = (table.filter("vec_id IS NOT NULL").select(h.alias("h"), "comp").orderBy("h", "comp").limit(k).collect())
    return np.array([r.comp for r in got], np.int64)


def _totals(table: DataFrame, cents: np.ndarray, dim: int) -> dict[int, list[int]]:
    """Rows and component sums of each centroid in a round, [n, *sums]."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Assigner(cents)
        n, sums = np.zeros(len(cents), np.int64), np.zeros((len(cents), dim), np.int64)
        for _, x, lo, hi in _batches(batches, dim):
            number, _ = a.assign(x, lo, hi)
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            sums[own] += np.add.reduceat(x[order].astype(np.int64), first)
            n += np.bincount(number, minlength=len(cents))
        at = np.flatnonzero(n)
        if len(at):
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at]),
                                   pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim),
                                                            pa.array(sums[at].ravel()))], ["cluster", "n", "sums"])
    parts = table.select("comp", "lo", "hi").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = (parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "v"))
             .groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")))
    out: dict[int, list[int]] = {}
    for r in total.collect():                                  # at most k * (dim + 1) numbers
        out.setdefault(r.cluster, [0] * (dim + 1))[r.at] = int(r.v)
    return out


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0,
            salt: str = "2:", block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every kept row, final centroids)."""
    sp = spool(spark)
    table = blocks(spark, vectors, dim, scale, sp, block)
    cents = first_centroids(table, k, salt)
    if not len(cents):
        return table.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    for _ in range(rounds):
        for i, (n, *sums) in _totals(table, cents, dim).items():
            cents[i] = [s // n for s in sums]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Assigner(cents)
        for b, x, lo, hi in _batches(batches, dim):
            number, dist = a.assign(x, lo, hi)
            yield pa.record_batch([b.column(0), pa.array(number.astype(np.int32)), pa.array(dist)],
                                  ["vec_id", "cluster", "distance"])
    return table.mapInArrow(final, "vec_id long, cluster int, distance long"), cents.tolist()


def summarise(spark: SparkSession, assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 to every row."""
    assigned = spool(spark).put(assigned)
    total = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    own = {r.cluster: int(r.s) for r in total if r.cluster is not None}
    rows = [(i, min(own[i], LONG), min(sum(own.values()), LONG), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
            for i, c in enumerate(centroids) if i in own]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster", "left").select(            # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    rounds = []
    for r in range(1, 7):
        rounds.append(f"""a{r} AS (
  SELECT v.id, v.e, arg_min(c.i, (list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.i)) AS i
  FROM v, c{r - 1} c GROUP BY v.id, v.e
)""")
        rounds.append(f"""c{r} AS (
  SELECT c.i, coalesce(m.e, c.e) AS e FROM c{r - 1} c LEFT JOIN (
    SELECT i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS e FROM (
      SELECT i, p, sum(x) AS s, count(*) AS n FROM (
        SELECT i, unnest(e) AS x, unnest(range(1, 65)) AS p FROM a{r}) GROUP BY i, p) GROUP BY i) m USING (i)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS i, e FROM (
    SELECT sha256('2:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT 40)
), {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in rounds[:-1])},
f AS (
  SELECT v.vec_id, a.i, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d,
         sha256(array_to_string(c.e, ',')) AS h
  FROM a6 a JOIN v USING (id) JOIN c5 c USING (i)
)
SELECT vec_id, CAST(i AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY i) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM f
"""


ORACLE = _oracle()
