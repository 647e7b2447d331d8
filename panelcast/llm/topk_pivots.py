"""Exact top-k inner-product search by pivot-table elimination.

Components become integers, floor(scale * x). Every vector carries its
distances to some pivots: the origin, and vectors chosen farthest-first from a
bounded sample. By the triangle inequality |d(q, p) - d(x, p)| never exceeds
d(q, x); the maximum over the pivots bounds the distance from below and so the
score q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 from above.

1. **Table.** One pass computes the pivot distances; a range exchange by (length,
   nearest pivot, distance to it) puts near vectors into the same block, and the table is written.
2. **Seeds.** A query is a row of the table itself: its k-th best score within its own
   block is where its threshold starts.
3. **Elimination.** The queries pass over the table in chunks of bounded bytes, one broadcast
   each. A task skips a block whose pivot-distance intervals bound it below the
   threshold; elsewhere candidates are evaluated in bound order until the next bound
   is below the k-th best score so far, which stops exactly. A task emits at most k rows
   of a query, and only those that reach its threshold; the last step ranks them.

The pivots decide the cost alone, never a result. Scores are exact: in float64
below 2^53, in Python integers beyond; a score outside the range of a long
takes the nearest long.

Defined results: vectors that are null or hold a null or non-finite component (also
after scaling) take no part; vectors of different lengths never meet (an empty
vector scores 0 with other empty ones); rows that repeat a ``vec_id`` are queries and
candidates of their own, and only the query's own row is left out; a null
``vec_id`` is no query, and comes last among ties; fewer than k candidates give fewer
rows; an empty table gives an empty result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import map_batches, spool

PIVOTS = 24                   # besides the origin, for each vector length
SAMPLE = 4096                 # rows that pivots are chosen from
CHUNK_BYTES = 8 << 20         # of queries broadcast at once
CELLS = 1 << 20               # components of candidates taken at once
TILE = 64                     # queries whose bounds are held at once
STEPS = (128, 512, 2048)      # candidates of a block scored before the threshold is looked at again
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def by_length(col: pa.Array, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, scaled integral components as float64) of a list column without nulls."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, np.floor(scale * flat[start[at][:, None] + np.arange(dim)])


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """The origin, then rows of ``x`` farthest-first."""
    out, near = [np.zeros(x.shape[1])], (x ** 2).sum(1)
    while len(out) <= n and len(x):
        i = int(near.argmax())
        if not near[i] > 0:
            break
        out.append(x[i])
        near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
    return np.stack(out)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) as float32; overflow gives inf, which bounds nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1).astype(np.float32)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows with one integral vector, within the range of a long."""
    if not len(x) or not x.shape[1]:
        return np.zeros(len(x))
    if float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < EXACT:
        return x @ q
    ints = [int(v) for v in q]
    return np.array([max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(row, ints)))) for row in x], object)


def bound(dq: np.ndarray, dx: np.ndarray, q2: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """(queries, rows) upper bounds of the scores from distances to the same pivots,
    widened by more than the rounding of float32 distances."""
    low, gap = np.zeros((len(dq), len(dx)), np.float32), np.empty((len(dq), len(dx)), np.float32)
    across = np.ascontiguousarray(dx.T)
    with np.errstate(over="ignore", invalid="ignore"):
        for p in range(dq.shape[1]):
            np.subtract(dq[:, p, None], across[p][None, :], out=gap)
            np.fmax(low, np.abs(gap, out=gap), out=low)
        low -= np.float32(1e-6) * (dq.max(1, initial=0)[:, None] + dx.max(1, initial=0)[None, :])
        low = np.fmax(low, 0)
        out = ((q2[:, None] + x2[None, :]) * (1 + 1e-9) + 1 - low.astype(np.float64) ** 2) / 2
    return np.where(np.isnan(out), np.inf, out)


class Best:
    """The k best of one query: (-score, id is null, id, row) in ascending order."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor, self.rows = k, floor, []

    @property
    def least(self) -> float:
        """A candidate below this score cannot enter."""
        if len(self.rows) < self.k:
            return self.floor
        s = -self.rows[-1][0]
        return max(self.floor, s if abs(s) < EXACT else float(np.nextafter(float(s), -np.inf)))

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least)
        if not len(at):
            return
        s, z, i, u = scores[at], null[at], ids[at], uid[at]
        if s.dtype == object:
            order = sorted(range(len(at)), key=lambda j: (-s[j], z[j], i[j], u[j]))[:self.k]
        else:
            order = np.lexsort((u, i, z, -s))[:self.k]
        self.rows = sorted([*self.rows, *((-int(s[j]), bool(z[j]), int(i[j]), int(u[j])) for j in order)])[:self.k]


def evaluate(best: Best, q: np.ndarray, own: int, x: np.ndarray, ub: np.ndarray, null: np.ndarray,
             ids: np.ndarray, uid: np.ndarray) -> int:
    """Candidates in bound order until the next bound is below the k-th best, ``STEPS`` of them at a time and at last
    all that are left above it; returns how many were scored."""
    at = np.flatnonzero((ub >= best.least) & (uid != own))
    done, head = 0, sum(STEPS)
    if len(at) > head:
        at = at[np.argpartition(-ub[at], head)]
    at = np.concatenate([at[:head][np.argsort(-ub[at[:head]])], at[head:]])
    for step in STEPS:
        part = at[done:done + step]
        if not len(part) or ub[part[0]] < best.least:
            return done
        best.add(products(x[part], q), null[part], ids[part], uid[part])
        done += len(part)
    part = at[done:][ub[at[done:]] >= best.least]
    if len(part):
        scores = products(x, q)[part] if 2 * len(part) > len(x) else products(x[part], q)
        best.add(scores, null[part], ids[part], uid[part])
    return done + len(part)


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id is null, id or 0, row) of a batch."""
    vec = b.column(b.schema.get_field_index("vec_id"))
    return (vec.is_null().to_numpy(zero_copy_only=False), vec.fill_null(0).to_numpy(zero_copy_only=False),
            b.column(b.schema.get_field_index("uid")).to_numpy())


def _slices(b: pa.RecordBatch, scale: float, cut: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, row numbers, components, pivot distances), ``cut`` into pieces of at most ``CELLS`` components."""
    pd = b.column(b.schema.get_field_index("pd"))
    for dim, at, x in by_length(b.column(b.schema.get_field_index("embedding")), scale):
        d = pd.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
        step = max(1, CELLS // max(1, dim)) if cut else len(at)
        for s in range(0, len(at), step):
            yield dim, at[s:s + step], x[s:s + step], d[s:s + step]


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0,
           pivots: int = PIVOTS, sample: int = SAMPLE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every row for which
    ``is_query``, a condition on ``vec_id``, holds."""
    sp = spool(spark)
    kind = dict(vectors.dtypes)["embedding"]
    fits = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double") * F.lit(scale)) < F.lit(float("inf"))))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.monotonically_increasing_id().alias("uid"))
            .filter(F.col("embedding").isNotNull() & fits))
    n = rows.count()
    some = rows.select("embedding").sample(fraction=min(1.0, sample / max(n, 1)), seed=7).limit(2 * sample).toArrow()
    chosen = {}
    for part in (some.combine_chunks().to_batches() if n else []):
        chosen = {dim: choose_pivots(x, pivots) for dim, _, x in by_length(part.column(0), scale)}

    def measured(b: pa.RecordBatch) -> pa.RecordBatch:
        home, near = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.float32)
        length, many = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows + 1, np.int32)
        parts = []
        for dim, at, x in by_length(b.column(b.schema.get_field_index("embedding")), scale):
            d = distances(x, chosen.get(dim, np.zeros((1, dim))))
            own = d[:, 1:] if d.shape[1] > 1 else d
            length[at], home[at], near[at] = dim, own.argmin(1), own.min(1)
            many[at + 1] = d.shape[1]
            parts.append((at, d))
        start = np.cumsum(many, dtype=np.int32)
        flat = np.zeros(start[-1], np.float32)
        for at, d in parts:
            flat[start[at][:, None] + np.arange(d.shape[1])] = d
        return pa.record_batch([*b.columns, pa.array(length), pa.array(home), pa.array(near),
                                pa.ListArray.from_arrays(pa.array(start), pa.array(flat))],
                               [*b.schema.names, "dim", "home", "near", "pd"])
    order = ["dim", "home", "near", "vec_id", "uid"]
    index = sp.put(map_batches(rows, measured, f"vec_id long, embedding {kind}, uid long, dim int, home int, near float, "
                                               "pd array<float>")
                   .repartitionByRange(*order).sortWithinPartitions(*order)
                   .select("vec_id", "embedding", "uid", "dim", "pd", F.coalesce(is_query, F.lit(False)).alias("ask")))

    def seeded(b: pa.RecordBatch) -> pa.RecordBatch | None:
        null, ids, uid = _rows(b)
        ask = b.column(b.schema.get_field_index("ask")).to_numpy(zero_copy_only=False)
        floor = np.full(b.num_rows, -np.inf)
        for _, at, x, _ in _slices(b, scale):
            for i in np.flatnonzero(ask[at]):
                best = Best(k, -np.inf)
                best.add(np.delete(products(x, x[i]), i), *(np.delete(c[at], i) for c in (null, ids, uid)))
                floor[at[i]] = best.least
        return (b.append_column("floor", pa.array(floor)).filter(pa.array(ask)).select(
            ["vec_id", "embedding", "uid", "dim", "pd", "floor"]))
    queries = sp.put(map_batches(index, seeded, f"vec_id long, embedding {kind}, uid long, dim int, pd array<float>, floor double"))
    need = queries.agg(F.sum((F.col("dim") + pivots) * F.lit(8) + F.lit(400))).first()[0] or 0
    chunks = -(-need // chunk_bytes)
    found = []
    for c in range(chunks):
        asked = queries.filter(F.pmod(F.xxhash64(F.lit(13), "uid"), F.lit(chunks)) == c).toArrow().combine_chunks().to_batches()
        if asked:
            found.append(sp.put(_scan(spark, index, asked[0], k, scale)))
    out = found[0] if found else spark.createDataFrame([], FOUND)
    for f in found[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return (out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


FOUND = "query long, query_id long, vec_id long, uid long, score long"


def _scan(spark: SparkSession, index: DataFrame, asked: pa.RecordBatch, k: int, scale: float) -> DataFrame:
    """One pass of a chunk of queries over the table."""
    shared = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        _, query_id, query = _rows(asked)
        floor = asked.column(asked.schema.get_field_index("floor")).to_numpy()
        best = [Best(k, f) for f in floor]
        sets = {dim: (at, q, d, (q ** 2).sum(1)) for dim, at, q, d in _slices(asked, scale, cut=False)}
        for b in batches:
            null, ids, uid = _rows(b)
            for dim, at, x, dx in _slices(b, scale):
                if dim not in sets:
                    continue
                rows, q, dq, q2 = sets[dim]
                with np.errstate(over="ignore"):
                    x2 = (x ** 2).sum(1)
                least = np.array([best[r].least for r in rows])
                live = np.flatnonzero(_zone(dq, q2, dx, x2) >= least)
                for t in range(0, len(live), TILE):
                    part = live[t:t + TILE]
                    ub = bound(dq[part], dx, q2[part], x2)
                    for j, i in enumerate(part):
                        evaluate(best[rows[i]], q[i], query[rows[i]], x, ub[j], null[at], ids[at], uid[at])
        got = [(query[i], query_id[i], None if z else v, u, -s) for i, h in enumerate(best) for s, z, v, u in h.rows]
        if got:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*got)],
                                  ["query", "query_id", "vec_id", "uid", "score"])
    return index.select("vec_id", "embedding", "uid", "pd").mapInArrow(run, FOUND)


def _zone(dq: np.ndarray, q2: np.ndarray, dx: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Upper bounds of a whole block's scores from its intervals of pivot distances."""
    with np.errstate(over="ignore", invalid="ignore"):
        lo, hi = dx.min(0)[None, :], dx.max(0)[None, :]
        low = np.fmax(np.fmax(dq - hi, lo - dq) - np.float32(1e-6) * (dq + hi), 0).max(1, initial=0).astype(np.float64)
        out = ((q2 + x2.max()) * (1 + 1e-9) + 1 - low ** 2) / 2
    return np.where(np.isnan(out), np.inf, out)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
