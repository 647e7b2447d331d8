"""Embedding near-duplicates: iterative quantisation, multi-index Hamming
tables, rerank with the original vectors.

* **Fit.** On at most ``SAMPLE`` distinct vectors: centre, principal axes, and
  the rotations that iterative quantisation learns by alternating signs and an
  orthogonal Procrustes step. Every vector is coded in ``WORDS`` words of 64
  bits, each from a rotation with its own start.
* **Retrieve.** Each of T tables keeps s bits of one word; two vectors are
  candidates if they agree in one table. s and T are measured, not assumed:
  held-out vectors are moved to exactly the threshold, in random directions and
  towards other vectors, and coded; for each s, tables are added until both
  kinds of pairs are found at the recall aimed at, by all tables jointly. The
  cheapest s counts, by copies and by candidates of the sample's own vectors;
  s = 0, where every pair is compared, is always among the choices. The recall
  is an expectation over pairs exactly at the threshold (pairs above it differ
  less), not a guarantee for each pair.
* **Rerank.** Candidates are compared in their bucket by cosine of the
  original vectors in double precision. No pair leaves a bucket: only partial
  link counts and an edge from each vector to the smallest one that its bucket
  connects it to. A pair is counted in the first table where it meets.

Equal vectors are one class from the start. A crowded bucket is cut into
sub-block pairs (:func:`common.split_hot`), each a group of bounded size.

Vectors of each length have an index of their own; vectors of different lengths
never link.

Defined results: null, zero, and null- or non-finite-holding vectors link with
nothing (n_links 0, their own component); a null ``vec_id`` stays unlinked with a null component; rows
that repeat a ``vec_id`` each keep their row; an empty table gives an empty
result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import (components, group_pairs, groups_of_sorted, map_batches, min_labels,
                                  sample_rows, split_hot, spool)
from panelcast.session import Spool

SAMPLE = 20_000               # vectors that the rotation is learned on
ROUNDS = 30
BITS = 64
WORDS = 4                     # words of BITS bits in a code
BLOCK = 1024
RECALL = 0.999                # aimed at for pairs exactly at the threshold, by all tables jointly
PROBES = 8192                 # pairs of each kind that the recall is measured on
TABLES = 512                  # an s that needs more is not taken
COMPARE = 0.01                # cost of comparing a pair, in copies of a row


def fit_itq(x: np.ndarray, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): code = (v - mean) @ projection > 0, unit vectors in.
    A rotation gives one bit for each axis; vectors of fewer than ``BITS``
    dimensions get several rotations, each learned from its own start."""
    mean = x.mean(0)
    dim = x.shape[1]
    vecs = np.linalg.eigh(np.cov((x - mean).T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))[1]
    axes = vecs[:, ::-1][:, :min(BITS, dim)]
    v = (x - mean) @ axes
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < BITS:
        r = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            b = np.where(v @ r > 0, 1.0, -1.0)
            u, _, wt = np.linalg.svd(v.T @ b)
            r = u @ wt
        parts.append(axes @ r)
    return mean, np.concatenate(parts, axis=1)[:, :BITS]


def probe_pairs(x: np.ndarray, threshold: float, seed: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors exactly at the threshold: vectors of ``x`` moved in
    random directions, and towards other vectors of ``x``."""
    rng = np.random.default_rng(seed)
    a = x[rng.integers(0, len(x), PROBES)]
    out = []
    for e in (rng.normal(size=a.shape), x[rng.integers(0, len(x), PROBES)] - a):
        e = e - (e * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(e, axis=1, keepdims=True)
        b = threshold * a + np.sqrt(1 - threshold ** 2) * np.divide(e, size, out=np.zeros_like(e), where=size > 1e-9)
        out.append((a, b / np.linalg.norm(b, axis=1, keepdims=True)))
    return out


def encode(x: np.ndarray, fits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(rows, words) of signed 64-bit code words."""
    weights = np.array([1 << b for b in range(BITS)], np.uint64)
    return np.stack([((x - mean) @ proj > 0) @ weights for mean, proj in fits], 1).astype(np.uint64).view(np.int64)


def _cuts(bits: int, s: int, words: int, seed: int) -> Iterator[int]:
    """Signed masks of s bits, consecutive cuts of random bit orders; every word gets each in turn."""
    rng = np.random.default_rng(seed)
    queues: list[list[int]] = [[] for _ in range(words)]
    while True:
        for w in range(words):
            if len(queues[w]) < s:
                queues[w] = rng.permutation(bits).tolist()
            m = sum(1 << b for b in queues[w][:s])
            queues[w] = queues[w][s:]
            yield m - (1 << 64) if m >= 1 << 63 else m


def table_masks(bits: int, n: int, threshold: float, recall: float = RECALL, seed: int = 4,
                differ: list[np.ndarray] | None = None, codes: np.ndarray | None = None) -> list[int]:
    """Bit masks of the cheapest tables that find ``recall`` of every kind of
    pair; table t reads word t % words.

    ``differ``: for each kind, the differing bits (pairs, words) of pairs at the
    threshold; ``codes``: the code words of sample vectors. Without them, one
    word of independent bits is drawn."""
    rng = np.random.default_rng(seed)
    weights = np.array([1 << b for b in range(bits)], np.uint64)
    if differ is None:
        differ = [((rng.random((PROBES, bits)) < acos(threshold) / pi) @ weights).astype(np.uint64).view(np.int64)[:, None]]
    words = differ[0].shape[1]
    if codes is None:
        codes = ((rng.random((PROBES, words, bits)) < 0.5) @ weights).astype(np.uint64).view(np.int64)
    pairs = max(1, len(codes) * (len(codes) - 1))
    best, least = [0], 1 + n * COMPARE                                                  # s = 0: every pair meets
    for s in range(1, bits - 7):
        found = [np.zeros(len(d), bool) for d in differ]
        masks, crowd = [], []
        for t, m in enumerate(_cuts(bits, s, words, seed)):
            w = t % words
            if t < words:                               # the share of the sample's own pairs that meet in this table
                size = np.unique(codes[:, w] & m, return_counts=True)[1]
                crowd.append(max(float((size * (size - 1)).sum()) / pairs, 2.0 ** -s))
            cost = (t + 1) * (1 + n * COMPARE * sum(crowd) / len(crowd))
            masks.append(m)
            if cost >= least or t >= TABLES:
                break
            for f, d in zip(found, differ):
                f |= (d[:, w] & m) == 0
            if min(f.mean() for f in found) >= recall:
                best, least = masks, cost
                break
    return best


def unit(list_col: pa.Array, dim: int) -> np.ndarray:
    x = list_col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)              # squares of very large or small components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(dim: int):
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda v: v != 0)
    return F.col("embedding").isNotNull() & (F.size("embedding") == dim) & good & some


def _verify(buckets: DataFrame, dim: int, threshold: float, masks: list[int]) -> DataFrame:
    """(rep, links, root): partial link counts and one edge for each linked class."""
    keys = ["tab", "key", "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.array(masks, np.int64)
        for t in groups_of_sorted(batches, keys):
            t = t.combine_chunks()
            cols = [t.column(k).to_numpy() for k in keys]
            tab, gi, gj = cols[0], cols[2], cols[3]
            rep, n, own = (t.column(c).to_numpy() for c in ("rep", "n", "_b"))
            code = t.column("code").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
            x = unit(t.column("embedding").combine_chunks(), dim)
            links = np.zeros(len(rep), np.int64)
            a, b = [], []
            for i, j in group_pairs(cols, 1 << 16):
                near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[near], j[near]
                if not len(i):
                    continue
                a.append(i)
                b.append(j)
                first = (own[i] != own[j]) | (gi[i] == gj[i])
                differ = code[i] ^ code[j]
                for earlier in range(int(tab[i].max())):
                    first &= (tab[i] <= earlier) | ((differ[:, earlier % differ.shape[1]] & kept[earlier]) != 0)
                np.add.at(links, i[first], n[j[first]])
                np.add.at(links, j[first], n[i[first]])
            if not a:
                continue
            lab = min_labels(len(rep), np.concatenate(a), np.concatenate(b))
            low = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(low, lab, rep)
            root = low[lab]
            out = (links > 0) | (root != rep)
            yield pa.record_batch([pa.array(rep[out]), pa.array(links[out]), pa.array(root[out])],
                                  ["rep", "links", "root"])
    return (buckets.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "rep long, links long, root long"))


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95,
                    sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    sp = spool(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = rows.filter(F.size("embedding") > 0).select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()
    found = [m for r in sizes if (m := _index(rows, r.d, threshold, sample, sp)) is not None]
    return _result(rows, reduce(DataFrame.union, found) if found else None)


def _index(rows: DataFrame, dim: int, threshold: float, sample: int, sp: Spool) -> DataFrame | None:
    """(embedding, n_links, component_id) of the distinct valid vectors of one length, None if there are none."""
    classes = sp.put(rows.filter(_valid(dim) & F.col("vec_id").isNotNull()).groupBy("embedding")
                     .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    total = classes.count()
    if not total:
        return None
    fit = sample_rows(classes, None, "rep", sample).select("embedding").toArrow()
    fit = fit if fit.num_rows > 1 else classes.select("embedding").limit(2).toArrow()
    x = unit(fit.column("embedding").combine_chunks(), dim)
    held = x[-PROBES:]
    learned = x[:-PROBES] if len(x) >= 2 * PROBES else x           # few vectors are learned on and measured on
    fits = [fit_itq(learned, seed=3 + w) for w in range(WORDS)]
    masks = table_masks(BITS, total, threshold, codes=encode(held, fits),
                        differ=[encode(a, fits) ^ encode(b, fits) for a, b in probe_pairs(held, threshold)])

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        at = b.schema.get_field_index("embedding")
        words = encode(unit(b.column(at), dim), fits)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * WORDS), pa.array(words.ravel()))
        return pa.record_batch([*b.columns, lists], [*b.schema.names, "code"])
    coded = sp.put(map_batches(classes.select("embedding", "rep", "n"), code,
                               f"embedding {dict(rows.dtypes)['embedding']}, rep long, n long, code array<long>"))
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("code")[i % WORDS].bitwiseAND(F.lit(m)).alias("key"))
                       for i, m in enumerate(masks)])
    buckets = (coded.select("*", F.explode(tables).alias("t"))
               .select("t.tab", "t.key", "rep", "n", "code", "embedding"))
    found = sp.put(_verify(split_hot(buckets, ["tab", "key"], F.col("rep"), BLOCK, sp), dim, threshold, masks))
    near = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), sp)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    return sp.put(classes.join(links, "rep", "left").join(near, classes.rep == near.node, "left")
                  .select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                          F.coalesce("component", "rep").alias("component_id")))


def _result(rows: DataFrame, merged: DataFrame | None) -> DataFrame:
    if merged is None:
        rows = rows.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    else:
        named = rows.filter("vec_id IS NOT NULL").join(merged, "embedding", "left")
        rows = named.unionByName(rows.filter("vec_id IS NULL").withColumns(
            {"n_links": F.lit(0).cast("long"), "component_id": F.lit(None).cast("long")}))
    own = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                       own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * a.norm * b.norm
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links,
       min(r.b) AS component_id, min(r.b) = v.vec_id AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""
