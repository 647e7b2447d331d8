"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint is cut into m parts with thresholds t_1..t_m where
sum(t_i + 1) = D + 1 for a maximum distance D. Two fingerprints within D bits
must then agree up to t_i bits in at least one part i (t_i = -1 leaves a part
out). Bits that go together are placed in the same part, and the thresholds
are dealt by dynamic programming on the number of candidates that each choice
would give, estimated from bit statistics of all fingerprints.

A part with threshold t is probed through all ways to mask t of its bits:
fingerprints that differ in at most t bits of the part share a masked key.
Every candidate pair of a bucket is verified on all 64 bits; no pair is
emitted, only one edge from each row to the smallest member that its bucket
connects it to. Buckets above ``BLOCK`` rows are cut into sub-block pairs, so
a crowded key is dealt over many tasks and no pair is lost.

Documents with one fingerprint are one class from the start, so copies never
meet each other in a bucket.

Defined results: null or empty text has fingerprint 0 and links like any
other; fewer words than a shingle: the whole sequence is the only shingle; a
null ``doc_id`` takes its group's component (null if no member has an id) and
makes no link of its own; rows that repeat a ``doc_id`` each keep their row;
an empty table gives an empty result. :func:`keep_one` judges rows, not ids. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import (components, group_pairs, groups_of_sorted, map_batches, min_labels,
                                  split_hot, spool)
from panelcast.session import Spool

BITS = 64
NIBBLES = 16                  # the statistics know the bit order in groups of four
BLOCK = 2048
#: Part widths that are weighed against each other, in groups of four bits.
LAYOUTS = [[8, 8], [5, 5, 6], [4, 4, 4, 4], [3, 3, 3, 3, 4]]
ROW_COST = 60.0               # one bucket row, in pair verifications


# ---------------------------------------------------------- fingerprint

def fingerprint(text: bytes | None, k: int = 4, seed: int = 42) -> int:
    words = (text or b"").lower().split()        # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - k + 1)
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stops = ends[min(k, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, stops)], "<u8")
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        votes += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 4, carried: str | None = None) -> DataFrame:
    """(doc_id, fp long) of every row, and the long column ``carried``."""
    more = [] if carried is None else [carried]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, k) for t in b.column(1).cast(pa.binary()).to_pylist()]
        return pa.record_batch([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *more])
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", *more), run,
                       "doc_id long, fp long" + "".join(f", {c} long" for c in more))


# ----------------------------------------------------- statistics, plan

def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(fps: DataFrame, cells: int, count) -> np.ndarray:
    """Adds up ``count(fp array) -> cells`` over all rows: one vector for each task, then a small sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for b in batches:
            total += count(b.column(0).to_numpy())
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["cell", "n"])
    out = np.zeros(cells)
    for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(
            F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def bit_order(fps: DataFrame, n: int) -> list[int]:
    """Bits ordered so that each follows the one it is most correlated with."""
    def pairs(fp: np.ndarray) -> np.ndarray:
        b = _bits(fp).astype(np.float32)
        return (b.T @ b).astype(np.int64).ravel()
    both = _summed(fps, BITS * BITS, pairs).reshape(BITS, BITS) / max(n, 1)
    p = both.diagonal()
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both - np.outer(p, p)) / np.outer(sd, sd))
    order = [0]
    while len(order) < BITS:
        score = corr[order[-4:]].sum(0)
        score[order] = -1
        order.append(int(score.argmax()))
    return order


def distance_law(hist: np.ndarray) -> np.ndarray:
    """P(d bits differ) of two random rows in one group of four bits."""
    q = hist / max(hist.sum(), 1)
    k = np.arange(16)
    d = np.bitwise_count(k[:, None] ^ k[None, :])
    return np.array([(np.outer(q, q) * (d == i)).sum() for i in range(5)])


def choose_plan(laws: list[np.ndarray], n: int, max_bits: int) -> list[tuple[int, int, int]]:
    """The cheapest [(first group, groups, threshold)] over the layouts.

    For each layout, dynamic programming deals sum(t_i + 1) = max_bits + 1;
    cost = expected candidate pairs + bucket rows.
    """
    best: tuple[float, list[tuple[int, int, int]]] | None = None
    for layout in LAYOUTS:
        table = {0: (0.0, [])}                   # dealt so far -> cost, choice
        first = 0
        for groups in layout:
            law, w = np.ones(1), 4 * groups
            for g in range(first, first + groups):
                law = np.convolve(law, laws[g])
            nxt: dict[int, tuple[float, list]] = {}
            for t in range(-1, max_bits + 1):
                if t >= w:
                    break
                meets = sum(law[d] * comb(w - d, t - d) for d in range(t + 1))
                cost = 0.0 if t < 0 else n * n / 2 * meets + ROW_COST * n * comb(w, t)
                for s, (c, chosen) in table.items():
                    to = s + t + 1
                    if to <= max_bits + 1 and (to not in nxt or c + cost < nxt[to][0]):
                        nxt[to] = (c + cost, [*chosen, (first, groups, t)])
            table, first = nxt, first + groups
        if max_bits + 1 in table and (best is None or table[max_bits + 1][0] < best[0]):
            best = table[max_bits + 1]
    return [x for x in best[1] if x[2] >= 0]


def probe_masks(order: list[int], plan: list[tuple[int, int, int]]) -> list[int]:
    """The bits that each probe table keeps, as signed 64-bit masks."""
    masks = []
    for first, groups, t in plan:
        part = order[4 * first:4 * (first + groups)]
        for hidden in combinations(part, t):
            masks.append(sum(1 << b for b in part if b not in hidden))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


# ---------------------------------------------------------------- links

def _edges(buckets: DataFrame, max_bits: int) -> DataFrame:
    """One edge from each linked row to the smallest row of its bucket's component."""
    keys = ["tab", "key", "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of_sorted(batches, keys):
            cols = [t.column(k).to_numpy() for k in keys]
            fp, rep = t.column("fp").to_numpy(), t.column("rep").to_numpy()
            a, b = [], []
            for i, j in group_pairs(cols):
                near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= max_bits
                a.append(i[near])
                b.append(j[near])
            if not a or not sum(map(len, a)):
                continue
            lab = min_labels(len(fp), np.concatenate(a), np.concatenate(b))
            low = np.full(len(fp), np.iinfo(np.int64).max)
            np.minimum.at(low, lab, rep)
            out = np.unique(np.stack([rep, low[lab]], 1)[rep != low[lab]], axis=0)
            if len(out):
                yield pa.record_batch([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])
    return (buckets.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a long, b long"))


def link(spark: SparkSession, prints: DataFrame, max_bits: int = 4, sp: Spool | None = None) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp)."""
    sp = sp or spool(spark)
    classes = sp.put(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = classes.count()
    if not n:
        return prints.withColumn("component_id", F.lit(None).cast("long"))
    order = bit_order(classes, n)

    def nibbles(fp: np.ndarray) -> np.ndarray:
        b = _bits(fp)[:, order].reshape(-1, NIBBLES, 4)
        v = (b * np.array([1, 2, 4, 8], np.uint8)).sum(2, dtype=np.int64)
        return np.bincount((v + 16 * np.arange(NIBBLES)).ravel(), minlength=16 * NIBBLES)
    hist = _summed(classes, 16 * NIBBLES, nibbles).reshape(NIBBLES, 16)
    plan = choose_plan([distance_law(h) for h in hist], n, max_bits)
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for i, m in enumerate(probe_masks(order, plan))])
    rows = (classes.filter("rep IS NOT NULL").select("fp", "rep", F.explode(tables).alias("t"))
            .select("t.tab", "t.key", "fp", "rep"))
    near = components(_edges(split_hot(rows, ["tab", "key"], F.col("fp"), BLOCK, sp), max_bits), sp)
    merged = sp.put(classes.join(near, classes.rep == near.node, "left")
                    .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return prints.join(merged, "fp")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    sp = spool(spark)
    return link(spark, sp.put(fingerprints(docs, k)), max_bits, sp)


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` without the near copies: of each component the row with the smallest id stays, of rows that
    share it the first in the table's order. Every row is judged by its own fingerprint, so a
    different text under a repeated id is a row of its own; rows without an id are judged alike and come last."""
    sp = spool(spark)
    rows = sp.put(docs.withColumn("_sh_row", F.monotonically_increasing_id()))
    # the operator links rows, each under an id of its own
    prints = sp.put(fingerprints(rows.select(F.col("_sh_row").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("own")), k, "own"))
    linked = sp.put(link(spark, prints, max_bits, sp).select(F.col("doc_id").alias("row"), "own", "component_id"))
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "row")).alias("_f")).select(
        F.col("_f.row").alias("row"))
    gone = linked.join(first, "row", "left_anti").select(F.col("row").alias("_sh_row"))
    return rows.join(sp.put(gone), "_sh_row", "left_anti").select(*docs.columns)
