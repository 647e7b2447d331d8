"""Incremental line dedup that can be reversed.

State, all of it tables in the shared folder:

* ``postings``: (h1, h2, doc_id), one row for each distinct line key of a document;
* ``refs``: (h1, h2, refs, lo, hi), the exact reference count of each key
  with its smallest and largest document;
* ``filters``: one cuckoo filter per shard of the keys that two or more
  documents hold now. A cuckoo filter can delete, which a Bloom filter can
  not, so removing documents needs no rebuild.

A line that its shard's filter does not know is certainly held by one
document only and stays without a look-up. The few that it knows (true
duplicates and a false-positive rate of about 2^-13) are settled exactly
against ``refs``.

Changes: an insert or a delete writes only the counts of the keys it touches; they stand above the rows they
replace, and deleted ids above their postings, until ``LAYERS`` such changes are written as one table. Earlier
rows are read, not rewritten.

Scale: the reference counts are one partial + final aggregate. Filters are
probed by cogrouping them with the postings of their shard, cut further by
measured row counts (a line that a third of all documents share spreads over
as many groups as its rows need, each with a copy of the shard's filter). The
exact check is a plain equi join that AQE may split.

Defined results: null or empty text is one empty line; keys shorter than
``min_chars`` are never dropped; rows with a null ``doc_id`` are neither
counted nor changed; rows that repeat a ``doc_id`` are one document when
counted and each keep their row; an empty table gives an empty result; other
columns pass through, and names beginning with ``_ld_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import map_batches, spool
from panelcast.session import Spool

SLOTS = 4                    # of a filter bucket
SHARD_KEYS = 1 << 16         # duplicated keys a shard is planned for
GROWN = 2                    # an index with so many times its planned keys is dealt into more shards
LAYERS = 8                   # changes kept as tables of their own before the index is written as one again
PROBE_ROWS = 1 << 18         # postings in one probe group
KEY = ["h1", "h2"]


# ------------------------------------------------------------ line keys

def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The compared form of a line, None if it is too short to count."""
    key = line.strip().lower()           # bytes: ASCII white space, A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def postings_of(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, digests = [], []
        for doc, text in zip(b.column(0).to_pylist(), _texts(b, "text")):
            keys = {line_key(x, min_chars) for x in (text or b"").split(b"\n")} - {None}
            digests += keys
            ids += [doc] * len(keys)
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return pa.record_batch([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()),
                                pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])
    return map_batches(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text"),
                       run, "h1 long, h2 long, doc_id long")


# -------------------------------------------------------- cuckoo filter

class CuckooFilter:
    """16-bit fingerprints in buckets of four, filled by vectorised rounds."""

    def __init__(self, table: np.ndarray):
        self.table = table                       # (buckets, SLOTS) uint16, 0 = free

    @staticmethod
    def sized(n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.85)))))
        return CuckooFilter(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def load(raw: bytes | None) -> CuckooFilter:
        return CuckooFilter.sized(0) if raw is None else CuckooFilter(
            np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _place(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints from the high bits of h2, buckets from its low ones: h1 has chosen the shard."""
        h = h2.view(np.uint64)
        return (h >> np.uint64(48)).astype(np.uint16) | np.uint16(1), (h & np.uint64(len(self.table) - 1)).astype(np.int64)

    def load_factor(self) -> float:
        return float((self.table > 0).mean())

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((fp.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fp, at = self._place(h1, h2)
        return ((self.table[at] == fp[:, None]) | (self.table[self._other(fp, at)] == fp[:, None])).any(1)

    def _fill(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots of the named buckets; returns what did not fit (mask)."""
        order = np.argsort(at, kind="stable")
        a = at[order]
        new = np.r_[True, a[1:] != a[:-1]]
        rank = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        free = self.table[a] == 0
        fits = rank < free.sum(1)
        slot = ((np.cumsum(free, 1) == rank[:, None] + 1) & free).argmax(1)
        self.table[a[fits], slot[fits]] = fp[order][fits]
        left = np.zeros(len(at), bool)
        left[order[~fits]] = True
        return left

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if the table is too full; the caller then rebuilds a larger one."""
        fp, at = self._place(h1, h2)
        rng = np.random.default_rng(7)
        left = self._fill(fp, at)
        fp, at = fp[left], self._other(fp[left], at[left])
        for _ in range(400):
            left = self._fill(fp, at)
            fp, at = fp[left], at[left]
            if not len(fp):
                return True
            _, one = np.unique(at, return_index=True)    # one eviction for each full bucket; what went moves on
            slot = rng.integers(0, SLOTS, len(one))
            out = self.table[at[one], slot].copy()
            self.table[at[one], slot] = fp[one]
            fp[one] = out
            at[one] = self._other(out, at[one])
        return False

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Removes one copy of each key's fingerprint; the keys must have been inserted."""
        fp, at = self._place(h1, h2)
        for f, i, j in zip(fp, at, self._other(fp, at)):
            for b in (i, j):
                hit = np.flatnonzero(self.table[b] == f)
                if len(hit):
                    self.table[b, hit[0]] = 0
                    break


def build_filter(h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
    n = len(h1)
    while True:
        f = CuckooFilter.sized(n)
        if f.insert(h1, h2):
            return f
        n = max(2 * n, 64)


# ---------------------------------------------------------------- state

@dataclass
class LineIndex:
    """The tables named above, the shard count they were made with, the number of keys that two or more documents
    hold, and how many changes stand above the last whole table."""
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    dups: int
    sp: Spool
    layers: int = 0


def _shard(shards: int):
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def _refs(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("lo"),
                                      F.max("doc_id").alias("hi"))


def _filters(dup: DataFrame, shards: int) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = build_filter(pdf.h1.to_numpy(), pdf.h2.to_numpy())
        return pd.DataFrame({"shard": pdf.shard.iloc[:1], "bits": [f.dump()]})
    return (dup.select(_shard(shards).alias("shard"), *KEY).groupBy("shard")
            .applyInPandas(build, "shard int, bits binary"))


def build(spark: SparkSession, docs: DataFrame, min_chars: int = 10) -> LineIndex:
    """The index of a first batch of documents."""
    sp = spool(spark)
    postings = sp.put(postings_of(docs, min_chars))
    refs = sp.put(_refs(postings))
    dups = refs.filter("lo <> hi").count()
    shards = max(1, -(-dups // SHARD_KEYS))
    filters = sp.put(_filters(refs.filter("lo <> hi"), shards))
    return LineIndex(postings, refs, filters, shards, dups, sp)


def _update_filters(index: LineIndex, refs: DataFrame, changed: DataFrame) -> DataFrame:
    """Filters after ``changed`` came: keys that became or ceased to be duplicates are inserted and deleted shard
    by shard. A shard that overflows is built anew from its own keys."""
    change = changed.filter("was <> now").select(*KEY, _shard(index.shards).alias("shard"), F.col("now").alias("add"))

    def apply(key, changes: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        if not len(changes):
            return bits
        f = CuckooFilter.load(bits.bits.iloc[0] if len(bits) else None)
        add = changes["add"].to_numpy(bool)
        h1, h2 = changes.h1.to_numpy(), changes.h2.to_numpy()
        f.delete(h1[~add], h2[~add])
        return pd.DataFrame({"shard": [key[0]], "bits": [f.dump() if f.insert(h1[add], h2[add]) else None]})
    filters = index.sp.put(change.groupBy("shard").cogroup(index.filters.groupBy("shard"))
                           .applyInPandas(apply, "shard int, bits binary"))
    full = filters.filter("bits IS NULL").select("shard")
    if full.isEmpty():
        return filters
    keys = refs.filter("lo <> hi").withColumn("shard", _shard(index.shards)).join(full, "shard", "left_semi")
    return index.sp.put(filters.filter("bits IS NOT NULL").unionByName(_filters(keys, index.shards)))


def _changed(index: LineIndex, postings: DataFrame, counts: DataFrame) -> LineIndex:
    """The index with the ``counts`` (h1, h2, refs, lo, hi, was) of touched keys in place of their earlier rows; a key
    without references is gone. ``was`` tells whether the key was a duplicate before."""
    changed = index.sp.put(counts.withColumn("now", F.expr("refs > 0 AND lo <> hi")))
    refs = index.refs.join(changed.select(*KEY), KEY, "left_anti").unionByName(
        changed.filter("refs > 0").select(*KEY, "refs", "lo", "hi"))
    layers = index.layers + 1
    if layers >= LAYERS:
        refs, postings, layers = index.sp.put(refs), index.sp.put(postings), 0
    dups = index.dups + changed.agg(F.coalesce(F.sum(F.col("now").cast("long") - F.col("was").cast("long")),
                                               F.lit(0))).first()[0]
    if dups > GROWN * index.shards * SHARD_KEYS:            # past its plan: more shards, filters from the exact counts
        shards = -(-dups // SHARD_KEYS)
        filters = index.sp.put(_filters(refs.filter("lo <> hi"), shards))
    else:
        shards, filters = index.shards, _update_filters(index, refs, changed)
    return LineIndex(postings, refs, filters, shards, dups, index.sp, layers)


def insert(index: LineIndex, docs: DataFrame, min_chars: int = 10) -> LineIndex:
    """Adds documents whose ids are new to the index. Earlier postings are not
    read: the batch's counts are added to those of its keys. An index that has outgrown its shards gets more of them."""
    batch = index.sp.put(postings_of(docs, min_chars))
    new = index.sp.put(_refs(batch))
    before = index.refs.join(new.select(*KEY), KEY, "left_semi").withColumn("was", F.expr("lo <> hi"))
    counts = before.unionByName(new.withColumn("was", F.lit(False))).groupBy(*KEY).agg(
        F.sum("refs").alias("refs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("was").alias("was"))
    return _changed(index, index.postings.unionByName(batch), counts)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Removes the documents named in column ``doc_id``; lines that they alone
    made duplicates come back at the next :func:`apply`. Only the keys of those
    documents are counted again. Ids that the index does not hold, and null ids, change nothing."""
    ids = index.sp.put(doc_ids.select(F.col("doc_id").cast("long")).distinct())
    touched = index.sp.put(index.postings.join(ids, "doc_id", "left_semi").select(*KEY).distinct())
    postings = index.postings.join(ids, "doc_id", "left_anti").select(*KEY, "doc_id")
    before = index.refs.join(touched, KEY, "left_semi").select(*KEY, F.expr("lo <> hi").alias("was"))
    counts = before.join(_refs(postings.join(touched, KEY, "left_semi")), KEY, "left").withColumn(
        "refs", F.coalesce("refs", F.lit(0)))
    return _changed(index, postings, counts)


# --------------------------------------------------------------- result

def _candidates(index: LineIndex, postings: DataFrame) -> DataFrame:
    """Postings that their shard's filter knows."""
    rows = postings.withColumn("shard", _shard(index.shards))
    salts = index.sp.put(rows.groupBy("shard").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(PROBE_ROWS))).cast("int").alias("salts")))    # a row for each shard
    rows = rows.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    bits = index.filters.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows, bits = rows.drop("salts"), bits.drop("salts")

    def probe(lines: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(bits):
            return lines.iloc[:0][["h1", "h2", "doc_id"]]
        known = CuckooFilter.load(bits.bits.iloc[0]).contains(lines.h1.to_numpy(), lines.h2.to_numpy())
        return lines.loc[known, ["h1", "h2", "doc_id"]]
    return (rows.groupBy("shard", "salt").cogroup(bits.groupBy("shard", "salt"))
            .applyInPandas(probe, "h1 long, h2 long, doc_id long"))


def apply(index: LineIndex, docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, plus ``n_lines``
    and ``n_dropped``. The documents must be in the index."""
    drops = (_candidates(index, index.postings)
             .join(index.refs.filter("lo <> hi").select(*KEY, "lo"), KEY)
             .filter("doc_id <> lo")
             .groupBy(F.col("doc_id").alias("_ld_id"))
             .agg(F.collect_list(F.struct("h1", "h2")).alias("_ld_drop")))
    joined = docs.join(drops, F.col("doc_id").cast("long") == F.col("_ld_id"), "left").drop("_ld_id")
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in others)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, lines_n, dropped_n = [], [], []
            for text, drop in zip(_texts(b, "text"), b.column(b.num_columns - 1).to_pylist()):
                lines = (text or b"").split(b"\n")
                if drop:
                    gone = {np.array([d["h1"], d["h2"]], "<i8").tobytes() for d in drop}
                    stay = [x for x in lines if line_key(x, min_chars) not in gone]
                else:
                    stay = lines
                kept.append(b"\n".join(stay).decode())
                lines_n.append(len(lines))
                dropped_n.append(len(lines) - len(stay))
            cols = [b.column(b.schema.get_field_index(c)) for c in others]
            yield pa.record_batch([*cols, pa.array(kept, pa.string()), pa.array(lines_n, pa.int64()),
                                   pa.array(dropped_n, pa.int64())], [*others, "text", "n_lines", "n_dropped"])
    return joined.select(*others, "text", "_ld_drop").mapInArrow(
        cut, f"{schema}, text string, n_lines long, n_dropped long")


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Builds the index of ``docs`` and applies it to them."""
    return apply(build(spark, docs, min_chars), docs, min_chars)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id <> c.keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (WHERE c.key IS NULL OR k.doc_id = c.keeper), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key
GROUP BY k.doc_id
"""
