"""Benchmark decontamination with suffix arrays over the training text.

Every Arrow batch of training documents is a shard. Its words become integer
ids in the vocabulary of the benchmark block (0: a word that no item has, which
ends every match). The positions whose next words can begin a benchmark window
are the shard's sparse suffix array: their suffixes, to the depth of a window,
sorted. Each benchmark suffix of that depth is found in it by binary search;
equal neighbours give all its places. Places that continue one another on the
same item are joined to the longest verbatim match.

The benchmark is the query set. It is read in blocks of ``BLOCK_WORDS`` words,
each broadcast on its own (a size that is checked by construction); the
documents take one map pass for each block, without a shuffle, and what was
found is carried along in their rows.

Defined results: null or empty text has no words and is never hit; an item of
fewer words than a window, but not none, is one window; items without an id
are left out; repeated item ids count once; repeated documents each keep their
row; empty tables give no hits; other columns pass through, and names beginning
with ``_dc_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import spool

WINDOW = 10
BLOCK_WORDS = 1_000_000
CACHE = 1 << 18                       # answers about keys that a task keeps
#: A-Z become lower case; bytes that are no letter, digit or part of a code point above U+007F become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
             for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass
class Depth:
    """Distinct suffix keys of one length, sorted, and who owns them."""
    depth: int
    keys: np.ndarray                  # big-endian words as bytes, so byte order is word order
    lead: np.ndarray                  # sorted distinct leading words (:func:`_lead`)
    first: np.ndarray                 # first owner of each key, and the total
    code: np.ndarray                  # owners by key, ascending: index of the item << 32 | place of the window in it
    cache: dict                       # what has been asked of the keys so far

    def owners(self, k: int) -> np.ndarray:
        return self.code[self.first[k]:self.first[k + 1]]

    def remembered(self, question: tuple, answer) -> list:
        got = self.cache.get(question)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[question] = answer()
        return got

    def items(self, k: int) -> list[int]:
        """Distinct items that hold a key."""
        return self.remembered(("i", k), lambda: np.unique(self.owners(k) >> 32).tolist())

    def begin(self, before: int, k: int) -> list[int]:
        """Owners of ``k`` that do not continue one of ``before`` (-1: no key), the key one place earlier."""
        own = self.owners(k)
        return self.remembered(("b", before, k), lambda: (
            own if before < 0 else own[~np.isin(own, self.owners(before) + 1)]).tolist())

    def end(self, k: int, after: int) -> list[int]:
        """Owners of ``k`` that are not continued by one of ``after``, the key one place later."""
        own = self.owners(k)
        return self.remembered(("e", k, after), lambda: (
            own if after < 0 else own[~np.isin(own, self.owners(after) - 1)]).tolist())


@dataclass
class Block:
    """Benchmark items prepared for the search of one pass."""
    ids: list                         # item ids
    vocabulary: dict                  # word -> 1, 2, ...
    depths: list[Depth]


def prepare(items: list[tuple], window: int) -> Block:
    """``items``: (item_id, text bytes). Depths are the window and the lengths
    of the items that are shorter."""
    vocabulary: dict[bytes, int] = {}
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for at, (_, text) in enumerate(items):
        ws = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        if ws:
            found.setdefault(min(window, len(ws)), []).append((at, np.array(ws, ">u4")))
    depths = []
    for depth, owners in sorted(found.items()):
        counts = [len(ws) - depth + 1 for _, ws in owners]
        grid = np.concatenate([np.lib.stride_tricks.sliding_window_view(ws, depth) for _, ws in owners])
        flat = grid.astype(">u4").view(f"S{4 * depth}").ravel()      # concatenate gives native byte order
        keys, which = np.unique(flat, return_inverse=True)
        order = np.argsort(which, kind="stable")
        item = np.repeat(np.array([at for at, _ in owners]), counts)
        position = np.concatenate([np.arange(c) for c in counts])
        depths.append(Depth(depth, keys, np.unique(_lead(grid.astype(np.int64), len(vocabulary))),
                            np.searchsorted(which[order], np.arange(len(keys) + 1)),
                            (item.astype(np.int64) << 32 | position)[order], {}))
    return Block([i for i, _ in items], vocabulary, depths)


def _lead(grid: np.ndarray, base: int) -> np.ndarray:
    """The first (up to) three words as one integer; used to thin out positions only."""
    out = np.zeros(len(grid), np.int64)
    for c in range(min(3, grid.shape[1])):
        out = out * np.int64(base + 1) + grid[:, c]      # wraps alike on both sides
    return out


def search(block: Block, tokens: np.ndarray) -> Iterator[tuple[Depth, np.ndarray, np.ndarray]]:
    """(depth, places in ``tokens``, key indices) of all occurrences."""
    n = len(tokens)
    wide = tokens.astype(np.int64)
    for at_depth in block.depths:
        depth, keys, lead = at_depth.depth, at_depth.keys, at_depth.lead
        if n < depth:
            continue
        m = n - depth + 1
        ok = np.flatnonzero((tokens[:m] > 0) & (tokens[depth - 1:n] > 0))
        if not len(ok):
            continue
        heads = np.zeros(len(ok), np.int64)
        for c in range(min(3, depth)):
            heads = heads * np.int64(len(block.vocabulary) + 1) + wide[ok + c]
        spot = np.minimum(np.searchsorted(lead, heads), len(lead) - 1)
        ok = ok[lead[spot] == heads]
        if not len(ok):
            continue
        suffixes = np.lib.stride_tricks.sliding_window_view(tokens, depth)[ok]
        suffixes = np.ascontiguousarray(suffixes.astype(">u4")).view(f"S{4 * depth}").ravel()
        order = np.argsort(suffixes, kind="stable")           # the suffix array
        array = suffixes[order]
        lo = np.searchsorted(array, keys, "left")             # binary search of every benchmark suffix
        count = np.searchsorted(array, keys, "right") - lo
        hit = np.flatnonzero(count)
        if len(hit):
            key = np.repeat(hit, count[hit])
            within = np.arange(len(key)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            place = ok[order[lo[key] + within]]
            yield at_depth, place, key


def longest(at: Depth, place: np.ndarray, key: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, item position, place, words) of the longest matches among ascending ``place`` with their ``key``.

    A match starts where an owner of a key does not continue one of the key before, and ends where none of
    the next continues it; starts and ends pair up along each diagonal. So a repetitive text costs its
    matches, not its places times the owners of their keys."""
    starts: list[tuple[int, int, int]] = []
    ends: list[tuple[int, int, int]] = []
    places, keys = place.tolist(), key.tolist()
    for i, (q, k) in enumerate(zip(places, keys)):
        before = keys[i - 1] if i and places[i - 1] == q - 1 else -1
        after = keys[i + 1] if i + 1 < len(keys) and places[i + 1] == q + 1 else -1
        starts += [(c >> 32, q - (c & 0xFFFFFFFF), q) for c in at.begin(before, k)]
        ends += [(c >> 32, q - (c & 0xFFFFFFFF), q) for c in at.end(k, after)]
    starts.sort()
    ends.sort()
    return [(item, q - diagonal, q, stop - q + at.depth) for (item, diagonal, q), (_, _, stop) in zip(starts, ends)]


def _pass(docs: DataFrame, block_at, window: int) -> DataFrame:
    """One block over all documents; ``_dc_spans`` and ``_dc_items`` grow."""
    carried = [c for c in docs.columns if not c.startswith("_dc_")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carried)
    schema += (", _dc_words long, _dc_spans array<struct<start: long, stop: long>>, _dc_items array<string>"
               ", _dc_longest array<struct<item: string, item_start: long, doc_start: long, words: long>>")
    names = [*carried, "_dc_words", "_dc_spans", "_dc_items", "_dc_longest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_at.value
        get = block.vocabulary.get
        for b in batches:
            pick = lambda name: b.column(b.schema.get_field_index(name))
            texts = pick("text").cast(pa.binary()).to_pylist()
            parts, starts, total = [], [], 0
            for t in texts:                                    # documents end with a 0
                ws = words_of(t)
                parts.append(ws)
                starts.append(total)
                total += len(ws) + 1
            tokens = np.fromiter((get(w, 0) for w in chain.from_iterable([*p, b""] for p in parts)),
                                 np.int32, total)
            bounds = np.array(starts)
            spans = [[(s["start"], s["stop"]) for s in x] for x in pick("_dc_spans").to_pylist()]
            items = [set(x) for x in pick("_dc_items").to_pylist()]
            full = [[tuple(m.values()) for m in x] for x in pick("_dc_longest").to_pylist()]
            hit = set()
            for at, place, key in search(block, tokens):
                order = np.argsort(place)
                place, key = place[order], key[order]
                doc = np.searchsorted(bounds, place, "right") - 1
                cut = np.flatnonzero(np.diff(doc)) + 1
                for d, q, k in zip(doc[np.r_[0, cut]].tolist(), np.split(place, cut), np.split(key, cut)):
                    q = q - bounds[d]
                    spans[d] += [(x, x + at.depth) for x in q.tolist()]
                    items[d].update(str(block.ids[i]) for x in np.unique(k).tolist() for i in at.items(x))
                    full[d] += [(str(block.ids[i]), p, x, w) for i, p, x, w in longest(at, q, k)]
                    hit.add(d)
            for d in hit:
                spans[d] = _union(spans[d])
            cols = [pick(c) for c in carried]
            yield pa.record_batch(
                [*cols, pa.array([len(p) for p in parts], pa.int64()),
                 pa.array([[{"start": s, "stop": e} for s, e in x] for x in spans],
                          pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                 pa.array([[dict(zip(("item", "item_start", "doc_start", "words"), m)) for m in x] for x in full],
                          pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()),
                                              ("doc_start", pa.int64()), ("words", pa.int64())])))], names)
    return docs.mapInArrow(run, schema)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, one block in the driver at a time."""
    rows = (benchmark.filter("item_id IS NOT NULL").select("item_id", F.encode("text", "UTF-8").alias("t"))
            .dropDuplicates())
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((r.item_id, bytes(r.t or b"")))
        held += len(words_of(block[-1][1]))
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def match(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted as strings),
    longest (array of the longest verbatim matches with their places) and
    contaminated."""
    sp = spool(spark)
    empty = F.array().cast("array<struct<start: long, stop: long>>")
    out = docs.withColumns({
        "_dc_words": F.lit(0).cast("long"), "_dc_spans": empty, "_dc_items": F.array().cast("array<string>"),
        "_dc_longest": F.array().cast("array<struct<item: string, item_start: long, doc_start: long, words: long>>")})
    n = 0
    for items in _blocks(benchmark, block_words):
        if n:
            out = sp.put(out)                    # the next block starts from a table
        out = _pass(out, spark.sparkContext.broadcast(prepare(items, window)), window)
        n += 1
    if not n:
        out = _pass(out, spark.sparkContext.broadcast(prepare([], window)), window)
    hit = F.aggregate("_dc_spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    added = {"n_words": F.col("_dc_words"), "n_hit": hit, "n_items": F.size("_dc_items").cast("long"),
             "items": F.col("_dc_items"), "longest": F.col("_dc_longest"), "contaminated": F.size("_dc_spans") > 0}
    return out.withColumns(added).drop("_dc_words", "_dc_spans", "_dc_items", "_dc_longest")


def remove_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame,
                        window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    return match(spark, docs, benchmark, window).filter("NOT contaminated").select(*docs.columns)


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k,
         array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p
        FROM iw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT x.doc_id, x.p, x.k, win.item_id
  FROM (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p
              FROM dw, ks WHERE len(w) >= k)) x
  JOIN win ON x.k = win.k AND x.s = win.s
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN its i ON d.doc_id = i.doc_id
"""
