"""Token counts by a map-side two-tier lookup.

The byte-level BPE never merges across pre-tokens, so a text has as many
tokens as its pre-tokens have together. Tier one is a broadcast table of the
lengths of frequent pre-tokens, chosen on a bounded sample of documents
(``SAMPLE``; it only decides what is looked up fast, never a result). Tier two
is a cache in each Python worker: a miss is encoded by the tokenizer once and
kept; the cache is emptied at ``CACHE`` entries. Pre-tokens are never shuffled.

Pre-tokens are cut by the tokenizer's published pattern where all characters
lie below U+0280; texts beyond that are cut by the library's own
pre-tokenizer, whose Unicode tables may differ from Python's.

Defined results: null or empty text: no bytes, no tokens; a special token's
string inside a text is that one token (the library's default); repeated rows
each keep theirs; other columns pass through, and n_bytes and n_tokens are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import sample_rows, spool

SAMPLE = 3_000                # documents that name the frequent pre-tokens
HOT = 50_000                  # entries of the broadcast table
CACHE = 400_000               # entries of a worker's own table
#: The published pre-token pattern of this byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BEYOND = regex.compile("[^\x00-ɿ]")
CUT = regex.compile(PATTERN)

_LOADED: dict[str, Lengths] = {}


class Lengths(dict):
    """Pre-token -> tokens; a missing one is encoded and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.hot: dict[str, int] = {}

    def warm(self, hot: dict[str, int]) -> None:
        if not self.hot:
            self.hot = hot
            self.update(hot)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE + len(self.hot):
            self.clear()
            self.update(self.hot)
        n = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n

    def pieces(self, text: str) -> Iterator[str]:
        if BEYOND.search(text):
            return (text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return iter(CUT.findall(text)) if len(text) < 1 << 20 else (m[0] for m in CUT.finditer(text))

    def parts(self, text: str) -> list[str]:
        return self.split.split(text) if self.split else [text]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)


def lengths(path: str) -> Lengths:
    """This worker's table for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Lengths(path)
    return _LOADED[path]


def frequent(docs: DataFrame, path: str, sample: int, hot: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = lengths(path), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for p in table.parts(t or ""):
                    seen.update(table.pieces(p))
        top = [(p, n) for p, n in seen.most_common(hot) if n > 1]
        yield pa.record_batch([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()),
                               pa.array([table[p] for p, _ in top], pa.int32())], ["piece", "n", "tokens"])
    all_n, length = Counter(), {}
    for r in sample_rows(docs, None, "doc_id", sample).select("text").mapInArrow(
            run, "piece string, n long, tokens int").toLocalIterator():
        all_n[r.piece] += r.n
        length[r.piece] = r.tokens
    return {p: length[p] for p, _ in all_n.most_common(hot)}


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, sample: int = SAMPLE, hot: int = HOT) -> DataFrame:
    """``docs`` with n_bytes and n_tokens. ``path``: a byte-level BPE file of
    the ``tokenizers`` library, at the same place on every machine."""
    spool(spark)
    table = spark.sparkContext.broadcast(frequent(docs, path, sample, hot))
    carried = [c for c in docs.columns if c not in ("n_tokens", "n_bytes", "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(path)
        own.warm(table.value)
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            counts = [own.count(t) if t else 0 for t in text.to_pylist()]
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in carried), text,
                                   pa.array(counts, pa.int64())], [*carried, "text", "n_tokens"])
    return (docs.select(*carried, "text").mapInArrow(run, f"{schema + ', ' if schema else ''}text string, n_tokens long")
            .withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
