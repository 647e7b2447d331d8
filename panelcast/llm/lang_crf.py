"""Language identification with a linear-chain conditional random field.

Every word of a text is labelled by forward-backward; a document's language is
the label with the largest summed posterior, so code-switched text is labelled
word by word (:func:`tag`) and named by its main language (:func:`identify`).

Features of a word: all its n-grams of one to four bytes including the word's
borders (those at a border are the affixes), hashed into a weight table, and
the language of which the lexicon holds the whole word. Weights and
transitions are learned together by maximum likelihood on windows of words
from a bounded, stratified sample of labelled documents (``SAMPLE`` for each
language); windows of different languages are spliced, so transitions see
switches.

Prediction is vectorised: n-gram weights are summed per word by cumulative
sums, and the chain is cut into blocks of ``BLOCK`` words whose transfer
matrices are multiplied for all blocks at once; only the short chain of blocks
is sequential. It equals the plain recursion (tests/llm).

Defined results: ``und`` with score 0 for null text and text without letters;
without any labelled text every document is ``und``; ties go to the first
language in code point order; repeated rows each keep theirs; an empty table
gives an empty result; other columns pass through, names beginning with
``_li_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import sample_rows, spool

SAMPLE = 250                  # labelled documents for each language
WINDOW = 48                   # words of a training sequence
WINDOWS = 1_500
ROUNDS = 60
CELLS = 1 << 18               # hashed n-grams
NGRAMS = (1, 2, 3, 4)
LEXICON_MIN = 3               # times a word must occur, in one language nearly always
BLOCK = 32
PIECE = 1 << 20               # bytes whose emissions are computed at a time
LETTER = regex.compile(r"\p{L}")
#: Bytes of a word in lower-cased UTF-8: a-z and everything above U+007F.
IN_WORD = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])


# ------------------------------------------------------------ features

def find_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in a byte buffer."""
    edge = np.diff(np.concatenate(([0], IN_WORD[buf].view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ngram_cells(buf: np.ndarray) -> list[np.ndarray]:
    """For each n the table cell of the n-gram that starts at each byte of
    ``buf``, which must begin and end with a border; borders count as byte 0."""
    c = np.where(IN_WORD[buf], buf, 0).astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in NGRAMS:
        h = h[:len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:] + np.uint64(n)
        x = h ^ (h >> np.uint64(29))
        out.append(((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64))
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    idx = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    k = (idx - np.repeat(starts, size)).astype(np.uint64)
    mix = (buf[idx].astype(np.uint64) + np.uint64(1)) * (k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    mix ^= mix >> np.uint64(31)
    mix *= np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(mix, np.concatenate(([0], np.cumsum(size)[:-1])))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray            # (CELLS, L) float32
    lexicon: np.ndarray            # sorted word hashes
    lexicon_label: np.ndarray      # label index of each
    lexicon_weight: np.ndarray     # (L, L): row = lexicon label
    start: np.ndarray              # (L,)
    transition: np.ndarray         # (L, L) log weights

    def emissions(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, L) log weights of words in a buffer that begins and ends with a border."""
        out = np.zeros((len(starts), len(self.labels)))
        for n, cells in zip(NGRAMS, ngram_cells(buf)):
            run = np.zeros((len(cells) + 1, len(self.labels)))
            np.cumsum(self.weights[cells], axis=0, out=run[1:])
            out += run[np.maximum(ends - n + 2, starts - 1)] - run[starts - 1]
        if len(self.lexicon):
            h = word_hashes(buf, starts, ends)
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            known = self.lexicon[at] == h
            out[known] += self.lexicon_weight[self.lexicon_label[at[known]]]
        return out


# ------------------------------------------------------------- inference

def posteriors(e: np.ndarray, first: np.ndarray, start: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Forward-backward over many chains at once.

    ``e``: (words, L) emissions of all chains, one after another; ``first``:
    index of each chain's first word. Returns (words, L) marginals."""
    n, k = e.shape
    if not n:
        return np.zeros((0, k))
    t = np.exp(transition)
    length = np.diff(np.append(first, n))
    blocks = -(-length // BLOCK)
    head = np.concatenate(([0], np.cumsum(blocks)[:-1]))             # first block of each chain
    nb = int(blocks.sum())
    word = np.arange(n)
    chain = np.repeat(np.arange(len(first)), length)
    slot = head[chain] * BLOCK + word - first[chain]
    p = np.ones((nb * BLOCK, k))
    p[slot] = np.exp(e - e.max(1, keepdims=True))
    p = p.reshape(nb, BLOCK, k)
    real = np.zeros(nb * BLOCK, bool)
    real[slot] = True
    real = real.reshape(nb, BLOCK)
    opens = np.zeros(nb, bool)
    opens[head] = True                                               # their first word has no transition before it

    move = np.broadcast_to(np.eye(k), (nb, k, k)).copy()             # transfer matrix of each block
    for i in range(BLOCK):
        nxt = (move @ t) * p[:, i, None, :]
        if i == 0:
            nxt[opens] = move[opens] * p[opens, 0, None, :]
        nxt /= nxt.max((1, 2), keepdims=True)
        move = np.where(real[:, i, None, None], nxt, move)

    enter = np.zeros((nb, k))                                        # forward message into each block
    leave = np.ones((nb, k))                                         # backward message from behind each block
    enter[head] = np.exp(start)
    order = np.argsort(-blocks, kind="stable")
    for j in range(int(blocks.max()) - 1):
        live = order[:np.searchsorted(-blocks[order], -(j + 1), "left")]
        b = head[live] + j
        f = np.einsum("bi,bij->bj", enter[b], move[b])
        enter[b + 1] = f / f.max(1, keepdims=True)
        b = head[live] + blocks[live] - 1 - j
        g = np.einsum("bij,bj->bi", move[b], leave[b])
        leave[b - 1] = g / g.max(1, keepdims=True)

    post = np.empty((nb, BLOCK, k))
    f = enter
    for i in range(BLOCK):
        nxt = (f @ t) * p[:, i]
        if i == 0:
            nxt[opens] = f[opens] * p[opens, 0]
        nxt /= nxt.max(1, keepdims=True)
        f = np.where(real[:, i, None], nxt, f)
        post[:, i] = f
    g = leave
    for i in range(BLOCK - 1, -1, -1):
        post[:, i] *= g
        nxt = (p[:, i] * g) @ t.T
        nxt /= nxt.max(1, keepdims=True)
        g = np.where(real[:, i, None], nxt, g)
    post = post.reshape(-1, k)[slot]
    return post / post.sum(1, keepdims=True)


def text_posteriors(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list]:
    """(marginals of all words, first word of each text and the total, word spans by piece)."""
    e, spans, counts = [], [], []
    held: list[bytes] = []
    owner: list[int] = []

    def run() -> None:
        if not held:
            return
        buf = np.frombuffer(b" " + b" ".join(held) + b" ", np.uint8)
        starts, ends = find_words(buf)
        e.append(model.emissions(buf, starts, ends))
        at = np.concatenate(([1], 1 + np.cumsum([len(x) + 1 for x in held])))
        which = np.searchsorted(at, starts, "right") - 1
        for i, n in enumerate(np.bincount(which, minlength=len(held)).tolist()):
            counts[owner[i]] += n
        spans.append((starts - at[which], ends - at[which]))
        held.clear()
        owner.clear()

    size = 0
    for i, t in enumerate(texts):
        counts.append(0)
        raw = (t or "").lower().encode() if t and LETTER.search(t) else b""
        at = 0
        while at < len(raw):                                  # a long text goes in pieces cut between words
            stop = min(at + PIECE, len(raw))
            while stop < len(raw) and IN_WORD[raw[stop]]:
                stop += 1
            held.append(raw[at:stop])
            owner.append(i)
            size += stop - at
            at = stop
            if size >= PIECE:
                run()
                size = 0
    run()
    k = len(model.labels)
    all_e = np.concatenate(e) if e else np.zeros((0, k))
    counts = np.array(counts, np.int64)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    filled = firsts[:-1][counts > 0]
    return posteriors(all_e, filled, model.start, model.transition), firsts, spans


# --------------------------------------------------------------- learning

def learn(samples: list[tuple[str, str]], seed: int = 5, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood on spliced windows of (language, text) samples."""
    labels = sorted({lang for lang, _ in samples})
    k = len(labels)
    rng = np.random.default_rng(seed)
    docs: list[list[list[bytes]]] = [[] for _ in labels]
    uses: dict[bytes, np.ndarray] = {}
    for lang, text in samples:
        at = labels.index(lang)
        raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
        starts, ends = find_words(raw)
        words = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
        if words:
            docs[at].append(words)
        for w in set(words):
            uses.setdefault(w, np.zeros(k))[at] += 1
    # lexicon: words that several documents of one language use and hardly any of another
    lex = sorted((int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]), int(c.argmax()))
                 for w, c in uses.items() if c.max() >= LEXICON_MIN and c.max() >= 0.9 * c.sum())
    seqs, gold = [], []
    usable = [i for i in range(k) if docs[i]]
    for _ in range(WINDOWS):
        seq, lab = [], []
        while len(seq) < WINDOW:
            i = int(rng.choice(usable))
            words = docs[i][int(rng.integers(len(docs[i])))]
            a = int(rng.integers(len(words)))
            part = words[a:a + int(rng.integers(8, WINDOW + 1))][:WINDOW - len(seq)]
            seq += part
            lab += [i] * len(part)
        seqs += seq
        gold += lab
    gold = np.array(gold).reshape(WINDOWS, WINDOW)
    buf = np.frombuffer(b" " + b" ".join(seqs) + b" ", np.uint8)
    starts, ends = find_words(buf)
    cells, owner = [], []
    for n, c in zip(NGRAMS, ngram_cells(buf)):
        size = np.maximum(ends - starts + 3 - n, 0)
        first = np.repeat(starts - 1 - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        cells.append(c[first + np.arange(size.sum())])
        owner.append(np.repeat(np.arange(len(starts)), size))
    cells, owner = np.concatenate(cells), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    cells, owner = cells[order], owner[order]
    begin = np.searchsorted(owner, np.arange(len(starts)))
    used, cells = np.unique(cells, return_inverse=True)
    lex_h = np.array([h for h, _ in lex], np.uint64)
    lex_l = np.array([c for _, c in lex], np.int64)
    h = word_hashes(buf, starts, ends)
    at = np.minimum(np.searchsorted(lex_h, h), max(len(lex_h) - 1, 0))
    known = lex_h[at] == h if len(lex_h) else np.zeros(len(h), bool)
    row = np.where(known, lex_l[at] if len(lex_l) else 0, k)             # k: not in the lexicon

    params = [np.zeros((len(used), k)), np.zeros((k + 1, k)), np.zeros(k), np.zeros((k, k))]
    grads2 = [np.full_like(p, 1e-8) for p in params]
    one = np.eye(k)[gold.ravel()]
    total = WINDOWS * WINDOW
    for _ in range(rounds):
        w, lw, start, trans = params
        e = np.add.reduceat(w[cells], begin, axis=0) + lw[row]
        p, pair = _window_marginals(e.reshape(WINDOWS, WINDOW, k), start, trans)
        diff = (p.reshape(-1, k) - one) / total
        g = [np.stack([np.bincount(cells, diff[owner, c], len(used)) for c in range(k)], 1) + 1e-6 * w,
             np.stack([np.bincount(row, diff[:, c], k + 1) for c in range(k)], 1) + 1e-6 * lw,
             (p[:, 0] - one.reshape(WINDOWS, WINDOW, k)[:, 0]).mean(0),
             (pair - np.einsum("stc,std->cd", one.reshape(WINDOWS, WINDOW, k)[:, :-1],
                               one.reshape(WINDOWS, WINDOW, k)[:, 1:])) / total]
        g[1][k] = 0
        for q, gi, g2 in zip(params, g, grads2):
            g2 += gi * gi
            q -= 0.3 * gi / np.sqrt(g2)
    weights = np.zeros((CELLS, k), np.float32)
    weights[used] = params[0]
    return Model(labels, weights, lex_h, lex_l, params[1][:k], params[2], params[3])


def _window_marginals(e: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and summed pair marginals of equally long chains."""
    s, n, k = e.shape
    p, t = np.exp(e - e.max(2, keepdims=True)), np.exp(transition)
    a, b = np.empty_like(p), np.ones_like(p)
    a[:, 0] = np.exp(start) * p[:, 0]
    a[:, 0] /= a[:, 0].sum(1, keepdims=True)
    for i in range(1, n):
        a[:, i] = (a[:, i - 1] @ t) * p[:, i]
        a[:, i] /= a[:, i].sum(1, keepdims=True)
    pair = np.zeros((k, k))
    for i in range(n - 1, 0, -1):
        right = p[:, i] * b[:, i]
        both = a[:, i - 1, :, None] * t * right[:, None, :]
        pair += (both / both.sum((1, 2), keepdims=True)).sum(0)
        b[:, i - 1] = right @ t.T
        b[:, i - 1] /= b[:, i - 1].sum(1, keepdims=True)
    m = a * b
    return m / m.sum(2, keepdims=True), pair


# -------------------------------------------------------------- operators

def fit(spark: SparkSession, docs: DataFrame, train: Column, sample: int = SAMPLE) -> Model | None:
    """A model of the rows of ``docs`` for which ``train`` holds and ``lang`` is known."""
    spool(spark)
    known = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = sample_rows(known.select("doc_id", "lang", "text"), "lang", "doc_id", sample)
    got = sorted((r.doc_id, r.lang, r.text) for r in rows.collect() if LETTER.search(r.text))
    return learn([(lang, text) for _, lang, text in got]) if got else None


def identify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean posterior of that label over all words."""
    spool(spark)
    carried = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in carried)
    if model is None:
        return docs.select(*carried, "text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for big in batches:
            for b in (big.slice(i, 1000) for i in range(0, big.num_rows, 1000)):
                text = b.column(b.schema.get_field_index("text"))
                post, firsts, _ = text_posteriors(m, text.to_pylist())
                run_sum = np.concatenate((np.zeros((1, len(m.labels))), np.cumsum(post, axis=0)))
                n = np.diff(firsts)
                mean = (run_sum[firsts[1:]] - run_sum[firsts[:-1]]) / np.maximum(n, 1)[:, None]
                best = mean.argmax(1)
                score = np.clip(np.where(n > 0, mean.max(1), 0.0), 0.0, 1.0)
                pred = [m.labels[i] if c else "und" for i, c in zip(best.tolist(), n.tolist())]
                yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in carried), text,
                                       pa.array(pred, pa.string()), pa.array(score)],
                                      [*carried, "text", "lang_pred", "score"])
    return docs.select(*carried, "text").mapInArrow(run, schema + "text string, lang_pred string, score double")


def tag(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, word, position, lang, score) of every word: code-switched text word by word."""
    spool(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            post, firsts, _ = text_posteriors(m, texts)
            doc, words, pos = [], [], []
            for i, t in enumerate(texts):
                found = []
                if firsts[i + 1] > firsts[i]:
                    raw = np.frombuffer(b" " + t.lower().encode() + b" ", np.uint8)
                    found = [raw[x:y].tobytes().decode() for x, y in zip(*find_words(raw))]
                words += found
                doc += [i] * len(found)
                pos += range(len(found))
            yield pa.record_batch([b.column(0).take(pa.array(doc, pa.int64())), pa.array(words, pa.string()),
                                   pa.array(pos, pa.int64()),
                                   pa.array([m.labels[i] for i in post.argmax(1)], pa.string()),
                                   pa.array(post.max(1) if len(post) else np.zeros(0))],
                                  ["doc_id", "word", "position", "lang", "score"])
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, word string, position long, lang string, score double")
