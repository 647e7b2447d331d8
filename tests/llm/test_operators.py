"""Each operator against a brute-force version on small tables: nulls, empty
and long texts, ties, repeated rows, clashing column names, empty tables."""

import hashlib
import html
import random
import re
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelcast.llm import (chat_format, decontaminate, embed_dedup, html_extract, lang_crf, line_dedup, mix_sources,
                           quality_rules, queries, simhash_dedup, token_count)
from panelcast.llm.common import components, group_pairs, groups_of_sorted, min_labels, split_hot
from panelcast.session import Spool

DOCS = "doc_id long, text string"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, con, small, name):
    got = queries.QUERIES[name](spark, small)
    rel = con.sql(queries.ORACLES[name])
    assert got.columns == list(rel.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rel.fetchall()))


# ---------------------------------------------------------------- helpers

def test_min_labels_and_group_pairs():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, 25), rng.integers(0, n, 25)
        lab = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                lab[x] = lab[y] = min(lab[x], lab[y])
        assert min_labels(n, a, b).tolist() == lab
        k = np.sort(rng.integers(0, 6, n))
        got = {(i, j) for p, q in group_pairs([k], 8) for i, j in zip(p.tolist(), q.tolist())}
        assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if k[i] == k[j]}


def test_groups_stay_whole_over_batches():
    import pyarrow as pa
    keys = np.sort(np.random.default_rng(1).integers(0, 9, 100))
    batches = [pa.record_batch([pa.array(keys[i:i + 7])], ["k"]) for i in range(0, 100, 7)]
    seen = [sorted(set(t.column("k").to_pylist())) for t in groups_of_sorted(iter(batches), ["k"])]
    assert sum(seen, []) == sorted(set(keys.tolist()))


def test_split_hot_lets_all_pairs_meet(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 1), ("x", 2)], "k string, v long")
    got = split_hot(rows, ["k"], F.col("v"), 8, Spool(spark)).toPandas()
    assert got.groupby(["k", "_i", "_j"]).size().max() < 40
    met = {(k, a, b) for (k, _, _), g in got.groupby(["k", "_i", "_j"]) for a in g.v for b in g.v if a < b}
    assert met == {("hot", a, b) for a in range(50) for b in range(a + 1, 50)} | {("x", 1, 2)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 201), (203, 205)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Spool(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {201: 201, 203: 201, 205: 201}
    assert components(spark.createDataFrame([], "a long, b long"), Spool(spark)).count() == 0


# -------------------------------------------------------------- line dedup

LINES = [(3, "Common line here\nown line three\ncommon LINE here \nshort\nshort"), (1, " common line here\n\nshort\nx"),
         (2, None), (4, ""), (5, "ééééééééé\nüüüüüüüüüü\nCommon line here"), (6, "üüüüüüüüüü\t\n" + "long text " * 2000),
         (7, "ééééééééé"), (None, "common line here"), (5, "common line here\nrepeated id"), (8, "\x1ccommon line here")]


def brute_lines(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    docs = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(docs.get(key(x), ())) < 2 or i == min(docs[key(x)])]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def _lines_of(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()], key=repr)


def test_line_dedup_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 9, "e") for i, t in LINES], DOCS + ", n_lines int, extra string")
    got = line_dedup.dedup_lines(spark, docs)
    assert _lines_of(got) == brute_lines(LINES) and "extra" in got.columns
    assert line_dedup.dedup_lines(spark, docs.limit(0)).count() == 0


def test_line_dedup_is_reversible(spark):
    rows = [r for r in LINES if r[0] is not None]
    first, later = rows[:4], rows[4:]
    frame = lambda x: spark.createDataFrame(x, DOCS)
    index = line_dedup.insert(line_dedup.build(spark, frame(first)), frame(later))
    assert _lines_of(line_dedup.apply(index, frame(rows))) == brute_lines(rows)
    index = line_dedup.delete(index, frame([(1, ""), (6, "")]).select("doc_id"))
    left = [r for r in rows if r[0] not in (1, 6)]
    assert _lines_of(line_dedup.apply(index, frame(left))) == brute_lines(left)
    many = [(100 + i, "\n".join("repeated line %d" % j for j in range(i, i + 40))) for i in range(60)]
    index = line_dedup.insert(index, frame(many))                   # more duplicates than the first filter holds
    left += many
    assert _lines_of(line_dedup.apply(index, frame(left))) == brute_lines(left)
    whole = line_dedup.build(spark, frame(left))
    for a, b in ((index.refs, whole.refs), (index.postings, whole.postings)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_cuckoo_filter_inserts_finds_and_deletes():
    rng = np.random.default_rng(2)
    h = rng.integers(-2**63, 2**63 - 1, (60_000, 2), dtype=np.int64)
    f = line_dedup.build_filter(h[:30_000, 0], h[:30_000, 1])
    f = line_dedup.CuckooFilter.load(f.dump())
    assert f.contains(h[:30_000, 0], h[:30_000, 1]).all()
    assert f.contains(h[30_000:, 0], h[30_000:, 1]).mean() < 0.002
    f.delete(h[:10_000, 0], h[:10_000, 1])
    assert f.contains(h[10_000:30_000, 0], h[10_000:30_000, 1]).all()
    assert f.contains(h[:10_000, 0], h[:10_000, 1]).mean() < 0.002


@pytest.mark.parametrize("shards", [1, 16, 64])
def test_cuckoo_filters_are_as_full_whatever_the_number_of_shards(shards):
    rng = np.random.default_rng(12)
    h = rng.integers(-2**63, 2**63 - 1, (40_000 * shards, 2), dtype=np.int64)
    own = h[h[:, 0] % shards == shards // 2]                  # the keys of one shard
    f = line_dedup.build_filter(own[:, 0], own[:, 1])
    assert f.load_factor() >= 0.4 and f.contains(own[:, 0], own[:, 1]).all()
    other = h[h[:, 0] % shards != shards // 2] if shards > 1 else rng.integers(-2**63, 2**63 - 1, (40_000, 2), dtype=np.int64)
    assert f.contains(other[:200_000, 0], other[:200_000, 1]).mean() < 0.002


def test_line_dedup_is_reversible_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    frame = lambda x: spark.createDataFrame(x, DOCS)
    rows = [(i, "\n".join("shared line %d" % j for j in range(i, i + 6))) for i in range(20)]
    index = line_dedup.build(spark, frame(rows))
    assert index.shards > 1
    more = [(100 + i, "\n".join("shared line %d" % j for j in range(15 + 3 * i, 24 + 3 * i))) for i in range(30)]
    before = index.shards
    index = line_dedup.insert(index, frame(more))
    assert index.shards > 2 * before                          # dealt anew
    rows += more
    assert _lines_of(line_dedup.apply(index, frame(rows))) == brute_lines(rows)
    index = line_dedup.delete(index, frame(rows[::3]).select("doc_id"))
    index = line_dedup.insert(index, frame([(500, "shared line 3\nshared line 90\nnew and only here")]))
    rows = [r for i, r in enumerate(rows) if i % 3] + [(500, "shared line 3\nshared line 90\nnew and only here")]
    assert _lines_of(line_dedup.apply(index, frame(rows))) == brute_lines(rows)


@pytest.mark.parametrize("layers", [2, 8])
def test_line_dedup_over_many_changes(spark, monkeypatch, layers):
    monkeypatch.setattr(line_dedup, "LAYERS", layers)
    frame = lambda x: spark.createDataFrame(x, DOCS)
    text = lambda i: "\n".join("shared line %d" % ((i * 7 + j * j) % 23) for j in range(5))
    rows = [(i, text(i)) for i in range(12)]
    index = line_dedup.build(spark, frame(rows))
    for step in range(3):
        more = [(100 * (step + 1) + i, text(i + step)) for i in range(4)] + [(100 * (step + 1) + 50, None)]
        index, rows = line_dedup.insert(index, frame(more)), rows + more
        gone = {r[0] for r in rows[step::5]}
        index = line_dedup.delete(index, frame([(i, "") for i in gone] + [(None, ""), (9_999, "")]).select("doc_id"))
        rows = [r for r in rows if r[0] not in gone]
    again = [(1, "shared line 1\nan id that went comes back")] if all(r[0] != 1 for r in rows) else []
    index, rows = line_dedup.insert(index, frame(again)) if again else index, rows + again
    assert _lines_of(line_dedup.apply(index, frame(rows))) == brute_lines(rows)
    whole = line_dedup.build(spark, frame(rows))
    for a, b in ((index.refs, whole.refs), (index.postings, whole.postings)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert index.dups == whole.dups and index.layers < layers


def test_line_dedup_changes_write_their_own_keys_only(spark):
    frame = lambda x: spark.createDataFrame(x, DOCS)
    index = line_dedup.build(spark, frame([(i, "line number %d\nanother line %d" % (i, i)) for i in range(200)]))
    start = len(index.sp)
    after = line_dedup.insert(index, frame([(500, "line number 3\na line of its own")]))
    after = line_dedup.delete(after, frame([(7, "")]).select("doc_id"))
    written = [spark.read.parquet(path) for path in index.sp[start:]]
    assert max(w.count() for w in written if "h1" in w.columns) == 2          # of 400 keys and postings
    assert after.refs.count() == 399 and after.dups == 1


# ---------------------------------------------------------- decontamination

def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(6)] + ["É"]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(i, say(int(rng.integers(8, 25)))) for i in range(12)] + [(20, "w1 w2"), (21, "rare"), (22, ""), (23, None),
                                                                     (None, say(12)), (3, say(11)), (100, "É, w0!")]
    docs = [(i, say(60)) for i in range(20)] + [(50, None), (51, ""), (52, items[0][1].upper() + ". " + items[1][1]),
                                               (52, "rare"), (53, "x w1 w2 w1 w2 " * 3000)]
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        ws = tok(t)
        if i is not None and ws:
            n = min(10, len(ws))
            for p in range(len(ws) - n + 1):
                windows.setdefault(tuple(ws[p:p + n]), set()).add(str(i))
    expect = []
    for d, t in docs:
        ws, hit, found = tok(t), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(ws) - n + 1):
                if tuple(ws[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(ws[p:p + n])]
        expect.append((d, len(ws), len(hit), sorted(found), bool(hit)))
    frame = spark.createDataFrame([(i, t, "keep") for i, t in docs], DOCS + ", other string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 40):                          # one block, then many
        got = decontaminate.match(spark, frame, bench, block_words=block)
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()) == sorted(expect)
    spans = [m for r in got.filter("doc_id = 52").collect() for m in r.longest if m["item"] == "0"]
    assert any(m["item_start"] == 0 and m["doc_start"] == 0 and m["words"] >= len(tok(items[0][1])) for m in spans) \
        or len(tok(items[0][1])) < 10
    kept = decontaminate.remove_contaminated(spark, frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(not e[4] for e in expect)
    assert decontaminate.match(spark, frame, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.match(spark, frame.limit(0), bench).count() == 0


# ------------------------------------------------------- embedding near-dedup

def _brute_links(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= 0.95
    lab = min_labels(len(ok), *np.nonzero(near))
    low = {r: min(ok[i][0] for i in np.flatnonzero(lab == r)) for r in set(lab)}
    out = {i: (i, 0) for i, _ in rows}
    out |= {i: (low[lab[at]], int(near[at].sum()) - 1) for at, (i, _) in enumerate(ok)}
    return out


def test_embedding_links_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(25, 8))
    rows = [(int(i), (centre[i % 25] + rng.normal(0, s, 8)).astype(np.float32).tolist())
            for i, s in enumerate(rng.choice([0.02, 0.08, 0.3], 300))]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]                    # copies
    rows += [(2000 + i, (centre[3] + rng.normal(0, 0.01, 8)).astype(np.float32).tolist()) for i in range(80)]
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [None] + [1.0] * 7), (3003, [float("nan")] * 8),
             (3004, [float("inf")] + [0.0] * 7), (3005, [1.0, 2.0]), (3006, []),
             (3007, [2 * v for v in rows[0][1]])]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(int(i), v, 1) for i, v in rows], "vec_id long, embedding array<float>, n_links int")
    expect = _brute_links(rows)
    for block in (1024, 16):                               # whole buckets, then cut ones
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        got = {r.vec_id: (r.component_id, r.n_links) for r in embed_dedup.near_duplicates(spark, frame).collect()}
        links = sum(n for _, n in got.values()) / sum(n for _, n in expect.values())
        assert set(got) == set(expect) and 0.98 <= links <= 1.0
        assert all(got[i][1] <= expect[i][1] for i in expect)
        assert np.mean([got[i][0] == expect[i][0] for i in expect]) > 0.98
    assert embed_dedup.near_duplicates(spark, frame.limit(0)).count() == 0
    only_bad = frame.filter("vec_id in (3000, 3001, 3006)")
    assert [r.kept for r in embed_dedup.near_duplicates(spark, only_bad).collect()] == [True] * 3


def test_embedding_recall_at_the_threshold():
    """Pairs just above the threshold: the tables find at least nine tenths."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = rng.normal(size=a.shape)
    e -= (e * a).sum(1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951 ** 2) * e
    mean, proj = embed_dedup.fit_itq(a)
    ca, cb = (((x - mean) @ proj > 0) for x in (a, b))
    masks = np.array(embed_dedup.table_masks(64, 1_000_000, 0.95), np.int64)
    weights = np.array([1 << i for i in range(64)], np.uint64)
    diff = (ca @ weights ^ cb @ weights).view(np.int64) if ca.dtype == np.uint64 else \
        ((ca @ weights).astype(np.uint64) ^ (cb @ weights).astype(np.uint64)).view(np.int64)
    assert ((diff[:, None] & masks) == 0).any(1).mean() >= 0.9
    assert 0.3 < ca.mean(0).min() and ca.mean(0).max() < 0.7           # balanced bits


def test_embedding_links_with_a_common_direction(spark):
    """Vectors that share a direction and have uneven axes: centring widens the
    angle of a pair, and the tables planned from measured pairs still find them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 32)) * np.linspace(1.5, 0.5, 32) + 8 * np.eye(32)[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    x = np.concatenate([x, 0.952 * x + np.sqrt(1 - 0.952 ** 2) * e])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark, frame).collect()}
    near = (x @ x.T >= 0.95).sum(1) - 1
    assert np.linalg.norm(x.mean(0)) > 0.7 and all(got[i] <= near[i] for i in got)
    assert sum(got.values()) >= 0.99 * near.sum()


def test_embeddings_of_every_length_link(spark):
    """Two models in one table: the smaller one keeps its links, no pair crosses lengths."""
    rng = np.random.default_rng(10)
    long, short = rng.normal(size=(30, 8)), rng.normal(size=(5, 3))
    rows = [*long.tolist(), *short.tolist(), short[0].tolist(), (2 * short[1]).tolist(), [1.0], [2.0], [0.0, 0.0]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark, frame).collect()}
    for i, v in enumerate(rows):
        near = [j for j, w in enumerate(rows) if j != i and len(w) == len(v) and any(v) and any(w)
                and np.dot(v, w) >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w)]
        assert got[i][0] == len(near) and got[i][1] <= min([i, *near])
    assert got[35][1] == 30 and got[36][1] == 31 and got[38] == (1, 37) and got[39] == (0, 39)


def test_embedding_plans_keep_their_recall_as_tables_grow():
    """Plans for 1e6 to 1e8 rows against brute force, on vectors that no plan was made from."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64)) * np.linspace(2, 0.2, 64) + 3 * np.eye(64)[5]
    x[4000:] = x[:2000] + rng.normal(size=(2000, 64)) * 0.28 * np.linspace(2, 0.2, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fits = [embed_dedup.fit_itq(x[2000:4000], seed=w) for w in range(embed_dedup.WORDS)]
    probes = [embed_dedup.encode(a, fits) ^ embed_dedup.encode(b, fits)
              for a, b in embed_dedup.probe_pairs(x[2000:4000], 0.95)]
    i, j = np.nonzero(x[:2000] @ x[4000:].T >= 0.95)
    code = embed_dedup.encode(x, fits)
    differ = code[i] ^ code[4000 + j]
    for n in (10 ** 6, 10 ** 7, 10 ** 8):
        masks = embed_dedup.table_masks(64, n, 0.95, differ=probes, codes=code[2000:4000])
        met = [(differ[:, t % embed_dedup.WORDS] & m) == 0 for t, m in enumerate(masks)]
        assert len(i) > 500 and np.any(met, axis=0).mean() >= 0.995


# ---------------------------------------------------------- html extraction

def test_html_extraction_on_all_pages(spark, small, con):
    got = {r.page_id: r.text for r in queries.op4_html_extract(spark, small).collect()}
    for pid, page in con.sql("SELECT page_id, html FROM pages").fetchall():
        m = re.search(r"<article>(.*?)</article>", page or "", re.S)
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", m[1] if m else ""))
        parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in parts]
        assert got[pid] == "\n".join(x for x in parts if x)


WILD = """<html><head><title>t</title></head><body><div id=menu>Menu</div><div class="cookie-notice">We use</div><main><article>
<h1>T&eacute;st &lt;x&gt;</h1><p>One <b>two</b>
 three &amp;amp; <a href="a>b">four</a><p>Five<ul><li>a<li>b<ul><li>c</ul></ul><script>var x="</p><p>no";</script>
<form><p>send</p></form><div class="comments"><p>nice!</p></div></article></main><aside>side</aside><footer>f</footer>"""


def test_html_wild_pages(spark):
    plain = "<div class=x><h4>Same on all</h4><p>Body {0}</p><p>more {0}</p></div><div>Tail</div>"
    pages = [(1, "http://a.b/1", WILD), (2, "http://a.b/2", None), (3, "http://a.b/3", ""), (4, None, "<p>alone</p>"),
             (4, None, "<p>alone</p>"), (9, "http://e.f/", "no tags &amp; more"), (10, "http://g.h/", "<p>a<!-- b"),
             (11, "http://g.h/", "<p class='x>unclosed quote</p><p>then</p>" * 3)]
    pages += [(20 + i, "http://C.d/%d" % i, plain.format(i)) for i in range(3)]
    df = spark.createDataFrame([(i, u, h, "mine") for i, u, h in pages], "page_id long, url string, html string, main string")
    rows = html_extract.extract(spark, df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == "Tést <x>\nOne two three &amp; four\nFive\na\nb\nc"
    assert got[2] == got[3] == "" and got[4] == "alone" and got[9] == "no tags & more" and got[10] == "a"
    assert "then" in got[11] and got[21] == "Body 1\nmore 1"
    assert html_extract.extract(spark, df.limit(0)).count() == 0


def _extracted(spark, *pages):
    """Texts of (url, html) pages, in order."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract(spark, df).orderBy("page_id").collect()]


def test_html_frames_are_decided_for_each_page(spark):
    """A page with an article element leaves its host's other pages alone."""
    got = _extracted(spark, ("http://a.b/1", "<p>x</p><article><p>teaser</p></article>"),
                     ("http://a.b/2", "<p>x</p><main><p>in main</p></main>"),
                     ("http://a.b/3", "<nav>n</nav><div class=content><h1>T</h1><p>whole body</p></div>"),
                     (None, "<article>one</article>"), (None, "<p>two</p>"), ("http://a.b/4", "<p>x</p><article></article>"))
    assert got == ["teaser", "in main", "T\nwhole body", "one", "two", ""]


def test_html_copies_of_a_page_are_no_template(spark):
    """A page's text does not depend on its number of copies, also where only a part outside differs."""
    page = "<nav>%d</nav><h1>T</h1><p>a</p><p>b</p>"
    got = _extracted(spark, *[("http://a.b/%d" % i, page % i) for i in range(3)], ("http://c.d/", page),
                     ("http://e.f/", "<h2>x</h2><p>1</p><h2>x</h2>"),
                     *[("http://g.h/%d" % i, f"<h1>Site</h1><p>{i}</p>") for i in (1, 2, 2)])
    assert got == ["T\na\nb"] * 4 + ["x\n1\nx", "1", "2", "2"]


def test_html_equal_texts_among_differing_ones_are_template(spark):
    """A notice between paragraphs of the same path goes, wherever it stands; what only some pages hold stays."""
    got = _extracted(spark, *[("http://a.b/%d" % i, x) for i, x in enumerate(
        ["<p>one</p><p>two</p><p>Notice</p>", "<p>Notice</p><p>three</p>", "<p>four</p><p>Notice</p><p>two</p>"])])
    assert got == ["one\ntwo", "three", "four\ntwo"]


def test_html_names_with_odd_characters(spark):
    got = _extracted(spark, ("http://a.b/1", "<div><o:p>office</o:p><p>text</p><x(y)+>odd</x(y)+><b!>bang</b!></div>"),
                     ("http://c.d/1", "<article><svg:g>in</svg:g><o:p>side</o:p></article><o:p>out</o:p>"))
    assert got == ["office\ntext\nodd\nbang", "in\nside"]


def test_html_deep_and_long_pages_take_linear_time(spark):
    def seconds(page, lines):
        start = time.perf_counter()
        got = html_extract.Matcher(None).text(page)
        assert got == "\n".join(lines)
        return time.perf_counter() - start
    for one, n in (("<div>text %d", 20_000), ("<p>text %d</p>", 40_000),
                   ("<li><span>text %d", 10_000), ("</b></section>text %d<br>", 20_000)):
        lines = ["text %d" % i for i in range(n)]
        assert seconds("".join(one % i for i in range(n)), lines) < 10
    assert seconds("<div class=sidebar>" * 20_000 + "all of the text", ["all of the text"]) < 10
    deep = "<div>" * 3_000 + "<article>" + "<section>" * 3_000 + "<p>main</p></article><p>after</p>"
    pages = [("http://a.b/%d" % i, deep.replace("main", "main %d" % i)) for i in range(2)]
    assert _extracted(spark, *pages) == ["main 0", "main 1"]


def test_html_repeats_merge_the_same_by_halves():
    """A folded run is what merging its repeats one by one gives."""
    for n in range(2, 9):
        parts = [[["p", [i], 1, 1, frozenset([i])], ["b", [n + i], 1, 1, frozenset([-i])]] for i in range(n)]
        one = parts[0]
        for x in parts[1:]:
            one = [html_extract.merged(a, b, True) for a, b in zip(one, x)]
        assert html_extract._halved(parts) == one and html_extract.fold(sum(parts, []), True) == [["+", one]]


def test_html_marks_spare_the_article_and_most_of_the_text(spark):
    body = "<h1>T</h1><p>A long enough paragraph of the article.</p>"
    whole = "T\nA long enough paragraph of the article."
    pages = [f"<html class='has-sidebar'><body class='sticky-header right-sidebar'><div>{body}</div></body></html>",
             f"<div class='right-sidebar'>{body}</div>", f"<form action=x><div class=sidebar>{body}</div></form>",
             f"<form><div id=side><article class='widget'>{body}</article></div></form><p>out</p>",
             "<article><h2 id='related-work'>R</h2><section id='side-effects'><p>s</p></section><h2 class=header>S</h2>"
             "<div id='comments-on-the-method'><p>m</p></div><div class='x comments'><p>c</p></div><p>The rest.</p></article>",
             f"<div class='site-header'>h</div><div class='cookie-notice'>k</div><ul id=main_nav><li>n</ul>{body}"
             "<div class='post-comments'>c</div><form>send</form><aside>" + "long aside " * 20 + "</aside>"]
    got = _extracted(spark, *[("http://h%d.x/" % i, p) for i, p in enumerate(pages)])
    assert got == [whole] * 4 + ["R\ns\nS\nm\nThe rest.", whole]


def test_html_comments_headers_and_side_articles(spark):
    body = "<p>A body that is long enough to be the article of this page.</p>"
    text = "A body that is long enough to be the article of this page."
    pages = [f"<article>{body}<section class=comments><article class=comment>{'Reader says. ' * 30}</article></section></article>",
             f"<article class=post><header><h1>Head</h1><p>Standfirst</p></header>{body}<footer>by</footer></article>"
             "<section id=comments><article class='comment odd'>a</article><article class=comment>b</article></section>",
             f"<div><h1>T</h1>{body}</div><div class=sidebar><article>side</article></div>",
             f"<div><h1>T</h1>{body}</div><div class=related><article>teaser</article><article>teaser two</article></div>",
             f"<script src=/a/>var leak=1;</script><article>{body}</article><script src=/b/ />",
             f"<header>Site</header><div class=content>{body}</div><div class=comments><p>{'More than the body says. ' * 30}</p></div>",
             "<div>" * 800 + body + "</div>" * 800]
    got = _extracted(spark, *[("http://s%d.x/" % i, p) for i, p in enumerate(pages)])
    assert got == [text, f"Head\nStandfirst\n{text}", f"T\n{text}", f"T\n{text}", text, text, text]


def test_html_slots_of_the_wrapper_decide(spark):
    """The same words are template in the slot where every page has them, and text where they fill another one."""
    page = "<div class=top><p>Daily news</p></div><h1>{0}</h1><div class=body><p>Text {0}</p>{1}</div><div>Find us</div>"
    more = ["", "<p>Daily news</p>", "<p>Find us</p><p>b</p>"]
    urls = [f"http://a.b/{i}" for i in range(3)]
    got = _extracted(spark, *zip(urls, [page.format(i, m) for i, m in enumerate(more)]))
    assert got == ["0\nText 0", "1\nText 1\nDaily news", "2\nText 2\nFind us\nb"]
    assert html_extract.Matcher(None).text(page.format(0, "")) == "Daily news\n0\nText 0\nFind us"      # without the wrapper
    order = [html_extract.expression(page.format(i, m)) for i, m in enumerate(more)]
    w = html_extract.aligned({str(i): html_extract.counted(x) for i, x in enumerate(order)})
    assert html_extract.loaded(html_extract.dumped(w)) == w


def test_wrapper_inference_finds_groups():
    pages = ["<h1>a</h1><p>1</p><p>2</p>", "<h1>b</h1><p>3</p>", "<h1>c</h1><h2>new</h2><p>4</p><p>5</p><p>6</p>"]
    w = None
    for p in pages:
        e = html_extract.counted(html_extract.expression(p))
        w = e if w is None else html_extract.align(w, e)
    assert html_extract.shape(w) == "h1 (h2)? (p)+"
    long = html_extract.counted(html_extract.expression("".join(f"<p>{i}</p><h3>x</h3><div>y</div><h4>z</h4><h5>u</h5><h6>v</h6>" for i in range(300))))
    assert {s[0] for s in html_extract.slots(html_extract._align_in_order(long, w))} >= {"p", "h1", "h2", "h6"}


def _walked(a, b):
    """The steps of two expressions by the plain table of lengths."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    equal = [[html_extract.same(x, y) for y in b] for x in a]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if equal[i][j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and equal[i][j]:
            yield i, j
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1


def test_html_alignment_is_that_of_the_plain_table_at_any_size():
    def item(r, deep=2):
        if deep and r.random() < .3:
            return [r.choice("?+"), [item(r, deep - 1)]]
        if deep and r.random() < .1:
            return ["+", [item(r, deep - 1), item(r, deep - 1)]]
        return [r.choice("abcd"), 1, 1, 2, frozenset([1])]
    for seed in range(2_000):
        r = random.Random(seed)
        a, b = ([item(r) for _ in range(r.randrange(14))] for _ in range(2))
        assert list(html_extract.steps(a, b)) == list(_walked(a, b))
    for kinds in (3, 40, 2_000):                         # more than a million cells
        r = random.Random(kinds)
        a, b = ([["t%d" % r.randrange(kinds), 1, 1, 2, frozenset([1])] for _ in range(n)] for n in (1_100, 1_000))
        assert list(html_extract.steps(a, b)) == list(_walked(a, b))


def test_html_template_texts_go_from_long_pages_too(spark):
    """A headline that stands elsewhere does not shift the slots, whatever the pages' length."""
    def page(i, n):
        rounds = ["".join(f"<{t}>{t} {i} {k}</{t}>" for t in ("p", "h2", "h3", "h5", "h6")) + f"<h4>Part {k}</h4>" for k in range(n)]
        return "".join([*rounds[:0 if i % 2 else 10], f"<h1>Headline {i}</h1>", *rounds[0 if i % 2 else 10:]])
    for n in (20, 200):
        for text in _extracted(spark, *[("http://a.b/%d" % i, page(i, n)) for i in range(4)]):
            assert "Part" not in text and len(text.split("\n")) == 5 * n + 1


def test_html_texts_do_not_depend_on_how_the_pages_are_split(spark):
    """A host with more expressions than a task used to keep, in one, two and seven tasks."""
    def page(i):
        r = random.Random(i)
        return "".join(f"<{t}>{t} {i} {k}</{t}>" if r.random() < .7 else f"<{t}>Read on</{t}>"
                       for k in range(12) for t in [r.choice(["p", "h2", "h3", "div"])])
    df = spark.createDataFrame([(i, "http://a.b/%d" % i, page(i)) for i in range(150)], "page_id long, url string, html string")
    got = [{r.page_id: r.text for r in html_extract.extract(spark, df.repartition(k, "page_id")).collect()} for k in (1, 2, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 150


def test_html_a_run_in_a_run_of_the_wrapper_is_matched():
    wrapper = [["+", [["+", [["p", True]]]]], ["h2", False]]
    assert html_extract.matched(wrapper, [["p", [0], 1, 1, frozenset()], ["h2", [1], 1, 1, frozenset()]]) == [
        (["p", [0], 1, 1, frozenset()], ["p", True]), (["h2", [1], 1, 1, frozenset()], ["h2", False])]


# ---------------------------------------------------------- chat formatting

def test_chat_rows_against_brute_force(spark):
    nasty = ["\\", "</turn>", "### User: ", "#### ", "\\</turn>\\", "<\\/turn>", "é\n### Assistant: x</turn>\n", None, ""]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(
        [("user", n) for n in nasty] + [("assistant", n) for n in nasty] + [("odd: role", "x"), (None, "y"), ("User", "z")])]
    rows += [(5, None, "user", "last"), (5, 1, "user", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a")]
    rows += [(6, t, "user" if t % 2 == 0 else "assistant", "turn %d " % t) for t in range(70)] + [(7, 0, "assistant", "w " * 30_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    pieces = chat_format.format_paths(spark, chat_format.number_turns(spark, frame))
    got = {r.conv_id: r for r in chat_format.read_back(pieces).collect()}
    assert set(got) == {1, 2, None, 5, 6, 7}
    text = {}
    for p in pieces.orderBy("conv_id", "depth").collect():
        text[p.conv_id] = text.get(p.conv_id, "") + p.piece
    for c in got:
        own = sorted([r[1:] for r in rows if r[0] == c], key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
        own = [(r or "", x or "") for _, r, x in own]
        assert sorted(chat_format.parse(text[c])) == sorted(own)            # whole round trip
        learned = "".join(x for r, x in own if r == "assistant")
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), h("".join(f"{r}\n{x}\n" for r, x in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), h(learned))
        assert got[c].formatted_chars == len(text[c])
    empty = chat_format.format_paths(spark, chat_format.number_turns(spark, frame.limit(0)))
    assert chat_format.read_back(empty).count() == 0


def test_chat_rows_that_repeat_a_node_have_an_order(spark):
    rows = [(1, 0, None, "user", "top", 0.0)] + [(1, 1, 0, "assistant", f"reply {k % 7}", 0.0) for k in range(21)]
    want = None
    for parts in (1, 3, 5):
        frame = spark.createDataFrame(rows[::-1 if parts == 3 else 1], "conv_id long, node_id long, parent_id long, role string, text string, score double")
        got = chat_format.read_back(chat_format.format_paths(spark, frame.repartition(parts))).collect()[0]
        said = ["user\ntop\n"] + [f"assistant\nreply {k}\n" for k in range(7) for _ in range(3)]
        assert got.n_turns == 22 and got.turns_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert want in (None, got)
        want = got


def test_reply_trees_enumerate_and_rank_paths(spark):
    rng = np.random.default_rng(6)
    nodes = [(1, 0, None, 1.0)] + [(1, i, int(rng.integers(0, i)), float(rng.integers(0, 5))) for i in range(1, 60)]
    nodes += [(2, i, i - 1 if i else None, 1.0) for i in range(40)]                  # a chain
    nodes += [(3, 1, 2, 1.0), (3, 2, 1, 1.0), (3, 3, 99, 2.0), (3, 4, 4, 1.0), (3, 5, 4, 1.0)]    # cycle, lost parent, own parent
    frame = spark.createDataFrame(nodes, "conv_id long, node_id long, parent_id long, score double")
    got = {}
    for r in chat_format.chosen_paths(frame, Spool(spark), best=3).collect():
        got.setdefault((r._conv, r.path_rank), {})[r.depth] = r.node_id
    for conv in (1, 2, 3):
        up = {n: (p if p != n and p in {x[1] for x in nodes if x[0] == conv} else None) for c, n, p, _ in nodes if c == conv}
        score = {n: s for c, n, _, s in nodes if c == conv}
        paths = []
        for leaf in set(up) - set(up.values()):
            path = [leaf]
            while up[path[-1]] is not None and len(path) <= len(up):
                path.append(up[path[-1]])
            if len(path) <= len(up):
                paths.append((-sum(score[n] for n in path), leaf, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(paths)[:3], 1):
            assert [got[f"c{conv}", rank][d] for d in range(len(path))] == path
        assert len([k for k in got if k[0] == f"c{conv}"]) == min(3, len(paths))


# ------------------------------------------------------------------ mixing

def test_mix_meets_its_targets_and_edge_cases(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "w " * int(rng.integers(0, 40)), str(rng.choice(["a", "b", "c", "é", "d"], p=[.5, .2, .1, .1, .1])), "x", 1)
            for i in range(4000)]
    rows += [(9000, None, "empty", "x", 1), (9001, "alone here", None, "x", 1), (None, "no id", "b", "x", 1),
             (5, "again five", "b", "x", 1), (9002, "word " * 5000, "huge", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string, taken int")
    got = mix_sources.mix(spark, frame).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"),
                                                  most=("size", "max"))
    assert (per.target <= 2 * per["size"]).all() and abs(per.target.sum() - min(1.5, 2) * per["size"].sum()) < 1e-6
    assert ((per.taken - per.target).abs() <= per.most / 2 + 1e-9).all()
    again = mix_sources.mix(spark, frame.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mix_sources.mix(spark, frame.limit(0)).count() == 0


def test_mix_stays_native(spark, small):
    plan = queries.op6_mix_sources(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!Column)", plan)


# -------------------------------------------------------------- language ID

def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(8)
    for k, first in ((3, [0, 1, 40, 104, 105, 170]), (4, [0]), (2, list(range(0, 300, 3)))):
        e, start, trans = rng.normal(size=(300, k)) * 3, rng.normal(size=k), rng.normal(size=(k, k))
        got = lang_crf.posteriors(e, np.array(first), start, trans)
        for a, b in zip(first, [*first[1:], 300]):
            f, g = np.zeros((b - a, k)), np.zeros((b - a, k))
            f[0] = start + e[a]
            for i in range(1, b - a):
                f[i] = np.logaddexp.reduce(f[i - 1][:, None] + trans, axis=0) + e[a + i]
            for i in range(b - a - 2, -1, -1):
                g[i] = np.logaddexp.reduce(trans + e[a + i + 1] + g[i + 1], axis=1)
            m = np.exp(f + g - np.logaddexp.reduce(f + g, axis=1, keepdims=True))
            assert np.allclose(got[a:b], m, atol=1e-9)


@pytest.fixture(scope="module")
def model(spark, small):
    return lang_crf.fit(spark, spark.read.parquet(f"{small}/documents.parquet"), F.col("doc_id") % 4 != 2, 40)


def test_language_accuracy_and_edge_cases(spark, model):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lang_crf.identify(spark, big, model).select("lang", "lang_pred", "score").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 | 34 !! — … 🙂", 1), (4, "a", 1), (4, "a", 1),
                                 (5, "the " * 60_000, 1)], DOCS + ", score int")
    rows = lang_crf.identify(spark, odd, model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 6 and [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred in model.labels and got[5].lang_pred == "en"
    assert lang_crf.identify(spark, odd.limit(0), model).count() == 0
    assert lang_crf.fit(spark, big.limit(0), F.lit(True)) is None
    assert lang_crf.identify(spark, odd, None).filter("lang_pred = 'und'").count() == 6


def test_code_switched_words_are_labelled(spark, model, con):
    texts = {r[0]: r[1] for r in con.sql("SELECT lang, max(text) FROM documents WHERE length(text) > 900 GROUP BY 1").fetchall()}
    words = {k: re.findall(r"[^\W\d_]+", texts[k])[20:50] for k in ("en", "fr")}
    mixed = " ".join(words["en"] + words["fr"])
    got = lang_crf.tag(spark, spark.createDataFrame([(1, mixed), (2, None)], DOCS), model).orderBy("position").collect()
    assert [r.word for r in got] == [w.lower() for w in words["en"] + words["fr"]]
    right = [r.lang == ("en" if r.position < 30 else "fr") for r in got]
    assert np.mean(right) > 0.85


# -------------------------------------------------------------- token counts

def test_token_counts_equal_the_library(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(9)
    alphabet = [chr(c) for c in range(0, 0x2A0)] + list("  \n\t'asdtrem  ") * 20 + ["<|endoftext|>", "汉", "🙂", "\u200b", "क्षि", "'ll"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(1500)]
    texts += [None, "", "<|endoftext|>", "a" * 5000, " " * 3000, "x y " * 20_000]
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS + ", n_tokens int")
    for hot in (200, 1):
        got = {r.doc_id: r for r in token_count.count_tokens(spark, frame, path, hot=hot).collect()}
        for i, t in enumerate(texts):
            assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), repr(t)
            assert got[i].n_bytes == len((t or "").encode())
    assert token_count.count_tokens(spark, frame.limit(0), path).count() == 0
    assert queries.op8_token_counts(spark, small).filter("over_limit <> (n_tokens > 512)").count() == 0


# ------------------------------------------------------------------- simhash

def _simhash(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(10)
    vocab = ["w%d" % i for i in range(500)]
    base = [list(rng.choice(vocab, 400)) for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(base[i % 12])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(400))] = "changed%d" % i
        rows.append((i, " ".join(w)))
    rows += [(500 + i, rows[0][1]) for i in range(40)] + [(600, None), (601, ""), (602, "\x1c É"), (603, "one two"),
                                                       (604, "ONE  two"), (None, rows[3][1]), (3, "same id")]
    fp = [_simhash(t) for _, t in rows]
    ids = [i for i, _ in rows]
    lab = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([lab[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 4]) for i in range(len(rows))]
        if new == lab:
            break
        lab = new
    low = {}
    for i, l in zip(ids, lab):
        low[l] = min(x for x in (low.get(l), i) if x is not None) if (low.get(l) is not None or i is not None) else None
    expect = sorted((str(i), f, low[l]) for i, f, l in zip(ids, fp, lab))
    frame = spark.createDataFrame([(*r, "c") for r in rows], DOCS + ", component string")
    for block in (2048, 8):
        monkeypatch.setattr(simhash_dedup, "BLOCK", block)
        got = sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id)
                     for r in simhash_dedup.near_duplicates(spark, frame).collect())
        assert got == expect
    kept = simhash_dedup.keep_one(spark, frame)
    assert kept.columns == frame.columns
    stays = {}
    for row, l in sorted(zip(rows, lab), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        stays.setdefault(l, row)                              # (3, "same id") is a text of its own
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), t) for i, t in stays.values())
    assert ("3", "same id") in {(str(i), t) for i, t in stays.values()}
    assert simhash_dedup.near_duplicates(spark, frame.limit(0)).count() == 0
    assert simhash_dedup.keep_one(spark, frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [50, 10**5, 10**7, 10**9, 10**11])
def test_pigeonhole_plans_are_complete_at_every_size(n):
    law = simhash_dedup.distance_law(np.ones(16))
    plan = simhash_dedup.choose_plan([law] * 16, n, 4)
    assert sum(t + 1 for _, _, t in plan) == 5
    masks = [m & (2**64 - 1) for m in simhash_dedup.probe_masks(list(range(64)), plan)]
    rng = np.random.default_rng(11)
    for _ in range(300):
        d = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(d & m == 0 for m in masks)


def test_longest_matches_of_repetitive_texts_are_few(spark):
    import time
    block = decontaminate.prepare([(1, b"a " * 400), (2, b"a b " * 30)], 10)
    tokens = np.full(20_000, block.vocabulary[b"a"], np.int32)
    t = time.perf_counter()
    (at, place, key), = decontaminate.search(block, tokens)
    order = np.argsort(place)
    got = decontaminate.longest(at, place[order], key[order])
    assert time.perf_counter() - t < 1.5 and len(got) == 20_000 - 9 + 391 - 1
    assert max(w for *_, w in got) == 400
    rng = np.random.default_rng(13)                          # against a plain walk along the diagonals
    items = [(i, " ".join(rng.choice(list("abc"), 25)).encode()) for i in range(4)]
    block = decontaminate.prepare(items, 3)
    words = rng.choice(list("abc"), 120).tolist()
    tokens = np.array([block.vocabulary[w.encode()] for w in words], np.int32)
    (at, place, key), = decontaminate.search(block, tokens)
    order = np.argsort(place)
    want = []
    for i, (_, t) in enumerate(items):
        own = t.decode().split()
        for d in range(-len(own), len(words)):
            run = 0
            for p in range(len(own) + 1):
                if p < len(own) and 0 <= p + d < len(words) and own[p] == words[p + d]:
                    run += 1
                else:
                    want += [(i, p - run, p - run + d, run)] * (run >= 3)
                    run = 0
    assert sorted(decontaminate.longest(at, place[order], key[order])) == sorted(want)


def test_embeddings_of_extreme_size_link(spark):
    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [3.0, 6.0]), (3, [-1.0, 5.0]), (4, [5e-324, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(
        spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (0, 4)}


# ------------------------------------------------------------------- quality

def test_quality_accuracy_and_edge_cases(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_quality_rules(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    held = got.filter("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95 and got.count() == 1000
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "x", "q"), (3, "x", "q"), (4, "é " * 50_000, "q")],
                                DOCS + ", score string")
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (9, 0)], "doc_id long, quality int")
    rows = quality_rules.classify(spark, odd.drop("score"), marks, F.lit(True)).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1                  # one kind of label: its share
    assert quality_rules.classify(spark, odd.drop("score").limit(0), marks.limit(0), F.lit(True)).count() == 0


def test_compiled_rules_equal_their_definition(spark):
    rules = quality_rules.Rules(0.5, ((1.5, (("words", 2.0, None),)), (-2.0, (("upper", None, 0.3), ("words", 0.0, 5.0)))),
                                ((0.25, "dot", 0.1, 0.8),))
    rows = [(w, u, d) for w in (0.0, 2.0, 3.0, 6.0) for u in (0.1, 0.3, 0.5) for d in (0.0, 0.5, 2.0)]
    df = spark.createDataFrame(rows, "_q_words double, _q_upper double, _q_dot double")
    for r in df.withColumn("score", rules.column()).collect():
        z = 0.5 + 1.5 * (r._q_words > 2) - 2.0 * (r._q_upper <= 0.3 and 0 < r._q_words <= 5) + 0.25 * min(max(r._q_dot, 0.1), 0.8)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12
