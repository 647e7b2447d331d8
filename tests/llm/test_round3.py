"""Exact top-k, centroid clustering and conversation repair against brute force: nulls, ties, repeated rows, odd lengths,
empty tables, extra columns."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import hilbert_kmeans as HK, topk_pivots as TP, turn_repair as TR

VEC = "vec_id long, embedding array<double>, dim int, uid string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 7, "x") for i, v in rows], VEC)


def _finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


# ---------------------------------------------------------------- top-k

def _brute_top(rows, k=10):
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if _finite(v)]
    out = []
    for at, (i, q) in enumerate(ints):
        if i is None or i % 100:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(ints) if b != at and len(v) == len(q))
        out += [(i, r + 1, None if z else j, -s) for r, (s, z, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def _top(spark, rows, **options):
    got = TP.search(spark, _vectors(spark, rows).repartition(3), F.col("vec_id") % 100 == 0, **options)
    assert [c for c, _ in got.dtypes] == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_top_k_is_the_brute_force_one(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8)) * 3
    rows = [(i, base[i % 6] + rng.normal(size=8) * 0.1) for i in range(420)]
    rows += [(1000 + i, np.round(base[0], 2)) for i in range(60)] + [(100, base[1]), (100, base[1])]        # ties, a repeated id
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [np.nan] * 8), (503, [np.inf] + [0.0] * 7), (None, base[2])]
    rows += [(600, [1.0, 2.0]), (601, [2.0, -1.0]), (700, []), (701, []), (800, [0.0] * 8)]
    want = _brute_top(rows)
    assert _top(spark, rows) == want
    assert _top(spark, rows, pivots=2, sample=5, chunk_bytes=2000) == want            # several passes, few pivots
    assert [r for r in want if r[0] == 600] == [(600, 1, 601, 1024 * 1024 * 0)]


def test_top_k_of_large_components_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(size=4) * 10.0 ** (3 + i % 4), 3)) for i in range(101)]
    assert _top(spark, rows) == _brute_top(rows)
    huge = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    got = {r[2]: r[3] for r in _top(spark, huge)}
    assert got[1] == 2 ** 63 - 1 and got[2] == -2 ** 63 and got[3] == 1024 * 1024


def test_top_k_of_an_empty_table(spark):
    assert _top(spark, []) == [] and _top(spark, [(5, [1.0])]) == [] and _top(spark, [(100, [1.0])]) == []


def test_bounds_hold_and_stop_early():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * np.concatenate([rng.normal(size=(1500, 16)) + 20 * rng.normal(size=16) for _ in range(4)]))
    pivots = TP.choose_pivots(x[::7], 12)
    q = x[5]
    ub = TP.bound(TP.distances(q[None], pivots), TP.distances(x, pivots), np.array([q @ q]), (x ** 2).sum(1))[0]
    assert (ub >= x @ q).all()
    best = TP.Best(10, -np.inf)
    ids = np.arange(len(x))
    scored = TP.evaluate(best, q, 5, x, ub, np.zeros(len(x), bool), ids, ids)
    order = sorted((-s, i) for i, s in enumerate((x @ q).tolist()) if i != 5)[:10]
    assert [(r[0], r[2]) for r in best.rows] == order and scored < len(x) / 2


# ---------------------------------------------------------------- clustering

def _brute_clusters(rows, k, rounds, dim, scale=256):
    kept = [(i, [max(-2 ** 27, min(2 ** 27, int(np.floor(scale * x)))) for x in v]) for i, v in rows if _finite(v) and len(v) == dim]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    inertia = [sum(d for d, c in near if c == j) for j in range(len(cents))]
    return sorted([(i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, near)], key=repr)


def _clusters(spark, rows, k, rounds, dim, block=16):
    got = HK.summarise(spark, *HK.cluster(spark, _vectors(spark, rows).repartition(3), k, rounds, dim, block=block))
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("block", [3, 128])
def test_clusters_are_the_brute_force_ones(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6) + 4 * rng.integers(0, 3, 6)) for i in range(300)]
    rows += [(900 + i, [1.0] * 6) for i in range(80)] + [(7, [0.5] * 6), (7, [0.5] * 6), (None, [0.25] * 6)]     # a hot vector, a repeated id
    rows += [(950, None), (951, [1.0] * 5), (952, [None] + [1.0] * 5), (953, [np.inf] * 6), (954, [])]
    assert _clusters(spark, rows, 7, 3, 6, block) == _brute_clusters(rows, 7, 3, 6)


def test_clusters_of_few_rows_ties_and_large_components(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])]
    assert _clusters(spark, rows, 40, 5, 2) == _brute_clusters(rows, 40, 5, 2)
    big = [(i, [1e5 * (i - 3), -3e5 + i]) for i in range(9)] + [(99, [1e300, -1e300])]
    assert _clusters(spark, big, 3, 4, 2) == _brute_clusters(big, 3, 4, 2)
    assert _clusters(spark, [], 3, 4, 2) == []
    assert _clusters(spark, [(None, [1.0, 2.0])], 3, 4, 2) == [(None, None, None, None, None, None)]


def test_zone_maps_leave_out_only_what_cannot_win():
    rng = np.random.default_rng(4)
    less = 0
    for _ in range(50):
        cents = rng.integers(-200, 200, (20, 5)).astype(float)
        x = (rng.integers(-200, 200, 5) + rng.integers(-20, 20, (40, 5))).astype(float)
        left = HK.candidates(x.min(0), x.max(0), cents)
        near = ((x[:, None] - cents[None]) ** 2).sum(2).argmin(1)
        assert set(near) <= set(left)
        less += len(left)
    assert less < 50 * 20 / 2


def test_hilbert_keys_visit_neighbours_in_order():
    for axes, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        key = HK.hilbert_key(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# ---------------------------------------------------------------- conversation repair

def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def _repair(rows):
    """Counts, cheapest audit and repaired lines of one conversation, all edit paths kept by state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    turns = {r[1] for r in rows if r[1] is not None}
    counts = {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0}
    seen, states = set(), {"": (0, "", ())}
    sp = " \t\n\x0b\x0c\r"

    def put(to, s, cost, audit, lines):
        if s not in to or (cost, audit) < to[s][:2]:
            to[s] = cost, audit, lines

    def follows(s, i):
        return i if (s + i) in ("s", "u", "su", "ua", "au") else None

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a, lines) in list(out.items()):
                role = "assistant" if s == "u" else "user"
                put(out, role[0], c + 5, a + "I", (*lines, role + ":"))
        return out
    for _, _, role, text in rows:
        bare = text.strip(sp)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        more, out = 5 * (fault == "truncated"), {}
        for s, (c, a, lines) in inserted(states).items():
            put(out, s, c + 2, a + "D", lines)
            if fault in (None, "truncated"):
                if role[:1] and follows(s, role[0]):
                    put(out, role[0], c + more, a + "K", (*lines, f"{role}:{text}"))
                new = "assistant" if s == "u" else "user"
                put(out, new[0], c + 1 + more, a + "R", (*lines, f"{new}:{text}"))
        states = out
    cost, audit, lines = min(v for s, v in inserted(states).items() if s in ("", "a"))
    first = [r[2][:1] for r in rows]
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (counts["gaps"], counts["blank"], counts["duplicate"], counts["truncated"], bad, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


CONV = "conv_id long, turn long, role string, text string"
TEXTS = ["Yes.", "no", "What?", "  \t\n", "", "Ça va!", "a\nb.", "end. \r\n", None, "\x85", "ok . "]


def _random_rows(seed, convs, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        conv = None if c == 0 else c
        for t in range(int(rng.integers(1, longest))):
            turn = None if rng.random() < 0.05 else int(t + (rng.random() < 0.1) * 3)
            role = ["user", "assistant", "system", "tool", "", "User", None][int(rng.choice(7, p=[.38, .36, .1, .05, .03, .04, .04]))]
            rows.append((conv, turn, role, TEXTS[int(rng.choice(11, p=[.3, .1, .2, .03, .04, .1, .08, .05, .03, .02, .05]))]))
    return rows


def _by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    return out


@pytest.mark.parametrize("limits", [{}, {"max_rows": 6, "shift": 2}, {"max_rows": 0, "shift": 1}, {"max_bytes": 30, "shift": 3}])
def test_repair_is_the_cheapest_edit(spark, limits):
    rows = _random_rows(5, 25, 30)
    df = spark.createDataFrame(rows, CONV).withColumn("uid", F.lit("clash")).withColumn("part", F.lit(1)).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in TR.digests(TR.repair(spark, df, **limits)).collect()}
    assert got == {c: _repair(r) for c, r in _by_conv(rows).items()}


def test_damage_and_repair_together(spark):
    rows = _random_rows(6, 60, 12)
    damaged = TR.damage(spark.createDataFrame(rows, CONV))
    assert sorted(map(tuple, damaged.collect()), key=repr) == sorted(_damage(rows), key=repr)
    got = {r.conv_id: tuple(r)[1:] for r in TR.digests(TR.repair(spark, damaged)).collect()}
    assert got == {c: _repair(r) for c, r in _by_conv(_damage(rows)).items()}


def test_one_conversation_with_all_rows_spread_over_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [(1, i // 2, "user" if rng.random() < 0.6 else "assistant", "same." if i % 3 == 0 else f"t {i}" + ".?!x"[int(rng.integers(0, 4))])
            for i in range(3000)]
    got = TR.digests(TR.repair(spark, spark.createDataFrame(rows, CONV).repartition(5), max_rows=100, shift=6)).collect()
    assert [tuple(r)[1:] for r in got] == [_repair([(1, t, r, x) for _, t, r, x in rows])]


def test_runs_through_powers_equal_single_steps():
    for symbol in "uasoUASOX":
        v = TR.FINAL
        for n in range(1, 40):
            v = TR.apply(TR.step(symbol), v)
            assert TR.across(symbol, n, TR.FINAL) == v
            assert TR.apply(TR.block_matrix(symbol * n), TR.FINAL) == v


def test_repair_of_an_empty_table_and_of_no_rows(spark, tmp_path):
    from panelcast.llm import queries
    empty = spark.createDataFrame([], CONV)
    assert TR.digests(TR.repair(spark, empty)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x."), (None, None, None, None)], CONV).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[None] == _repair(_damage([(None, None, None, None)]))
