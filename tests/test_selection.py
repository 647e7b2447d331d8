"""Lasso, forward stepwise and breaks per entity against their definitions; point-in-time joins against a plain search."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import align as AL, linear as LN, selection as SL

ROWS = "entity_id string, date date, y double, x array<double>, features array<string>"


def _groups(spark, groups):
    rows = [(e, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(y[i]), [float(v) for v in x[i]], [f"f{j}" for j in range(x.shape[1])])
            for e, (x, y) in groups.items() for i in range(len(y))]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def _made(n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p))
    return x, x[:, 0] - 2 * x[:, 1 % p] + rng.normal(size=n)


def test_lasso_meets_its_optimality_conditions_per_entity(spark):
    groups = {"wide": _made(30, 12, 1), "other": _made(80, 7, 2), "few": _made(8, 3, 3), "flat": _made(40, 4, 4), "bad": _made(25, 3, 5)}
    groups["flat"][0][:, 2] = 7.0
    groups["bad"][0][0, 0] = np.inf
    got = {r.entity_id: r for r in SL.fit_lasso(_groups(spark, groups), share=0.2).collect()}
    assert {e: r.status for e, r in got.items()} == {"wide": "ok", "other": "ok", "flat": "ok", "few": LN.INSUFFICIENT, "bad": LN.NOT_FINITE}
    for e in ("wide", "other", "flat"):
        x, y = groups[e]
        sd = x.std(0)
        sd[sd == 0] = 1
        z, yc, w = (x - x.mean(0)) / sd, y - y.mean(), np.array(got[e].coef) * sd
        lam = 0.2 * np.abs(z.T @ yc / len(y)).max()
        assert abs(got[e].penalty - lam) < 1e-9
        grad = z.T @ (yc - z @ w) / len(y)
        assert (np.abs(grad) <= lam + 1e-7).all() and np.allclose(grad[w != 0], lam * np.sign(w[w != 0]), atol=1e-7)
        assert abs(got[e].intercept - (y.mean() - x.mean(0) @ np.array(got[e].coef))) < 1e-9
    assert got["flat"].coef[2] == 0


def test_lasso_of_no_rows(spark):
    assert SL.fit_lasso(spark.createDataFrame([], ROWS)).count() == 0


def _greedy(x, y, f_enter):
    out, taken = [], []
    rss = ((y - y.mean()) ** 2).sum()
    while len(taken) < x.shape[1] and len(y) - len(taken) - 2 >= 1:
        best = None
        for j in range(x.shape[1]):
            if j not in taken:
                a = np.column_stack([np.ones(len(y)), x[:, [*taken, j]]])
                r = ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()
                if best is None or r < best[0] - 1e-9:
                    best = (r, j)
        f = (rss - best[0]) / (best[0] / (len(y) - len(taken) - 2))
        if f < f_enter:
            break
        rss = best[0]
        taken.append(best[1])
        out.append((f"f{best[1]}", best[0], f))
    return out


def test_stepwise_takes_the_features_that_a_greedy_search_takes(spark):
    groups = {"a": _made(40, 6, 6), "b": _made(25, 5, 7), "few": _made(4, 2, 8)}
    got = {}
    for r in SL.forward_stepwise(_groups(spark, groups), f_enter=2.0).orderBy("entity_id", "step").collect():
        got.setdefault(r.entity_id, []).append((r.feature, r.rss, r.f))
    assert set(got) == {"a", "b"}
    for e in "ab":
        want = _greedy(*groups[e], 2.0)
        assert [g[0] for g in got[e]] == [w[0] for w in want] and np.allclose([g[1:] for g in got[e]], [w[1:] for w in want], rtol=1e-6)
    assert SL.forward_stepwise(_groups(spark, groups), max_steps=1).filter("entity_id = 'a'").count() == 1


def test_break_is_found_where_it_was_made(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 2))
    y = np.where(np.arange(90) < 55, x[:, 0] * 2 + 1, -x[:, 0] - 3) + rng.normal(size=90) * 0.2
    groups = {"a": (x, y), "short": (x[:8], y[:8])}
    got = {r.entity_id: r for r in LN.break_test(_groups(spark, groups), ["entity_id"], 2).collect()}
    assert got["a"].break_date == dt.date(2000, 1, 1) + dt.timedelta(days=55) and got["a"].n == 90
    assert got["short"].break_date is None and got["short"].sup_f is None

    def rss(a, b):
        d = np.column_stack([np.ones(len(b)), a])
        return ((b - d @ np.linalg.lstsq(d, b, rcond=None)[0]) ** 2).sum()
    best = max(((rss(x, y) - s) / 3) / (s / 84) for r in range(14, 77) for s in [rss(x[:r], y[:r]) + rss(x[r:], y[r:])])
    assert abs(got["a"].sup_f - best) < 1e-6 * best


# ------------------------------------------------------------- point in time

def _plain(requests, vintages, valid):
    out = []
    for s, date, known in requests:
        best = None
        for vs, vd, vk, value in vintages:
            if vs != s or None in (vd, vk, known) or vk > known:
                continue
            if valid == "exact" and vd != date or valid == "upto" and (date is None or vd > date):
                continue
            if best is None or (vd, vk, value) > best:
                best = (vd, vk, value)
        out.append((s, date, known, *((best[2], best[0], best[1]) if best else (None, None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("valid", ["exact", "latest", "upto"])
def test_known_then_is_a_plain_search(spark, valid):
    rng = np.random.default_rng(10)

    def day(k):
        return None if rng.random() < 0.05 else dt.date(2020, 1, 1) + dt.timedelta(days=int(rng.integers(0, k)))
    vintages = [(f"s{rng.integers(0, 3)}", day(15), day(25), float(i)) for i in range(120)]
    vintages += [("s0", dt.date(2020, 1, 3), dt.date(2020, 1, 9), 500.0), ("s0", dt.date(2020, 1, 3), dt.date(2020, 1, 9), 400.0)]    # one moment
    requests = [(f"s{rng.integers(0, 4)}", day(20), day(30)) for _ in range(80)]
    requests += requests[:5]
    v = spark.createDataFrame(vintages, "series_id string, date date, known date, value double").repartition(4)
    r = spark.createDataFrame(requests, "series_id string, date date, known date")
    got = AL.known_then(r, v, valid=valid)
    assert got.columns == ["series_id", "date", "known", "value", "source_date", "source_known"]
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(requests, vintages, valid)
    assert AL.known_then(r, v.limit(0), valid=valid).filter("value IS NOT NULL").count() == 0
    assert AL.known_then(r.limit(0), v, valid=valid).count() == 0


def test_known_then_refuses_an_unknown_kind(spark):
    with pytest.raises(ValueError):
        AL.known_then(spark.range(1), spark.range(1), valid="newest")


def test_known_then_does_not_join_a_grid(spark, capsys):
    v = spark.createDataFrame([("s", dt.date(2020, 1, 1), dt.date(2020, 1, 2), 1.0)], "series_id string, date date, known date, value double")
    AL.known_then(v.select("series_id", "known", F.lit(1).alias("extra")), v).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange") == 1
