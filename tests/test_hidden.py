"""Hidden regimes against the plain recursions, wide lead-lag against shifts, and the bucketed layout's plans."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast import sinks as SK
from panelcast.operators import features as FT, hidden as HD, relate as RL

PANEL = "entity_id string, series_id string, date date, y double"


def _rows(spark, series):
    return spark.createDataFrame([("e", s, dt.date(2000, 1, 1) + dt.timedelta(days=i), None if v is None else float(v))
                                  for s, y in series.items() for i, v in enumerate(y)], PANEL).repartition(3)


def _made(n, seed):
    rng = np.random.default_rng(seed)
    state, out = 0, []
    for _ in range(n):
        state = state if rng.random() < 0.93 else 1 - state
        out.append(rng.normal([0.0, 4.0][state], [1.0, 1.5][state]))
    return out


def _density(v, p):
    if v is None or not np.isfinite(v):
        return np.ones(2)
    b = np.array([np.exp(-(v - p["m" + s]) ** 2 / (2 * p["v" + s])) / np.sqrt(p["v" + s]) for s in "01"])
    return b


def _plain(y, p):
    """Filtered and smoothed probabilities of state 1, and the next parameters."""
    a = np.array([[p["stay0"], 1 - p["stay0"]], [1 - p["stay1"], p["stay1"]]])
    f, know = [], np.array([p["first0"], 1 - p["first0"]])
    for t, v in enumerate(y):
        know = (know if t == 0 else know @ a) * _density(v, p)
        know = know / know.sum()
        f.append(know)
    f = np.array(f)
    g, beta, xi = np.empty_like(f), np.ones(2), np.zeros((2, 2))
    for t in range(len(y) - 1, -1, -1):
        g[t] = f[t] * beta / (f[t] * beta).sum()
        if t:
            x = f[t - 1][:, None] * a * (_density(y[t], p) * beta)[None, :]
            xi += x / x.sum()
            beta = a @ (_density(y[t], p) * beta)
            beta = beta / beta.sum()
    seen = np.array([v is not None and np.isfinite(v) for v in y])
    v = np.array([x if s else 0.0 for x, s in zip(y, seen)], float)
    gs = g * seen[:, None]
    m = (gs * v[:, None]).sum(0) / gs.sum(0)
    var = (gs * (v[:, None] - m) ** 2).sum(0) / gs.sum(0)
    new = {"m0": m[0], "m1": m[1], "v0": var[0], "v1": var[1], "stay0": xi[0, 0] / xi[0].sum(), "stay1": xi[1, 1] / xi[1].sum(), "first0": g[0, 0]}
    return f[:, 1], g[:, 1], new


@pytest.mark.parametrize("block", [1, 7, 256])
def test_probabilities_are_those_of_the_plain_recursion(spark, block):
    series = {"a": _made(60, 1), "b": [*_made(20, 2), None, float("nan"), 1e6, float("inf"), *_made(5, 3)], "flat": [1.0] * 9, "one": [2.0]}
    rows = _rows(spark, series)
    params = HD.start_params(rows)
    got = {}
    for r in HD.probabilities(rows, params, block=block).orderBy("series_id", "date").collect():
        got.setdefault(r.series_id, []).append((r.filtered, r.smoothed))
    assert set(got) == {"a", "b"}
    for r in params.collect():
        f, g, _ = _plain(series[r.series_id], r.asDict())
        assert np.allclose(np.array(got[r.series_id]), np.column_stack([f, g]), atol=1e-9)


def test_expectation_maximisation_is_the_plain_one_and_finds_the_regimes(spark):
    series = {"a": _made(300, 4), "b": _made(120, 5)}
    rows = _rows(spark, series)
    got = {r.series_id: r.asDict() for r in HD.fit(rows, rounds=4, block=32).collect()}
    for r in HD.start_params(rows).collect():
        p = r.asDict()
        for _ in range(4):
            p = {**p, **_plain(series[r.series_id], p)[2]}
        assert np.allclose([got[r.series_id][c] for c in HD.PARAMS], [p[c] for c in HD.PARAMS], atol=1e-8)
    assert abs(got["a"]["m0"]) < 1 and abs(got["a"]["m1"] - 4) < 1.2 and HD.fit(rows.limit(0), rounds=1).count() == 0


def test_all_lags_at_once_are_the_shifted_correlations():
    rng = np.random.default_rng(6)
    y, x = np.cumsum(rng.normal(size=600)), np.cumsum(rng.normal(size=600)) + 1e6
    lags = np.arange(-500, 501)
    got = RL.correlations_at(y, x, lags)
    want = [np.corrcoef(y[k:], x[:600 - k])[0, 1] if k >= 0 else np.corrcoef(y[:600 + k], x[-k:])[0, 1] for k in lags]
    assert np.allclose(got, want, atol=1e-7)
    x[5] = np.inf
    got = RL.correlations_at(y, x, np.array([0, -10]))
    assert np.isnan(got[0]) and abs(got[1] - np.corrcoef(y[:590], x[10:])[0, 1]) < 1e-9
    assert np.isnan(RL.correlations_at(np.ones(9), np.arange(9.0), np.array([0, 1]))).all()


def test_lead_lag_at_once_equals_lead_lag_by_shift(spark):
    rng = np.random.default_rng(7)
    rows = [(e, s, dt.date(2000 + i // 12, i % 12 + 1, 1), float(v)) for e in "xy" for s in ("T", "A b", "C")
            for i, v in enumerate(100 * np.exp(np.cumsum(rng.normal(0, .05, 30 if e == "x" else 9))))]
    panel = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")
    frame = RL.analysis_series(panel, "T")
    key = lambda r: (r.entity_id, r.variable, r.lag)
    one = {key(r): r.correlation for r in RL.lead_lag_all(frame, 6).collect()}
    two = {key(r): r.correlation for r in RL.lead_lag(RL.predictors_long(frame, "y"), 6).collect()}
    assert set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def _plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_bucketed_panel_needs_no_exchange(spark, tmp_path, capsys):
    rows = [(f"e{i % 3}", f"s{i % 5}", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(60)]
    panel = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition",
                                          "spark.sql.sources.bucketing.autoBucketedScan.enabled")}
    try:
        a = SK.write_bucketed(panel, "bucketed_a", str(tmp_path / "a"), 4)
        b = SK.write_bucketed(panel.withColumn("value", F.col("value") * 2), "bucketed_b", str(tmp_path / "b"), 4)
        assert sorted(map(tuple, a.collect())) == sorted(rows)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        lags = FT.lags(FT.mom_pct(a), "mom_pct", 3)
        assert "Exchange" not in _plan(lags, capsys)
        both = a.join(b.withColumnRenamed("value", "other"), ["entity_id", "series_id", "date"])
        assert "Exchange" not in _plan(both, capsys) and both.count() == 60
        assert sorted(map(tuple, lags.collect())) == sorted(map(tuple, FT.lags(FT.mom_pct(panel), "mom_pct", 3).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE IF EXISTS bucketed_a")
        spark.sql("DROP TABLE IF EXISTS bucketed_b")
