import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelcast.operators import align as AL, diagnostics as DG, linear as LN, validation as VL


def _ar_frame(spark, n=120, seed=3, series="s"):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(3, n):
        y[t] = 0.2 + 0.5 * y[t - 1] - 0.2 * y[t - 2] + 0.1 * y[t - 3] + rng.normal()
    rows = []
    for t in range(3, n):
        rows.append(("e", series, dt.date(2000, 1, 1) + dt.timedelta(days=t), float(y[t]),
                     [float(y[t - 1]), float(y[t - 2]), float(y[t - 3])], ["l1", "l2", "l3"]))
    return spark.createDataFrame(rows, "entity_id string, series_id string, date date, y double, "
                                       "x array<double>, features array<string>")


def _ols(X, y):
    A = np.column_stack([np.ones(len(y)), X])
    return np.linalg.lstsq(A, y, rcond=None)[0]


def test_prefix_sum_cv_equals_refitting(spark):
    df = _ar_frame(spark)
    pdf = df.orderBy("date").toPandas()
    X, y = np.stack(pdf.x.to_numpy()), pdf.y.to_numpy()
    n = len(y)
    pred = VL.cv_predictions(df, ["entity_id", "series_id"], 3, 60, 12, 12).orderBy("date").toPandas()
    expect = []
    for e in range(60, n - 12, 12):
        b = _ols(X[:e], y[:e])
        expect += list(b[0] + X[e:e + 12] @ b[1:])
    assert len(pred) == len(expect)
    assert np.allclose(pred.prediction.to_numpy(), expect, atol=1e-8)
    # walk-forward: every row from 60 to n-2 predicted from all earlier rows
    wf = VL.cv_predictions(df, ["entity_id", "series_id"], 3, 60, 1, 1).orderBy("date").toPandas()
    assert len(wf) == len(range(60, n - 1))
    b = _ols(X[:70], y[:70])
    assert abs(wf.prediction.iloc[10] - (b[0] + X[70] @ b[1:])) < 1e-8


def test_chow_matches_numpy(spark):
    df = _ar_frame(spark, n=90)
    got = LN.chow_test(df, ["entity_id", "series_id"], 3).collect()[0]
    pdf = df.orderBy("date").toPandas()
    X, y = np.stack(pdf.x.to_numpy()), pdf.y.to_numpy()
    n, k = len(y), 4

    def ssr(Xs, ys):
        b = _ols(Xs, ys)
        r = ys - (b[0] + Xs @ b[1:])
        return r @ r
    h = np.arange(1, n + 1) > n / 2
    sp, s1, s2 = ssr(X, y), ssr(X[~h], y[~h]), ssr(X[h], y[h])
    f = ((sp - s1 - s2) / k) / ((s1 + s2) / (n - 2 * k))
    assert abs(got.chow_f - f) < 1e-6 * max(1, abs(f))


def test_var_equations_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = []
    vals = {s: 100.0 for s in "ABC"}
    for t in range(40):
        for s in "ABC":
            vals[s] *= 1 + rng.normal(0, 0.02)
            rows.append(("e", s, dt.date(2000 + t // 12, t % 12 + 1, 1), round(vals[s], 4)))
    p = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")
    fits = {r.equation: r for r in LN.fit_linear(LN.var_rows(p), ["entity_id", "equation"], "var", 3).collect()}
    w = p.toPandas().pivot(index="date", columns="series_id", values="value").sort_index()
    m = (w - w.shift(1)) / w.shift(1) * 100
    lag = m.shift(1)
    ok = m.notna().all(axis=1) & lag.notna().all(axis=1)
    for s in "ABC":
        b = _ols(lag[ok].to_numpy(), m[ok][s].to_numpy())
        assert abs(fits[s].intercept - b[0]) < 1e-8 and np.allclose(fits[s].coef, b[1:], atol=1e-8)


def test_correlation_matrix_pairwise_complete(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in "ABCD":
        for t in range(50):
            if s == "D" and t % 7 == 0:
                continue                       # gaps: pairwise-complete semantics
            rows.append(("e", s, dt.date(2000, 1, 1) + dt.timedelta(days=t), float(rng.normal() + t * 0.01)))
    p = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")
    got = {(r.a, r.b): r.correlation for r in DG.correlation_matrix(p).collect()}
    w = p.toPandas().pivot(index="date", columns="series_id", values="value")
    ref = w.corr()
    assert len(got) == 6
    for (a, b), c in got.items():
        assert abs(c - ref.loc[a, b]) < 1e-9


def test_asof_matches_merge_asof(spark):
    rng = np.random.default_rng(11)
    days = sorted(rng.choice(400, 120, replace=False))
    pred = [("e", "P", dt.date(2020, 1, 1) + dt.timedelta(days=int(d)), float(i)) for i, d in enumerate(days)]
    tgt = [("e", dt.date(2020, 1, 1) + dt.timedelta(days=30 * i)) for i in range(14)]
    p = spark.createDataFrame(pred, "entity_id string, series_id string, date date, value double")
    t = spark.createDataFrame(tgt, "entity_id string, date date")
    got = AL.asof_align(t, p, delay_days=10).orderBy("date").toPandas()
    pp = p.toPandas()
    pp["avail"] = pd.to_datetime(pp.date) + pd.Timedelta(days=10)
    tt = t.toPandas()
    tt["d"] = pd.to_datetime(tt.date)
    ref = pd.merge_asof(tt.sort_values("d"), pp.sort_values("avail"), left_on="d", right_on="avail")
    assert got.value.fillna(-1).tolist() == ref.value.fillna(-1).tolist()


def test_streaming_equals_batch(spark):
    from panelcast.sources.views import hourly_events
    from panelcast.streaming.incremental import hourly_panel_incremental
    sf = "/root/testdata/sf0.001"
    s = hourly_panel_incremental(spark, sf).select("series_id", F.col("date").cast("string"), "value")
    b = hourly_events(spark, sf).select("series_id", F.col("date").cast("string"), "value")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_latest_vintage(spark):
    obs = spark.createDataFrame([("s", dt.date(2020, 1, 1), 1.0, 1), ("s", dt.date(2020, 1, 1), 2.0, 3),
                                 ("s", dt.date(2020, 1, 1), 9.0, 2)], "series_id string, date date, value double, vintage int")
    r = AL.latest_vintage(obs).collect()[0]
    assert r.value == 2.0 and r.n_revisions == 3


def test_ridge_fold_fits_equal_refitting(spark):
    df = _ar_frame(spark, n=120)
    pdf = df.orderBy("date").toPandas()
    X, y = np.stack(pdf.x.to_numpy()), pdf.y.to_numpy()
    n = len(y)
    _, fits = VL.ridge_fold_fits(df, ["entity_id", "series_id"], 3, 1.0, 60, 12, 12)
    got = {r.fold: r for r in fits.collect()}
    folds = list(range(60, n - 12, 12))
    assert sorted(got) == list(range(len(folds)))
    for f, e in enumerate(folds):
        Xt, yt = X[:e], y[:e]
        mu, sd = Xt.mean(0), Xt.std(0)
        Z = (Xt - mu) / sd
        w = np.linalg.solve(Z.T @ Z + np.eye(3), Z.T @ (yt - yt.mean()))
        assert got[f].n_train == e
        assert np.allclose(got[f].coef, w / sd, rtol=1e-8, atol=1e-12)
        assert abs(got[f].intercept - (yt.mean() - mu @ (w / sd))) < 1e-8
