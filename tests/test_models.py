import datetime as dt

import numpy as np

from panelcast.operators import evaluate as EV, linear as LN, split as SP


def _rows(spark, X, y, entity="e"):
    feats = [f"f{i}" for i in range(X.shape[1])]
    data = [(entity, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(y[i]), [float(v) for v in X[i]], feats)
            for i in range(len(y))]
    return spark.createDataFrame(data, "entity_id string, date date, y double, x array<double>, features array<string>")


def test_ols_matches_lstsq(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(50, 3))
    y = 0.3 + X @ np.array([0.5, -0.2, 0.1]) + rng.normal(0, 0.1, 50)
    fit = LN.fit_ar(_rows(spark, X, y), ["entity_id"], 3).collect()[0]
    A = np.column_stack([np.ones(50), X])
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    assert abs(fit.intercept - ref[0]) < 1e-9
    assert np.allclose(fit.coef, ref[1:], atol=1e-9)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(40, 5)) * np.array([1, 10, 100, 1000, 1e6]) + 1e7 * np.array([0, 0, 0, 0, 1])
    X[:, 2] = 7.0                                   # constant column scales by 1
    y = rng.normal(size=40)
    fit = LN.fit_ridge(_rows(spark, X, y), ["entity_id"], alpha=1.0).collect()[0]
    mu, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1.0
    Z = (X - mu) / sd
    w = np.linalg.solve(Z.T @ Z + np.eye(5), Z.T @ (y - y.mean()))
    coef = w / sd
    assert np.allclose(fit.coef, coef, rtol=1e-7, atol=1e-12)
    assert abs(fit.intercept - (y.mean() - mu @ coef)) < 1e-6


def test_too_few_rows(spark):
    rng = np.random.default_rng(2)
    X, y = rng.normal(size=(9, 3)), rng.normal(size=9)
    fit = LN.fit_ar(_rows(spark, X, y), ["entity_id"], 3).collect()[0]
    assert fit.status == LN.INSUFFICIENT and fit.coef is None
    X, y = rng.normal(size=(19, 2)), rng.normal(size=19)
    assert LN.fit_ridge(_rows(spark, X, y), ["entity_id"]).collect()[0].status == LN.INSUFFICIENT


def test_predict_and_directional_accuracy(spark):
    df = spark.createDataFrame([("e", y, p) for y, p in [(1.0, 1.0), (-1.0, -1.0), (1.0, 1.0), (1.0, 1.0)]],
                               "entity_id string, y double, prediction double")
    m = EV.metrics(df, ["entity_id"]).collect()[0]
    assert m.directional_accuracy == 1.0 and m.rmse == 0.0 and m.n_predictions == 4


def test_standardise_constant(spark):
    df = spark.createDataFrame([("e", 3.0)] * 4, "entity_id string, v double")
    z = LN.standardise(df, df, ["entity_id"], "v").collect()
    assert all(r.z == 0.0 for r in z)


def _n_rows(spark, n):
    return spark.createDataFrame([("e", "s", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(n)],
                                 "entity_id string, series_id string, date date, value double")


def test_split_truncation(spark):
    sizes = [222, *range(1, 60)]
    rows = [(str(n), "s", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i)) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")
    c = {(int(r.entity_id), r.split): r.rows for r in SP.split_counts(SP.ts_split(df)).collect()}
    assert [c[222, s] for s in ("train", "validation", "test")] == [155, 33, 34]
    for n in sizes:
        assert c.get((n, "train"), 0) == int(n * 0.7) and c.get((n, "validation"), 0) == int(n * 0.15)
        assert sum(v for (m, _), v in c.items() if m == n) == n


def test_fold_bounds_match_python_range(spark):
    for n, expect in ((72, 0), (73, 1), (84, 1), (85, 2), (200, len(range(60, 188, 12)))):
        folds = SP.expanding_folds(_n_rows(spark, n)).orderBy("fold").collect()
        assert len(folds) == expect
        assert [f.n_train for f in folds] == list(range(60, n - 12, 12))
        for f in folds:
            assert f.test_start == dt.date(2000, 1, 1) + dt.timedelta(days=f.n_train)
            assert f.test_end == dt.date(2000, 1, 1) + dt.timedelta(days=f.n_train + 11)


def test_wide_gram_paths_agree(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(300, 12)) * 50 + 1000
    y = X @ rng.normal(size=12) + rng.normal(size=300)
    df = _rows(spark, X, y).repartition(7)            # several partial rows per group
    a = LN.gram(df, ["entity_id"], 12).collect()[0]
    b = LN.gram_any(df, ["entity_id"]).collect()[0]
    assert a.n == b.n == 300
    assert np.allclose(a.xtx, b.xtx, rtol=1e-9) and np.allclose(a.xty, b.xty, rtol=1e-9)
    assert np.allclose(a.mean_x, b.mean_x, rtol=1e-12) and abs(a.yty - b.yty) < 1e-6 * abs(a.yty)
    fa = LN.solve_gram(LN.gram_any(df, ["entity_id"]), ["entity_id"], "ridge", 1.0, True).collect()[0]
    Xc = X - X.mean(0)
    sd = X.std(0)
    w = np.linalg.solve((Xc / sd).T @ (Xc / sd) + np.eye(12), (Xc / sd).T @ (y - y.mean()))
    assert np.allclose(fa.coef, w / sd, rtol=1e-7)


def test_non_finite_feature_is_a_status_not_an_ok_fit(spark):
    rng = np.random.default_rng(6)
    for p, kind in ((3, "ar"), (10, "ridge")):
        X, y = rng.normal(size=(40, p)), rng.normal(size=40)
        X[5, 1] = np.inf
        bad, good = _rows(spark, X, y, "bad"), _rows(spark, np.where(np.isinf(X), 0, X), y, "good")
        both = bad.unionByName(good)
        fits = LN.fit_ar(both, ["entity_id"], p) if kind == "ar" else LN.fit_ridge(both, ["entity_id"])
        got = {r.entity_id: r for r in fits.collect()}
        assert got["bad"].status == LN.NOT_FINITE and got["bad"].coef is None and got["bad"].intercept is None
        assert got["good"].status == "ok" and len(got["good"].coef) == p
        assert LN.predict(both, fits, ["entity_id"]).filter("entity_id = 'bad'").count() == 0


def test_groups_keep_their_own_feature_counts(spark):
    rng = np.random.default_rng(7)
    X5, X4, y = rng.normal(size=(30, 5)), rng.normal(size=(30, 4)), rng.normal(size=30)
    mixed = _rows(spark, X5, y, "m").unionByName(_rows(spark, X4, y, "m"))
    df = _rows(spark, X5, y, "a").unionByName(_rows(spark, X4, y, "b")).unionByName(mixed)
    got = {r.entity_id: r for r in LN.fit_linear(df, ["entity_id"], "var").collect()}
    assert len(got["a"].coef) == 5 and len(got["b"].coef) == 4
    assert got["m"].status == LN.MIXED and got["m"].n_train == 60 and got["m"].coef is None
    ref = np.linalg.lstsq(np.column_stack([np.ones(30), X4]), y, rcond=None)[0]
    assert np.allclose(got["b"].coef, ref[1:])


def test_singular_system_does_not_change_its_neighbours():
    a = np.array([[[2.0, 0.1], [0.1, 3.0]], [[1.0, 1.0], [1.0, 1.0]]])
    b = np.array([[1.0, 2.0], [2.0, 2.0]])
    got = LN.solve_each(a, b)
    assert (got[0] == np.linalg.solve(a[0], b[0])).all()
    assert np.allclose(got[1], [1.0, 1.0])
