"""Model comparison: shapes, statuses and values against NumPy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate as EV, forest as FR, linear as LN, trees as TR
from panelcast.plans import comparison as CMP


def _panel(spark):
    """Entity a: whole. b: one predictor, so other features. c: no target. d: too short."""
    rng = np.random.default_rng(3)
    rows = []
    for entity, names, n in (("a", "TAB", 70), ("b", "TA", 70), ("c", "AB", 70), ("d", "TAB", 20)):
        for s in names:
            v = 100.0
            for i in range(n):
                v *= 1 + rng.normal(0, 0.03)
                rows.append((entity, s, dt.date(2000 + i // 12, i % 12 + 1, 1), round(v, 2)))
    return spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")


@pytest.fixture(scope="module")
def compared(spark):
    return CMP.compare(_panel(spark), "T", n_trees=5)


def test_model_table_has_a_row_with_a_reason_for_every_pair(spark, compared):
    t = {(r.entity_id, r.model): r for r in CMP.model_table(compared).collect()}
    assert set(t) == {(e, m) for e in "abcd" for m in ("ar", "ridge", "forest")}
    assert t["a", "ridge"].status == "ok" and t["a", "ridge"].n_features == 75 and t["a", "ar"].n_features == 3
    assert t["b", "ridge"].n_features == 39
    assert t["c", "ar"].status == CMP.NO_ROWS and t["c", "ar"].n_train == 0
    assert t["d", "ridge"].status == LN.INSUFFICIENT and t["d", "ridge"].test_rmse is None
    assert t["a", "forest"].status == t["b", "forest"].status == "ok" and t["b", "forest"].n_features == 39
    for r in t.values():
        if r.status == "ok" and r.model != "forest":
            assert r.train_n_predictions == r.n_train and r.test_n_predictions > 0 and r.train_rmse > 0


def test_best_model_is_the_smallest_test_rmse(spark, compared):
    t = CMP.model_table(compared).collect()
    best = {r.entity_id: r for r in CMP.best_model(compared).collect()}
    assert set(best) == set("abcd") and best["c"].best_model is None
    for e in "ab":
        own = [(r.test_rmse, r.model) for r in t if r.entity_id == e and r.test_rmse is not None]
        assert (best[e].rmse, best[e].best_model) == min(own)


def test_comparison_against_numpy(spark, compared):
    vec = CMP.vectors(CMP.split_matrix(_panel(spark), "T")).filter("entity_id = 'a'").orderBy("date").toPandas()
    train = (vec.split == "train").to_numpy()
    X, y = np.stack(vec.x.to_numpy()), vec.y.to_numpy()
    n = len(y)
    assert train.sum() == int(n * 0.7) and (vec.split == "validation").sum() == int(n * 0.15)
    mu, sd = X[train].mean(0), X[train].std(0)
    sd[sd == 0] = 1
    Z = (X - mu) / sd
    w = np.linalg.solve(Z[train].T @ Z[train] + np.eye(Z.shape[1]), Z[train].T @ (y[train] - y[train].mean()))
    ridge = y[train].mean() + Z @ w
    lags = [list(vec.features.iloc[0]).index(f"mom_pct_lag{k}") for k in (1, 2, 3)]
    A = np.column_stack([np.ones(n), X[:, lags]])
    ar = A @ np.linalg.lstsq(A[train], y[train], rcond=None)[0]
    got = {(r.model, r.split): r for r in compared.metrics.filter("entity_id = 'a'").collect()}
    for model, pred in (("ridge", ridge), ("ar", ar)):
        for split in CMP.SPLITS:
            at = (vec.split == split).to_numpy()
            r = got[model, split]
            assert abs(r.rmse - np.sqrt(((y - pred)[at] ** 2).mean())) < 1e-6
            assert abs(r.mae - np.abs((y - pred)[at]).mean()) < 1e-6
            assert r.n_predictions == at.sum()
    long = {(r.model, r.split, r.metric): r.value
            for r in CMP.metrics_long(compared.metrics.filter("entity_id = 'a'")).collect()}
    assert long["ridge", "test", "rmse"] == got["ridge", "test"].rmse and len(long) == 3 * len(got)


def test_ar_uses_the_lags_that_exist(spark):
    fm = CMP.split_matrix(_panel(spark).filter("entity_id = 'a'"), "T").filter("feature <> 'mom_pct_lag2'")
    vec = CMP.vectors(fm, names=CMP.AR_FEATURES)
    fit = LN.fit_ar(vec.filter("split = 'train'"), CMP.KEYS, None).collect()[0]
    assert fit.status == "ok" and fit.features == ["mom_pct_lag1", "mom_pct_lag3"]


@pytest.fixture(scope="module")
def pooled(spark):
    vec = CMP.vectors(CMP.split_matrix(_panel(spark).filter("entity_id = 'a'"), "T"), 12).cache()
    return vec, vec.filter("split = 'train'")


def test_importances_sum_to_one_in_order(spark, pooled):
    vec, train = pooled
    m = FR.fit_forest(train, n_trees=8)
    names = list(train.first().features)
    imp = FR.importances(m, names, spark).orderBy("rank").collect()
    assert abs(sum(r.importance for r in imp) - 1) < 1e-9 and sorted(r.feature for r in imp) == sorted(names)
    assert [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)
    assert [r["rank"] for r in FR.top_importance(FR.importances(m, names, spark), 3).orderBy("rank").collect()] == [1, 2, 3]


def test_pooled_models_beat_the_mean_on_train(spark, pooled):
    vec, train = pooled
    spread = train.agg(F.stddev_pop("y")).first()[0]
    forest = FR.predict_forest(FR.fit_forest(train, n_trees=8), vec)
    gbt = FR.predict_pooled(FR.fit_pooled(train, "gbt", rounds=10), vec, "gbt")
    for scored in (forest, gbt):
        assert scored.count() == vec.count()
        m = EV.metrics(scored.filter("split = 'train'"), ["model"]).collect()[0]
        assert m.rmse < 0.8 * spread


def test_lasso_meets_its_optimality_conditions(spark, pooled):
    _, train = pooled
    reg = 0.3
    m = FR.fit_pooled(train, "lasso", reg=reg, max_iter=500)
    pdf = train.toPandas()
    X, y = np.stack(pdf.x.to_numpy()), pdf.y.to_numpy()
    sd, sy = X.std(0, ddof=1), y.std(ddof=1)
    beta = m.coefficients.toArray() * sd / sy                     # in the standardised problem
    Z = (X - X.mean(0)) / sd
    r = (y - y.mean()) / sy - Z @ beta
    grad = Z.T @ r / len(y)
    lam = reg / sy
    assert (np.abs(grad) <= lam + 5e-3).all()
    on = np.abs(beta) > 1e-6
    assert np.allclose(grad[on], lam * np.sign(beta[on]), atol=5e-3)


# ------------------------------------------------------------- trees

def _weight(row, tree, seed=TR.SEED):
    a = (row * 7919 + tree * 104729 + seed * 1299709 + 12345) % TR.PRIME
    for c in (1013904223, 362437):
        a = (a * a + c) % TR.PRIME
    return sum(a / TR.PRIME >= p for p in TR.POISSON)


def _tree(x, t, w, depth=None):
    """A recursive fit: (position, left, right) or the value, and what it finds for a row."""
    s, n = int((w * t).sum()), int(w.sum())
    if t.min() == t.max() or depth == 0:
        return s / n / 1e6
    best = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for a, b in zip(v, v[1:]):
            left = x[:, f] <= a
            wl, sl = float(w[left].sum()), float((w * t)[left].sum())
            g = sl * sl / wl + (s - sl) * (s - sl) / (n - wl)
            if best is None or g > best[0]:
                mid = (a + b) / 2
                best = (g, f, mid if mid < b else a)
    if best is None:
        return s / n / 1e6
    left = x[:, best[1]] <= best[2]
    more = None if depth is None else depth - 1
    return best[1], best[2], _tree(x[left], t[left], w[left], more), _tree(x[~left], t[~left], w[~left], more)


def _value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _vectors(spark, entities, p=4, seed=5):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for e, n in entities.items():
        x = np.round(rng.normal(size=(n, p)), 2)
        x[:, 1] = np.round(x[:, 1])                      # ties
        x[0, 2], x[1, 2] = np.inf, -np.inf
        y = np.round(x[:, 0] * 2 + (x[:, 1] > 0) * 3 + rng.normal(size=n) * 0.3, 4)
        x[2], y[2] = x[3], y[3] + 1                      # rows that nothing tells apart
        data[e] = x, y
        rows += [(e, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(y[i]), x[i].tolist(), [f"f{j}" for j in range(p)]) for i in range(n)]
    return spark.createDataFrame(rows, "entity_id string, date date, y double, x array<double>, features array<string>"), data


def test_forest_of_unlimited_depth_is_the_recursive_one(spark):
    df, data = _vectors(spark, {"a": 40, "b": 33, "few": 10})
    nodes, fits = TR.fit_forest(df, n_trees=3)
    assert {r.entity_id: r.status for r in fits.collect()} == {"a": "ok", "b": "ok", "few": LN.INSUFFICIENT}
    assert nodes.agg(F.max("level")).first()[0] > 5
    got = {(r.entity_id, (r.date - dt.date(2000, 1, 1)).days): r.prediction for r in TR.predict(nodes, df, ["entity_id", "date"]).collect()}
    assert {e for e, _ in got} == {"a", "b"}
    for e in "ab":
        x, y = data[e]
        t = np.round(y * 1e6).astype(np.int64)
        want = np.zeros(len(y))
        for k in range(3):
            w = np.array([_weight(i, k) for i in range(len(y))])
            tree = _tree(x[w > 0], t[w > 0], w[w > 0])
            want += np.array([_value(tree, r) for r in x]) / 3
        assert np.allclose([got[e, i] for i in range(len(y))], want, atol=1e-9)


def test_importances_per_entity_sum_to_one(spark):
    df, _ = _vectors(spark, {"a": 40, "b": 33})
    nodes, _ = TR.fit_forest(df, n_trees=3)
    imp = TR.importances(nodes, df.groupBy("entity_id").agg(F.first("features").alias("features"))).collect()
    for e in "ab":
        own = sorted((r for r in imp if r.entity_id == e), key=lambda r: r["rank"])
        assert len(own) == 4 and abs(sum(r.importance for r in own) - 1) < 1e-9 and own[0].feature == "f0"
        assert [r.importance for r in own] == sorted((r.importance for r in own), reverse=True)


def test_boosting_adds_trees_on_the_residual(spark):
    df, data = _vectors(spark, {"a": 35, "b": 31})
    nodes, _ = TR.boost(df, rounds=2, max_depth=2, rate=0.5)
    got = {(r.entity_id, (r.date - dt.date(2000, 1, 1)).days): r.prediction for r in TR.predict_boosted(nodes, df, ["entity_id", "date"]).collect()}
    for e in "ab":
        x, y = data[e]
        p = np.full(len(y), np.round(y * 1e6).mean() / 1e6)
        for _ in range(2):
            tree = _tree(x, np.round((y - p) * 1e6).astype(np.int64), np.ones(len(y), np.int64), 2)
            p = p + 0.5 * np.array([_value(tree, r) for r in x])
        assert np.allclose([got[e, i] for i in range(len(y))], p, atol=1e-6)


def test_trees_share_bins_beyond_the_limit_and_take_no_rows(spark):
    df, data = _vectors(spark, {"a": 60})
    cells = TR.binned(TR.positions(df), 8).collect()
    assert {c.bin for r in cells for c in r.cells} == set(range(1, 9))
    nodes, fits = TR.fit_forest(df.limit(0), n_trees=2)
    assert nodes.count() == 0 and fits.count() == 0 and TR.predict(nodes, df, ["entity_id", "date"]).count() == 0
