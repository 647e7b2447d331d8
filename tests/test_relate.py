import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelcast.operators import relate as RL, matrix as MX


def _panel(spark, n=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s, scale in (("T", 1.0), ("A", 2.0), ("B", 3.0)):
        v = 100.0
        for i in range(n):
            v = v * (1 + rng.normal(0, 0.02 * scale))
            d = dt.date(2000 + i // 12, i % 12 + 1, 1)
            rows.append(("e", s, d, round(v, 2)))
    return spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")


def _pandas_reference(pdf, target="T"):
    """Brute force with pandas: wide frame, inner join, drop nulls, corr."""
    import pandas as pd
    pdf = pdf.sort_values("date")
    t = pdf[pdf.series_id == target].set_index("date")["value"]
    y = ((t - t.shift(1)) / t.shift(1) * 100).rename("mom_pct")
    cols = []
    for s in sorted(set(pdf.series_id) - {target}):
        v = pdf[pdf.series_id == s].set_index("date")["value"]
        k = s.lower()
        cols += [v.rename(f"{k}_level"), ((v - v.shift(1)) / v.shift(1) * 100).rename(f"{k}_mom_pct"),
                 v.rolling(3).mean().rename(f"{k}_ma3"), v.rolling(3).std().rename(f"{k}_vol3")]
    wide = pd.concat(cols, axis=1)
    a = pd.concat([y, wide], axis=1, join="inner").dropna()
    return a


def test_corr_rank_matches_pandas(spark):
    p = _panel(spark)
    got = {r.variable: r.correlation for r in RL.corr_rank(p, "T").collect()}
    a = _pandas_reference(p.toPandas())
    for c in a.columns[1:]:
        assert abs(got[c] - a["mom_pct"].corr(a[c])) < 1e-9


def test_long_and_wide_agree(spark):
    p = _panel(spark)
    wide = RL.complete_cases(RL.target_join(p, "T"))
    long = RL.analysis_frame(p, "T")
    assert wide.count() == long.select("date").distinct().count()
    a = _pandas_reference(p.toPandas())
    assert wide.count() == len(a)


def test_lead_lag_positions(spark):
    p = _panel(spark)
    ll = {(r.variable, r.lag): r.correlation
          for r in RL.lead_lag(RL.predictors_long(RL.analysis_series(p, "T"), "y"), 3).collect()}
    a = _pandas_reference(p.toPandas()).reset_index(drop=True)
    for lag in range(-3, 4):
        if lag >= 0:
            ref = a["mom_pct"].corr(a["a_level"].shift(lag))
        else:
            ref = a["mom_pct"].shift(-lag).corr(a["a_level"])
        assert abs(ll[("a_level", lag)] - ref) < 1e-9


def test_constant_predictor_correlation_dropped(spark):
    rows = [("e", "T", dt.date(2000, 1 + i, 1), float(100 + i * i)) for i in range(8)]
    rows += [("e", "C", dt.date(2000, 1 + i, 1), 5.0) for i in range(8)]
    p = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")
    vars_ = {r.variable for r in RL.corr_rank(p, "T").collect()}
    assert "c_level" not in vars_


def test_feature_matrix_shape(spark):
    p = _panel(spark, n=60)
    fm = MX.feature_matrix(RL.analysis_series(p, "T"), max_lags=3)
    per_date = fm.groupBy("date").count().select("count").distinct().collect()
    # 8 variables: 8 + 8*3 + 3 + 8*3 + 8*2 = 75 features per date
    assert [r[0] for r in per_date] == [75]
    ords = sorted(r.ordinal for r in fm.select("ordinal").distinct().collect())
    assert ords == list(range(75))


def test_pivot_equals_chained_full_joins(spark):
    p = _panel(spark)
    _, preds = RL.role_split(p, "T")
    from panelcast.operators.features import predictor_features
    pf = predictor_features(preds)
    a = pf.filter(F.col("series_id") == "A").select("entity_id", "date", F.col("level").alias("a_level"))
    b = pf.filter(F.col("series_id") == "B").select("entity_id", "date", F.col("level").alias("b_level"))
    chained = RL.full_join_pair(a, b).orderBy("date").collect()
    wide = RL.predictors_wide(p, "T", ["a_level", "b_level"]).orderBy("date").collect()
    assert [(r.date, r.a_level, r.b_level) for r in chained] == [(r.date, r.a_level, r.b_level) for r in wide]


def _twins(spark, n=40):
    """Predictors whose names make one column name."""
    p = _panel(spark, n)
    twin = p.filter("series_id = 'B'").withColumn("series_id", F.lit("A-B")).unionByName(
        p.filter("series_id = 'A'").withColumn("series_id", F.lit("A B")))
    return p.filter("series_id = 'T'").unionByName(twin)


def test_series_with_one_shown_name_stay_apart(spark):
    import pytest
    p = _twins(spark)
    fm = MX.feature_matrix(RL.analysis_series(p, "T"))
    assert fm.groupBy("date", "ordinal").count().filter("count > 1").count() == 0
    own = MX.feature_matrix(RL.analysis_series(p.filter("series_id <> 'A B'"), "T"))
    mine = {(r.date, r.feature): r.value for r in own.filter("feature like 'a_b_level%'").collect()}
    twins = [r for r in fm.filter("feature like 'a_b_level%'").collect()]
    for (date, feature), value in mine.items():
        assert value in [r.value for r in twins if (r.date, r.feature) == (date, feature)]
    long = RL.predictors_long(RL.analysis_series(p, "T"), "y")
    assert RL.lead_lag(long, 2).groupBy("series_id", "feature_idx", "lag").count().filter("count > 1").count() == 0
    with pytest.raises(ValueError):
        RL.predictors_wide(p, "T")
    with pytest.raises(Exception, match="share a column name"):
        RL.predictors_wide(p, "T", ["a_b_level"]).collect()


def test_predictor_cap_is_opt_in(spark):
    p = _panel(spark, n=40)
    names = lambda fm: {r.feature for r in fm.select("feature").distinct().collect()}
    every, few = (names(MX.feature_matrix(RL.analysis_series(p, "T"), n_predictors=k)) for k in (None, 2))
    assert {"b_vol3", "b_vol3_mom6"} <= every and "b_vol3" not in few and "a_mom_pct" in few
