import datetime as dt
import math


from panelcast.functions.ieee import ieee_div, ieee_ln
from panelcast.operators import features as FT


def _series(spark, values, start=dt.date(2000, 1, 1), series="s"):
    rows = []
    for i, v in enumerate(values):
        d = dt.date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1)
        rows.append(("e", series, d, None if v is None else float(v)))
    return spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")


def _col(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def test_warm_up(spark):
    df = FT.rolling_features(FT.mom_pct(_series(spark, [1, 2, 4])), means=(3,), stds=())
    assert _col(df, "ma3")[:2] == [None, None]
    assert abs(_col(df, "ma3")[2] - 7 / 3) < 1e-12
    assert _col(df, "mom_pct") == [None, 100.0, 100.0]


def test_null_inside_frame(spark):
    df = FT.rolling_features(_series(spark, [0, 1, 4, 9, None, 25, 36, 49]), means=(3,), stds=())
    got = [None if v is None else round(v, 4) for v in _col(df, "ma3")]
    assert got == [None, None, 1.6667, 4.6667, None, None, None, 36.6667]


def test_zero_base_keeps_rows(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.0, 0.0), (0.0, -3.0), (1.0, None), (3.0, 6.0)], "b double, a double")
    r = df.select(ieee_div("a", "b").alias("q")).collect()
    assert r[0].q == math.inf and math.isnan(r[1].q) and r[2].q == -math.inf
    assert r[3].q is None and r[4].q == 2.0
    ln = spark.createDataFrame([(0.0,), (-1.0,), (math.e,)], "x double").select(ieee_ln("x").alias("l")).collect()
    assert ln[0].l == -math.inf and math.isnan(ln[1].l) and abs(ln[2].l - 1) < 1e-15
    # momentum ratio over a zero base is +inf / NaN and the rows stay
    m = FT.momentum(_series(spark, [0, 1, 1, 1, 1, 1, 5]), ratio_periods=6)
    assert _col(m, "mom6")[6] == math.inf


def test_yoy_is_fraction(spark):
    df = FT.yoy_change(_series(spark, [100] * 12 + [110]))
    assert abs(_col(df, "yoy_change")[12] - 0.10) < 1e-12


def test_pct_change_forward_fills_nulls(spark):
    df = FT.mom_pct(_series(spark, [10, None, 20]))
    assert _col(df, "mom_pct") == [None, 0.0, 100.0]


def test_target_features_types(spark):
    df = FT.target_features(_series(spark, [100, 110, 121]))
    r = df.orderBy("date").collect()
    assert r[1].mom_pct == 10.000000000000009 or abs(r[1].mom_pct - 10) < 1e-9
    assert (r[0].year, r[0].month, r[0].quarter) == (2000, 1, 1)
    assert dict(df.dtypes)["year"] == "bigint"


def test_windows_are_partitioned(spark):
    df = FT.rolling_features(_series(spark, [1, 2, 3, 4]), means=(3, 6), stds=(3,))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan
