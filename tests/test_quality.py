import datetime as dt

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from panelcast.operators import quality as QL
from panelcast.operators.quantiles import exact_quantiles


def test_duplicates_with_null_fields(spark):
    df = spark.createDataFrame([("e", "s", None, 1.0), ("e", "s", None, 1.0)],
                               "entity_id string, series_id string, date date, value double")
    assert QL.duplicate_count(df).collect()[0].duplicate_rows == 1


def test_quality_report_issues(spark):
    rows = [("e", "short", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(30)]
    rows += [("e", "long", dt.date(2000, 1, 1) + dt.timedelta(days=30 * i), None if i == 3 else float(i))
             for i in range(40)]
    rows += [rows[-1]]
    df = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")
    cat = spark.createDataFrame([("e", "short"), ("e", "long"), ("e", "empty")], "entity_id string, series_id string")
    rep = {r.name: r for r in QL.quality_report(df, cat).collect()}
    assert rep["short"].issues == ["Short time series: 29 days"]
    assert rep["long"].issues == ["Missing values: 1", "Duplicate rows: 1"]
    assert rep["empty"].status == "empty" and rep["empty"].issues == ["No data available"]
    assert rep["short"].date_range == "2020-01-01 to 2020-01-30"


def test_exact_quantiles_match_pandas_with_hot_group(spark):
    rng = np.random.default_rng(7)
    hot = rng.lognormal(3, 2, 30_000)              # one group holds most rows
    small = rng.normal(0, 1, 50)
    ties = np.repeat([1.0, 2.0, 3.0], 2_000)
    pdf = pd.concat([pd.DataFrame({"g": "hot", "v": hot}), pd.DataFrame({"g": "small", "v": small}),
                     pd.DataFrame({"g": "ties", "v": ties})])
    df = spark.createDataFrame(pdf)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", (0.25, 0.5, 0.75)).collect()}
    for g, grp in pdf.groupby("g"):
        for p in (0.25, 0.5, 0.75):
            ref = grp["v"].quantile(p)
            assert abs(getattr(got[g], f"q{int(p * 100)}") - ref) <= 1e-9 * max(1.0, abs(ref)), (g, p)


def test_head_sample_is_per_series(spark):
    rows = [("e", s, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i)) for s in "ab" for i in range(9)]
    df = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")
    h = QL.head_sample(df, 5).collect()
    assert len(h) == 10 and max(r.value for r in h) == 4.0


def test_sketches_merge_within_their_rank_error(spark):
    import numpy as np
    from panelcast.operators import sketches as SK
    rng = np.random.default_rng(11)
    values = {"a": rng.normal(size=30_000), "hot": np.where(rng.random(20_000) < 0.4, 7.0, rng.exponential(size=20_000) * 10), "few": np.arange(9.0)}
    import pandas as pd
    pdf = pd.concat([pd.DataFrame({"entity_id": "e", "series_id": s, "date": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(v)) % 20, "D"),
                                   "value": v}) for s, v in values.items()])
    pdf = pd.concat([pdf, pd.DataFrame({"entity_id": "e", "series_id": "none", "date": pd.Timestamp("2024-01-01"), "value": [float("nan")] * 3})])
    df = spark.createDataFrame(pdf).repartition(5)
    daily = SK.day_sketches(df)
    assert daily.count() == 20 + 20 + 9 + 1
    probs = (0.05, 0.25, 0.5, 0.75, 0.95)
    got = {r.series_id: r for r in SK.quantiles(SK.merged(daily), probs).collect()}
    assert got["none"].n == 0 and got["none"].n_missing == 3 and got["none"].q50 is None
    for s, v in values.items():
        r = got[s]
        assert (r.n, r.min, r.max) == (len(v), v.min(), v.max())
        for p in probs:
            q = r[f"q{round(p * 100)}"]
            low, high = (v < q).mean(), (v <= q).mean()                       # ranks that ties share
            assert low - SK.rank_error() - 1 / len(v) <= p <= high + SK.rank_error() + 1 / len(v), (s, p, q)
    part = {r.series_id: r for r in SK.merged(daily, ["entity_id"], "2024-01-03", "2024-01-04").select(
        F.lit("all").alias("series_id"), "n").collect()}
    assert part["all"].n == 2 * (1500 + 1000 + 1)
    assert SK.merged(daily.limit(0)).count() == 0
