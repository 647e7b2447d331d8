"""Cases that broke before: nulls, infinities, several entities, late files,
bad input, and workers started away from the repository."""

import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import diagnostics as DG, linear as LN, quality as QL
from panelcast.operators.quantiles import exact_quantiles
from panelcast.sources import catalog as CT, observations as OB
from panelcast.streaming import incremental as INC

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PANEL = "entity_id string, series_id string, date date, value double"


def _series(values, entity="e", series="s"):
    return [(entity, series, dt.date(2000, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_with_infinities_nulls_and_a_hot_value(spark, parts):
    rng = np.random.default_rng(0)
    groups = {"inf": [1.0, 100.0, 200.0, float("inf")], "one": [5.0], "null": [None, float("nan")],
              "hot": [7.0] * 3000 + rng.normal(size=500).tolist(), "neg": [-float("inf"), 0.0, 1.0]}
    rows = [r for s, v in groups.items() for r in _series(v, series=s)]
    df = spark.createDataFrame(rows, PANEL).repartition(parts)
    got = {r.series_id: r for r in exact_quantiles(df, ["entity_id", "series_id"], "value", (0.25, 0.5, 0.75)).collect()}
    assert set(got) == {"inf", "one", "hot", "neg"}
    assert got["inf"].q50 == 150.0 and got["inf"].q75 == float("inf") and got["one"].q25 == 5.0
    assert got["neg"].q50 == 0.0 and got["neg"].q25 == -float("inf")
    assert np.allclose([got["hot"].q25, got["hot"].q50, got["hot"].q75], np.quantile(groups["hot"], [.25, .5, .75]))


def test_winsorize_keeps_null_and_nan(spark):
    rows = _series([float(i) for i in range(21)] + [None, float("nan")]) + _series([None], series="empty")
    got = DG.winsorize(spark.createDataFrame(rows, PANEL)).collect()
    assert len(got) == 24
    by = {(r.series_id, r.date.day): r for r in got}
    assert by["s", 22].clipped is None and by["s", 22].is_outlier is None and np.isnan(by["s", 23].clipped)
    assert by["s", 1].clipped == by["s", 1].lower == 1.0 and by["s", 1].is_outlier
    assert by["empty", 1].lower is None and by["empty", 1].clipped is None


@pytest.mark.parametrize("block", [1, 2, 256])
def test_correlation_matrix_stays_within_an_entity(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for entity, names in (("x", "ABE"), ("y", "CD")):
        for s in names:
            rows += _series(rng.normal(size=30).tolist(), entity, s)
    p = spark.createDataFrame(rows, PANEL)
    got = {(r.entity_id, r.a, r.b): r for r in DG.correlation_matrix(p, block=block).collect()}
    assert set(got) == {("x", "A", "B"), ("x", "A", "E"), ("x", "B", "E"), ("y", "C", "D")}
    w = p.filter("entity_id = 'x'").toPandas().pivot(index="date", columns="series_id", values="value").corr()
    assert abs(got["x", "A", "E"].correlation - w.loc["A", "E"]) < 1e-12 and got["x", "A", "B"].n == 30


def test_one_id_in_two_categories_does_not_fan_out(spark):
    p = spark.createDataFrame([("s", 1.0, "target"), ("s", 2.0, "macro_indicators")],
                              "series_id string, value double, category string")
    got = CT.catalog_join(p, CT.catalog(p)).collect()
    assert sorted((r.value, r.role) for r in got) == [(1.0, "target"), (2.0, "predictor")]


def test_bad_dates_and_values_are_kept_aside(spark):
    obs = spark.createDataFrame([("s", "2020-01-01", "1.5"), ("s", "not a date", "2"), ("s", "2020-02-30", "3"),
                                 ("s", "2020-03-01", "."), ("s", "2020-04-01", "x"), ("s", None, "4")],
                                "series_id string, date string, value string")
    good = {(str(r.date), r.value) for r in OB.normalise(obs).collect()}
    assert good == {("2020-01-01", 1.5), ("2020-04-01", None)}
    assert sorted(r.reason for r in OB.rejected(obs).collect()) == ["date", "date", "date", "value"]
    assert OB.repair_date(obs).filter("date IS NULL").count() == 3
    assert OB.date_range(OB.normalise(obs)).count() == 2


def test_unreadable_parquet_and_json_lines_are_reported(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    spark.range(5).select(F.col("id").alias("a")).coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "p" / "bad.parquet").write_bytes(b"not parquet at all")
    good, bad = OB.read_parquet_with_rejects(spark, str(tmp_path / "p"), schema)
    assert good.count() == 5 and [os.path.basename(r.path) for r in bad.collect()] == ["bad.parquet"]
    (tmp_path / "j.json").write_text('{"date":"2020-01-01","value":1.0,"series_id":"s"}\n{broken\n\n')
    good, bad = OB.read_with_rejects(spark, str(tmp_path / "j.json"))
    assert good.count() == 1 and [r[0] for r in bad.collect()] == ["{broken"]


def test_missing_and_empty_sources_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        OB.require_source(spark, str(tmp_path / "none"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        OB.require_source(spark, str(tmp_path / "empty"))


def test_quality_report_keeps_entities_apart(spark):
    p = spark.createDataFrame(_series([1.0] * 400, "x") + _series([1.0] * 5, "y"), PANEL)
    got = {r.entity_id: r for r in QL.quality_report(p).collect()}
    assert got["x"].rows == 400 and got["x"].issues == [QL.NO_ISSUES]
    assert got["y"].rows == 5 and got["y"].issues == ["Short time series: 4 days"]


def test_var_fits_an_entity_with_fewer_series(spark):
    rng = np.random.default_rng(2)
    rows = []
    for entity, names in (("five", "ABCDE"), ("four", "ABCD")):
        for s in names:
            rows += [(entity, s, dt.date(2000 + i // 12, i % 12 + 1, 1), float(v))
                     for i, v in enumerate(100 * np.exp(np.cumsum(rng.normal(0, .02, 40))))]
    fits = LN.fit_linear(LN.var_rows(spark.createDataFrame(rows, PANEL)), ["entity_id", "equation"], "var").collect()
    assert {(r.entity_id, len(r.coef)) for r in fits} == {("five", 5), ("four", 4)} and len(fits) == 9


def _event_files(tmp_path, batches):
    import pyarrow as pa
    import pyarrow.parquet as pq
    for i, rows in enumerate(batches):
        t = pa.table({"event_id": [r[0] for r in rows], "ts": pa.array([r[1] for r in rows], pa.timestamp("us")),
                      "user_id": [1] * len(rows), "event_type": [r[2] for r in rows],
                      "value": [float(r[3]) for r in rows], "props": [""] * len(rows)})
        path = tmp_path / f"events_{i}.parquet"
        pq.write_table(t, path)
        os.utime(path, (1e9 + i, 1e9 + i))


DAY = dt.datetime(2024, 1, 10, 5)
BATCHES = [[(1, DAY, "click", 1), (2, DAY, "view", 2)],
           [(3, DAY + dt.timedelta(days=5), "click", 4), (1, DAY, "click", 1)],           # id 1 delivered again
           [(4, DAY - dt.timedelta(days=3), "click", 8), (5, DAY, "view", 16)]]           # late


def _panel_of(spark, out):
    return sorted((r.series_id, str(r.date), r.value, r.n_events) for r in INC.read_panel(spark, out).collect())


EXPECTED = sorted([("click", "2024-01-10 05:00:00", 1.0, 1), ("view", "2024-01-10 05:00:00", 18.0, 2),
                   ("click", "2024-01-15 05:00:00", 4.0, 1), ("click", "2024-01-07 05:00:00", 8.0, 1)])


@pytest.mark.parametrize("per_trigger", [None, 1])
def test_stream_does_not_depend_on_batching(spark, tmp_path, per_trigger):
    (tmp_path / "in").mkdir()
    _event_files(tmp_path / "in", BATCHES)
    out = str(tmp_path / "out")
    INC.run_updates(spark, str(tmp_path / "in"), out, max_files_per_trigger=per_trigger)
    assert _panel_of(spark, out) == EXPECTED


def test_stream_goes_on_replays_and_compacts(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    _event_files(src, BATCHES[:2])
    INC.run_updates(spark, str(src), out, max_files_per_trigger=1)
    before = _panel_of(spark, out)
    INC.compact(spark, out)
    assert _panel_of(spark, out) == before
    _event_files(src, BATCHES)
    INC.run_updates(spark, str(src), out)                     # second run over the same checkpoint: only the new file
    assert _panel_of(spark, out) == EXPECTED
    assert sum(r.n_late for r in INC.read_panel(spark, out).collect()) == 2
    last = max(int(f) for f in os.listdir(os.path.join(out, "_checkpoint", "commits")) if f.isdigit())
    for name in (str(last), f".{last}.crc"):                  # as after a crash: the batch runs again
        os.remove(os.path.join(out, "_checkpoint", "commits", name))
    INC.run_updates(spark, str(src), out)
    assert _panel_of(spark, out) == EXPECTED


def _lose_last_commit(out):
    last = max(int(f) for f in os.listdir(os.path.join(out, "_checkpoint", "commits")) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(os.path.join(out, "_checkpoint", "commits", name))


@pytest.mark.parametrize("state", [False, True])
def test_stream_compacts_with_a_lost_commit_and_crashes(spark, tmp_path, state):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    _event_files(src, [[(10 * i + j, DAY, "click", 1) for j in range(5)] for i in range(3)])
    run = INC.run_state_updates if state else INC.run_updates
    run(spark, str(src), out, max_files_per_trigger=1)
    want = [("click", "2024-01-10 05:00:00", 15.0, 15)]
    assert _panel_of(spark, out) == want
    _lose_last_commit(out)                       # batch 2 has its partials, but will run again
    INC.compact(spark, out)
    assert _panel_of(spark, out) == want and os.listdir(os.path.join(out, "base")) != []
    run(spark, str(src), out, max_files_per_trigger=1)
    assert _panel_of(spark, out) == want
    broken = os.path.join(out, "base", "upto=2")     # a compaction that crashed before its mark
    os.makedirs(broken)
    (tmp_path / "out" / "base" / "upto=2" / "part-0.parquet").write_bytes(b"half a file")
    assert _panel_of(spark, out) == want
    INC.compact(spark, out)
    INC.compact(spark, out)
    assert _panel_of(spark, out) == want
    assert [n for n in os.listdir(os.path.join(out, "partials")) if n.startswith("batch_id=")] == []


NULLS = [[(None, DAY, "click", 1), (None, DAY, "click", 2), (None, DAY, "click", 1)], [(None, DAY, "click", 2), (7, None, "view", 5)],
         [(7, None, "view", 5), (8, DAY, "view", 3)]]


def test_events_without_id_are_known_by_their_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _event_files(tmp_path / "in", NULLS)
    INC.run_updates(spark, str(tmp_path / "in"), str(tmp_path / "a"), max_files_per_trigger=1)
    assert sorted(_panel_of(spark, str(tmp_path / "a"))) == [("click", "2024-01-10 05:00:00", 3.0, 2), ("view", "2024-01-10 05:00:00", 3.0, 1),
                                                           ("view", "None", 5.0, 1)]
    INC.run_state_updates(spark, str(tmp_path / "in"), str(tmp_path / "b"), max_files_per_trigger=1)
    assert _panel_of(spark, str(tmp_path / "b")) == [("click", "2024-01-10 05:00:00", 3.0, 2), ("view", "2024-01-10 05:00:00", 3.0, 1)]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_state_does_not_depend_on_file_order_within_the_horizon(spark, tmp_path, order):
    (tmp_path / "in").mkdir()
    _event_files(tmp_path / "in", [BATCHES[i] for i in order])
    got = INC.run_state_updates(spark, str(tmp_path / "in"), str(tmp_path / "out"), horizon="10 days", max_files_per_trigger=1)
    assert _panel_of(spark, str(tmp_path / "out")) == EXPECTED
    assert got["duplicates"] == 1 and got["rejected"] == 0


def test_state_rejects_what_is_older_than_the_horizon_and_expires(spark, tmp_path):
    (tmp_path / "in").mkdir()
    far = [(9, DAY + dt.timedelta(days=40), "click", 32)]
    _event_files(tmp_path / "in", [*BATCHES[:2], far, [(1, DAY, "click", 1), (20, DAY, "click", 64)]])
    out = str(tmp_path / "out")
    got = INC.run_state_updates(spark, str(tmp_path / "in"), out, horizon="1 day", max_files_per_trigger=1)
    assert got["rejected"] >= 2 and got["ids"] == 1            # the replayed id 1 and the late 20; older ids have left the state
    panel = {(r[0], r[1]): r[3] for r in _panel_of(spark, out)}
    assert panel["click", "2024-01-10 05:00:00"] == 1 and panel["click", "2024-02-19 05:00:00"] == 1


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = (f"import sys; sys.path.insert(0, {REPO!r})\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "for n in ('eval_metrics', 'chow_break', 'corr_matrix'):\n"
            "    print(n, E.queries()[n](s, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "eval_metrics 20" in done.stdout and "corr_matrix 300" in done.stdout
