import datetime as dt
import json
import os
import shutil
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from panelcast import sinks as SK
from panelcast.sources import observations as OB
from panelcast.schemas import PAYLOAD


def _tmp():
    return tempfile.mkdtemp(prefix="panelcast-test-")


def test_payload_normalise(spark):
    d = _tmp()
    with open(os.path.join(d, "p.json"), "w") as f:
        f.write(json.dumps({"series_id": "X", "observations": [
            {"date": "2020-01-01", "value": "1.5"}, {"date": "2020-02-01", "value": "."},
            {"date": "2020-03-01", "value": "2"}]}) + "\n")
    payload = spark.read.schema(PAYLOAD).json(d)
    rows = OB.normalise(payload).orderBy("date").collect()
    assert [(r.date, r.value) for r in rows] == [(dt.date(2020, 1, 1), 1.5), (dt.date(2020, 3, 1), 2.0)]
    with pytest.raises(ValueError):
        OB.explode_payload(spark.createDataFrame([("X",)], "series_id string"))


def test_cached_series_and_freshness(spark):
    d = _tmp()
    for name, age_days in (("fresh", 0.5), ("edge", 1.9), ("stale", 2.1)):
        p = os.path.join(d, f"{name}.json")
        with open(p, "w") as f:
            json.dump([{"date": "2000-01-01", "value": 1.0, "series_id": name}], f, indent=2)
        t = time.time() - age_days * 86400
        os.utime(p, (t, t))
    allr = OB.read_cached_series(spark, d)
    assert allr.count() == 3 and dict(allr.dtypes)["date"] == "date"
    fresh = {r.series_id for r in OB.read_fresh_series(spark, d, max_age_days=1).collect()}
    assert fresh == {"fresh", "edge"}


def test_rejects_are_kept_aside(spark):
    d = _tmp()
    with open(os.path.join(d, "x.json"), "w") as f:
        f.write('{"date": "2000-01-01", "value": 1.0, "series_id": "a"}\n{not json\n')
    good, bad = OB.read_with_rejects(spark, d)
    assert good.count() == 1 and bad.count() == 1


def test_missing_source(spark):
    with pytest.raises(FileNotFoundError):
        OB.require_source(spark, "/nonexistent/panelcast/path")


def test_date_repair_and_range(spark):
    df = spark.createDataFrame([("a", "2000-01-05", "1"), ("a", "2001-01-05", "2")],
                               "series_id string, date string, value string")
    rep = OB.repair_date(df)
    assert dict(rep.dtypes)["date"] == "date"
    assert OB.date_range(rep, "2000-01-01", "2000-12-31").count() == 1


def test_json_roundtrip_and_nested_blocks(spark):
    d = _tmp()
    rows = [("e", "s", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i), "market") for i in range(25)]
    p = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double, category string")
    SK.write_series_json(p, os.path.join(d, "json"))
    back = OB.read_series_records(spark, os.path.join(d, "json", "category=market"))
    assert back.count() == 25
    blocks = SK.nested_blocks(p, block_size=10).orderBy("block").collect()
    assert [b.n_records for b in blocks] == [10, 10, 5]
    recs = [r for b in blocks for r in json.loads(b.records_json)]
    assert [r["value"] for r in recs] == [float(i) for i in range(25)]


def test_parquet_sink_partitioned_by_category(spark):
    d = _tmp()
    rows = [("e", s, dt.date(2000, 1, 1), 1.0, c) for s, c in (("a", "market"), ("b", "macro"), ("c", "macro"))]
    p = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double, category string")
    SK.write_panel_parquet(p, os.path.join(d, "pq"))
    assert sorted(os.listdir(os.path.join(d, "pq")))[-2:] == ["category=macro", "category=market"]
    back = spark.read.parquet(os.path.join(d, "pq")).filter(F.col("category") == "macro")
    assert back.count() == 2 and "series_id" in back.columns
    SK.write_nested(SK.nested_blocks(p, 10), os.path.join(d, "nested"))
    assert spark.read.json(os.path.join(d, "nested")).count() == 3


def test_multi_file_parquet_scan_keys_by_stem(spark):
    d = _tmp()
    for key in ("target_ppi", "macro_indicators_unrate"):
        spark.createDataFrame([("2000-01-01", 1.0, key.upper())], "date string, value double, series_id string") \
             .coalesce(1).write.parquet(os.path.join(d, "tmp_" + key))
        part = [f for f in os.listdir(os.path.join(d, "tmp_" + key)) if f.endswith(".parquet")][0]
        os.makedirs(os.path.join(d, "all"), exist_ok=True)
        shutil.copyfile(os.path.join(d, "tmp_" + key, part), os.path.join(d, "all", key + ".parquet"))
    df = OB.read_series_files(spark, os.path.join(d, "all"))
    assert sorted(r.key for r in df.collect()) == ["macro_indicators_unrate", "target_ppi"]
    assert dict(df.dtypes)["date"] == "date"
