"""Registered queries: Spark plan, DuckDB oracle and presentation spec.

Every query reads the landed tables (through the panel views) at whatever
scale they are, with no row caps; limits appear only where they are the
feature (top-k, head samples).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelcast.functions.present import Spec, present, present_sql
from panelcast.plans import oracle_sql as S
from panelcast.operators import features as FT, relate as RL
from panelcast.session import Spool, materialize, ship_package
from panelcast.sources.views import panel_view

# The flagship target series and the other four order priorities.
TARGET = "1-URGENT"
PRIORITY_KEYS = ("2_high", "3_medium", "4_not_specified", "5_low")
WIDE_VARS = tuple(f"{k}_{f}" for k in PRIORITY_KEYS for f in RL.FEATURE_SUFFIXES)    # result columns shown


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    spec: Spec
    sql: str | None = None          # None: no SQL oracle (rows-only check)
    notes: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, spec: Spec, sql: str | None = None, notes: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(fn, spec, sql, notes)
        return fn
    return deco


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return present(q.build(spark, sf_dir), q.spec)
    return run


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    return None if q.sql is None else present_sql(q.sql, q.spec)


PANEL_SPEC = [("entity_id", "s"), ("series_id", "s"), ("date", "d"), ("value", 2)]

# --------------------------------------------------------------- step 1


@register("scan_panel", PANEL_SPEC,
          S.with_(S.panel_cte("monthly_orders")) + " SELECT * FROM panel")
def _scan_panel(spark, d):
    return panel_view(spark, d, "monthly_orders")


@register("mom_pct", PANEL_SPEC + [("mom_pct", 6)],
          S.with_(S.panel_cte("supplier_monthly"))
          + f" SELECT *, {S.mom_expr()} AS mom_pct FROM panel")
def _mom_pct(spark, d):
    return FT.mom_pct(panel_view(spark, d, "supplier_monthly"))


@register("target_join",
          [("entity_id", "s"), ("date", "d"), ("mom_pct", 6)]
          + [(v, 6 if v.endswith("mom_pct") else 2) for v in WIDE_VARS],
          S.with_(*S.analysis_ctes("monthly_orders", TARGET)[:5])
          + " SELECT ty.entity_id, ty.date, ty.mom_pct, "
          + ", ".join(f"max(CASE WHEN variable = '{v}' THEN x END) AS \"{v}\"" for v in WIDE_VARS)
          + " FROM ty JOIN pl ON ty.entity_id = pl.entity_id AND ty.date = pl.date"
            " GROUP BY 1, 2, 3")
def _target_join(spark, d):
    return RL.target_join(panel_view(spark, d, "monthly_orders"), TARGET)


@register("corr_rank", [("entity_id", "s"), ("rank", "i"), ("variable", "s"), ("correlation", 6)],
          S.with_(*S.corr_ctes("monthly_orders", TARGET))
          + " SELECT entity_id, rank, variable, correlation FROM rk")
def _corr_rank(spark, d):
    return RL.corr_rank(panel_view(spark, d, "monthly_orders"), TARGET)

# --------------------------------------------------------------- step 2: ingest and sinks

from panelcast.sources import observations as OB, catalog as CT  # noqa: E402
from panelcast import sinks as SK  # noqa: E402
from panelcast.sources import views as VW  # noqa: E402


@register("obs_normalise", [("series_id", "s"), ("date", "d"), ("value", 2)],
          f"SELECT series_id, CAST(date AS DATE) AS date, TRY_CAST(value AS DOUBLE) AS value"
          f" FROM ({S.raw_obs_sql()}) r WHERE value <> '.'")
def _obs_normalise(spark, d):
    return OB.normalise(OB.raw_observations(spark, d))


RANGE = ("1996-01-01", "1997-12-31")


@register("obs_date_range", PANEL_SPEC,
          S.with_(S.panel_cte("daily_ship"))
          + f" SELECT * FROM panel WHERE date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'")
def _obs_date_range(spark, d):
    return VW.daily_ship(spark, d, *RANGE)


@register("date_repair", [("series_id", "s"), ("date", "d"), ("n_obs", "i"), ("n_missing", "i")],
          f"SELECT series_id, CAST(date AS DATE) AS date, count(*) AS n_obs,"
          f" sum(CASE WHEN value = '.' THEN 1 ELSE 0 END) AS n_missing"
          f" FROM ({S.raw_obs_sql()}) r GROUP BY 1, 2")
def _date_repair(spark, d):
    from pyspark.sql import functions as F
    rep = OB.repair_date(OB.raw_observations(spark, d))
    return rep.groupBy("series_id", "date").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum((F.col("value") == ".").cast("int")).alias("n_missing"))


CAT_SPEC = [("series_id", "s"), ("date", "d"), ("value", 2), ("category", "s"),
            ("role", "s"), ("key", "s")]


@register("catalog_join", CAT_SPEC,
          S.with_(*S.collected_ctes())
          + " SELECT series_id, date, value, category, CASE category WHEN 'target' THEN 'target' ELSE 'predictor' END"
            " AS role, category || '_' || lower(series_id) AS key FROM cp")
def _catalog_join(spark, d):
    cp = materialize(CT.collected_panel(spark, d))
    return CT.catalog_join(cp.drop("entity_id"), CT.catalog(cp))


@register("panel_union", PANEL_SPEC + [("category", "s")],
          S.with_(*S.collected_ctes()) + " SELECT * FROM cp")
def _panel_union(spark, d):
    return CT.collected_panel(spark, d)


@register("panel_keys", [("category", "s"), ("series_id", "s"), ("key", "s")],
          S.with_(*S.collected_ctes()) + " SELECT * FROM keys")
def _panel_keys(spark, d):
    return CT.series_keys(CT.collected_panel(spark, d))


@register("role_split", CAT_SPEC,
          S.with_(*S.collected_ctes())
          + " SELECT series_id, date, value, category, 'predictor' AS role, category || '_' || lower(series_id) AS key"
            " FROM cp WHERE category <> 'target'")
def _role_split(spark, d):
    from pyspark.sql import functions as F
    cp = materialize(CT.collected_panel(spark, d))
    joined = CT.role_of_key(CT.catalog_join(cp.drop("entity_id"), CT.catalog(cp)))
    return joined.filter(F.col("role") == "predictor")


@register("project_cols",
          [("entity_id", "s"), ("date", "d"), ("mom_pct", 6)]
          + [(v, 6 if v.endswith("mom_pct") else 2) for v in WIDE_VARS[:10]],
          S.with_(*S.analysis_ctes("monthly_orders", TARGET)[:5])
          + " SELECT ty.entity_id, ty.date, ty.mom_pct, "
          + ", ".join(f"max(CASE WHEN variable = '{v}' THEN x END) AS \"{v}\"" for v in WIDE_VARS[:10])
          + " FROM ty JOIN pl ON ty.entity_id = pl.entity_id AND ty.date = pl.date GROUP BY 1, 2, 3")
def _project_cols(spark, d):
    tj = RL.target_join(panel_view(spark, d, "monthly_orders"), TARGET)
    return tj.select("entity_id", "date", "mom_pct", *[f"`{v}`" for v in WIDE_VARS[:10]])


@register("nested_export",
          [("category", "s"), ("series_id", "s"), ("block", "i"), ("n_records", "i"),
           ("first_date", "d"), ("last_date", "d"), ("value_sum", 2), ("records_md5", "s")],
          S.with_(*S.collected_ctes())
          + " SELECT category, series_id, block, count(*) AS n_records, min(date) AS first_date,"
            " max(date) AS last_date, sum(value) AS value_sum, md5(string_agg(strftime(date, '%Y-%m-%d') || '=' ||"
            " CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '=' || series_id, ',' ORDER BY date)) AS records_md5"
            " FROM (SELECT *, CAST(floor((row_number()"
            " OVER (PARTITION BY category, series_id ORDER BY date) - 1) / 512) AS BIGINT) AS block"
            " FROM cp) b GROUP BY 1, 2, 3")
def _nested_export(spark, d):
    from pyspark.sql import functions as F
    blocks = SK.nested_blocks(CT.collected_panel(spark, d), 512)
    text = F.array_join(F.transform("records", lambda r: F.concat_ws(
        "=", r["date"].cast("string"), F.round(r["value"] * 100).cast("bigint").cast("string"), r["series_id"])), ",")
    return blocks.withColumn("records_md5", F.md5(F.encode(text, "UTF-8")))


def _landed(spark, write) -> str:
    """A folder of the shared area that ``write`` has filled; it goes when the driver ends."""
    sp = Spool(spark)
    sp.append(f"{sp.base}/landed")
    write(sp[0])
    return sp[0]


@register("series_json", [("category", "s"), ("series_id", "s"), ("date", "d"), ("value", 2)],
          S.with_(*S.collected_ctes()) + " SELECT category, series_id, date, value FROM cp",
          notes="written as JSON records per category and read back with the freshness rule")
def _series_json(spark, d):
    from pyspark.sql import functions as F
    path = _landed(spark, lambda p: SK.write_series_json(CT.collected_panel(spark, d), p))
    fresh = OB.read_fresh_series(spark, path, multi_line=False)
    return fresh.withColumn("category", F.regexp_extract(F.col("_metadata.file_path"), "category=([^/]+)/", 1))


@register("panel_parquet", PANEL_SPEC + [("category", "s")],
          S.with_(*S.collected_ctes()) + " SELECT * FROM cp",
          notes="written as Parquet by category, then read as a required source")
def _panel_parquet(spark, d):
    return OB.require_source(spark, _landed(
        spark, lambda p: SK.write_panel_parquet(CT.collected_panel(spark, d), p)))


@register("series_files", [("key", "s"), ("series_id", "s"), ("n", "i"), ("first_date", "d"), ("value", 2)],
          S.with_(S.panel_cte("daily_ship"))
          + " SELECT 'part' AS key, series_id, count(*) AS n, min(date) AS first_date, sum(value) AS value"
            " FROM panel GROUP BY 1, 2",
          notes="multi-file scan keyed by file stem; text dates repaired")
def _series_files(spark, d):
    from pyspark.sql import functions as F
    text = panel_view(spark, d, "daily_ship").withColumn("date", F.col("date").cast("string"))
    path = _landed(spark, lambda p: text.repartition("series_id").write.parquet(p))
    rows = OB.read_series_files(spark, path).withColumn("key", F.regexp_extract("key", "^([a-z]+)", 1))
    return rows.groupBy("key", "series_id").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"),
                                                F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))


@register("series_stems", [("key", "s"), ("series_id", "s"), ("n", "i"), ("first_date", "d"), ("value", 2)],
          S.with_(S.panel_cte("daily_ship"))
          + " SELECT 'market_' || lower(series_id) AS key, series_id, count(*) AS n, min(date) AS first_date, sum(value) AS value"
            " FROM panel GROUP BY 1, 2",
          notes="a file for each series, named by its key; the key is read back from the name")
def _series_stems(spark, d):
    from pyspark.sql import functions as F
    p = panel_view(spark, d, "daily_ship").withColumn("date", F.col("date").cast("string"))
    p = p.withColumn("key", F.concat(F.lit("market_"), F.lower("series_id")))
    rows = OB.read_series_files(spark, _landed(spark, lambda path: SK.write_series_files(p, path)))
    return rows.groupBy("key", "series_id").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"),
                                                F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))


def _age_files(spark, folder: str, days: float) -> None:
    """Makes the files of a folder look ``days`` old."""
    import time
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(top):
        if f.isFile():
            fs.setTimes(f.getPath(), int((time.time() - days * 86400) * 1000), -1)


@register("fresh_files", [("category", "s"), ("series_id", "s"), ("date", "d"), ("value", 2)],
          S.with_(*S.collected_ctes()) + " SELECT category, series_id, date, value FROM cp WHERE category <> 'bond_market'",
          notes="one category's files are 2.1 days old and refused, another's are 1.9 days old and used")
def _fresh_files(spark, d):
    from pyspark.sql import functions as F
    path = _landed(spark, lambda p: SK.write_series_json(CT.collected_panel(spark, d), p))
    _age_files(spark, f"{path}/category=bond_market", 2.1)
    _age_files(spark, f"{path}/category=macro_indicators", 1.9)
    fresh = OB.read_fresh_series(spark, path, multi_line=False)
    return fresh.withColumn("category", F.regexp_extract(F.col("_metadata.file_path"), "category=([^/]+)/", 1))


@register("tolerant_json", [("series_id", "s"), ("n_good", "i"), ("n_rejected", "i")],
          "SELECT event_type AS series_id, count(*) FILTER (WHERE event_id % 17 <> 0) AS n_good,"
          " count(*) FILTER (WHERE event_id % 17 = 0) AS n_rejected FROM events GROUP BY 1",
          notes="JSON lines of which every 17th is cut off; rejects are kept aside")
def _tolerant_json(spark, d):
    from pyspark.sql import functions as F
    ev = VW.read_table(spark, d, "events", ["event_id", "event_type", "ts", "value"])
    line = F.to_json(F.struct(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("date"), "value"))
    cut = F.when(F.col("event_id") % 17 == 0, F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    lines = ev.withColumn("line", line).select(cut.alias("value"))
    good, bad = OB.read_with_rejects(spark, _landed(spark, lambda p: lines.write.text(p)))
    name = F.regexp_extract("_corrupt_record", '"series_id":"([^"]*)"', 1)
    both = good.select("series_id", F.lit(1).alias("g")).unionByName(bad.select(name.alias("series_id"), F.lit(0).alias("g")))
    return both.groupBy("series_id").agg(F.sum("g").alias("n_good"), F.sum(1 - F.col("g")).alias("n_rejected"))


@register("rejected_observations", [("series_id", "s"), ("reason", "s"), ("n", "i")],
          "SELECT event_type AS series_id, CASE WHEN event_id % 13 = 0 THEN 'date' ELSE 'value' END AS reason,"
          " count(*) AS n FROM events WHERE event_id % 13 = 0 OR (event_id % 11 = 0 AND event_id % 17 <> 0) GROUP BY 1, 2",
          notes="observations whose date or value does not parse")
def _rejected_obs(spark, d):
    from pyspark.sql import functions as F
    ev = VW.read_table(spark, d, "events", ["event_id", "event_type", "ts", "value"])
    obs = ev.select(F.col("event_type").alias("series_id"),
                    F.when(F.col("event_id") % 13 == 0, F.lit("2024-02-31")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
                    .alias("date"),
                    F.when(F.col("event_id") % 17 == 0, F.lit(".")).when(F.col("event_id") % 11 == 0, F.lit("n/a"))
                    .otherwise(F.col("value").cast("string")).alias("value"))
    return OB.rejected(obs).groupBy("series_id", "reason").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- step 3: statistics and quality

from panelcast.operators import quality as QL, sketches as SKT  # noqa: E402

STAT_SQL = ("SELECT entity_id, series_id, count({v}) AS count, avg({v}) AS mean,"
            " stddev_samp({v}) AS std, min({v}) AS min, max({v}) AS max FROM {src} GROUP BY 1, 2")


def _stat_spec(dp):
    return [("entity_id", "s"), ("series_id", "s"), ("count", "i"), ("mean", 6), ("std", dp),
            ("min", dp), ("max", dp)]


@register("value_stats", _stat_spec(2),
          S.with_(S.panel_cte("supplier_monthly")) + " " + STAT_SQL.format(v="value", src="panel"))
def _value_stats(spark, d):
    return QL.value_stats(panel_view(spark, d, "supplier_monthly"))


@register("mom_stats", _stat_spec(6),
          S.with_(S.panel_cte("supplier_monthly"),
                  f"m AS (SELECT *, {S.mom_expr()} AS mom_pct FROM panel)")
          + " " + STAT_SQL.format(v="mom_pct", src="m"))
def _mom_stats(spark, d):
    return QL.value_stats(FT.mom_pct(panel_view(spark, d, "supplier_monthly")), "mom_pct")


@register("describe_quartiles",
          _stat_spec(2) + [("q25", 4), ("q50", 4), ("q75", 4)],
          S.with_(S.panel_cte("supplier_monthly"))
          + " SELECT entity_id, series_id, count(value) AS count, avg(value) AS mean,"
            " stddev_samp(value) AS std, min(value) AS min, max(value) AS max,"
            " quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,"
            " quantile_cont(value, 0.75) AS q75 FROM panel GROUP BY 1, 2")
def _describe_quartiles(spark, d):
    return QL.describe(panel_view(spark, d, "supplier_monthly"))


@register("sketch_extent", [("series_id", "s"), ("n", "i"), ("n_missing", "i"), ("min", 2), ("max", 2)],
          "SELECT event_type AS series_id, count(value) AS n, 0 AS n_missing, min(value) AS min, max(value) AS max FROM events GROUP BY 1",
          notes="daily sketches, written and merged over all days; the parts of a sketch that are exact")
def _sketch_extent(spark, d):
    from pyspark.sql import functions as F
    ev = VW.read_table(spark, d, "events", ["event_type", "ts", "value"]).withColumnRenamed("event_type", "series_id")
    daily = materialize(SKT.day_sketches(ev, ["series_id"], F.col("ts")))
    return SKT.quantiles(SKT.merged(daily, ["series_id"]), (0.25, 0.5, 0.75), ["series_id"])


@register("date_ranges", [("entity_id", "s"), ("series_id", "s"), ("first_date", "d"),
                          ("last_date", "d")],
          S.with_(S.panel_cte("nation_priority"))
          + " SELECT entity_id, series_id, min(date) AS first_date, max(date) AS last_date"
            " FROM panel GROUP BY 1, 2")
def _date_ranges(spark, d):
    return QL.date_ranges(panel_view(spark, d, "nation_priority"))


@register("duplicate_count", [("entity_id", "s"), ("series_id", "s"), ("duplicate_rows", "i")],
          S.with_(*S.dirty_ctes())
          + " SELECT entity_id, series_id, count(*) - count(DISTINCT (entity_id, series_id, date, value))"
            " AS duplicate_rows FROM dirty GROUP BY 1, 2")
def _duplicate_count(spark, d):
    return QL.duplicate_count(QL.dirty_panel(panel_view(spark, d, "monthly_orders")))


@register("distinct_rows", PANEL_SPEC,
          S.with_(*S.dirty_ctes()) + " SELECT DISTINCT * FROM dirty")
def _distinct_rows(spark, d):
    return QL.dirty_panel(panel_view(spark, d, "monthly_orders")).distinct()


@register("quality_report",
          [("entity_id", "s"), ("name", "s"), ("status", "s"), ("rows", "i"), ("date_range", "s"), ("issues", "a")],
          S.with_(*S.dirty_ctes(), S.panel_cte("user_daily", "ud"),
                  "src AS (SELECT * FROM dirty UNION ALL SELECT * FROM ud)",
                  "agg AS (SELECT entity_id, series_id AS name, count(*) AS rows,"
                  " sum(CAST(entity_id IS NULL AS INT) + CAST(series_id IS NULL AS INT)"
                  " + CAST(date IS NULL AS INT) + CAST(value IS NULL AS INT)) AS nulls,"
                  " min(date) AS f, max(date) AS l,"
                  " count(DISTINCT (entity_id, series_id, date, value)) AS dist FROM src GROUP BY 1, 2)",
                  "iss AS (SELECT *, list_filter([CASE WHEN nulls > 0 THEN 'Missing values: ' || nulls END,"
                  " CASE WHEN date_diff('day', f, l) < 365 THEN 'Short time series: '"
                  " || date_diff('day', f, l) || ' days' END,"
                  " CASE WHEN rows - dist > 0 THEN 'Duplicate rows: ' || (rows - dist) END],"
                  " lambda x: x IS NOT NULL) AS lst FROM agg)")
          + " SELECT entity_id, name, 'ok' AS status, rows, CAST(f AS VARCHAR) || ' to ' || CAST(l AS VARCHAR)"
            " AS date_range, CASE WHEN len(lst) = 0 THEN ['No issues detected'] ELSE lst END AS issues"
            " FROM iss UNION ALL SELECT 'all', 'NO-OBSERVATIONS', 'empty', 0, NULL, ['No data available']")
def _quality_report(spark, d):
    src = QL.dirty_panel(panel_view(spark, d, "monthly_orders")).unionByName(
        panel_view(spark, d, "user_daily"))
    cat = src.select("entity_id", "series_id").distinct().unionByName(
        spark.createDataFrame([("all", CT.EMPTY_SERIES)], "entity_id string, series_id string"))
    return QL.quality_report(src, cat)


@register("quality_report_entities",
          [("entity_id", "s"), ("name", "s"), ("status", "s"), ("rows", "i"), ("date_range", "s"), ("issues", "a")],
          S.with_(S.panel_cte("nation_priority"),
                  "agg AS (SELECT entity_id, series_id AS name, count(*) AS rows, min(date) AS f, max(date) AS l"
                  " FROM panel GROUP BY 1, 2)")
          + " SELECT entity_id, name, 'ok' AS status, rows, CAST(f AS VARCHAR) || ' to ' || CAST(l AS VARCHAR)"
            " AS date_range, [CASE WHEN date_diff('day', f, l) < 365 THEN 'Short time series: '"
            " || date_diff('day', f, l) || ' days' ELSE 'No issues detected' END] AS issues FROM agg")
def _quality_entities(spark, d):
    return QL.quality_report(panel_view(spark, d, "nation_priority"))


@register("collection_summary", [("category", "s"), ("n_series", "i")],
          S.with_(*S.collected_ctes())
          + " SELECT coalesce(category, 'total') AS category, count(DISTINCT series_id) AS n_series"
            " FROM cp GROUP BY ROLLUP (category)")
def _collection_summary(spark, d):
    return QL.collection_summary(CT.collected_panel(spark, d))


@register("head_sample", PANEL_SPEC,
          S.with_(S.panel_cte("supplier_monthly"))
          + " SELECT entity_id, series_id, date, value FROM (SELECT *, row_number() OVER"
            " (PARTITION BY entity_id, series_id ORDER BY date) AS rn FROM panel) WHERE rn <= 5")
def _head_sample(spark, d):
    return QL.head_sample(panel_view(spark, d, "supplier_monthly"))

# --------------------------------------------------------------- step 4: windows and scalars

from panelcast.operators import matrix as MX  # noqa: E402


def _win_sql(view, exprs):
    return S.with_(S.panel_cte(view)) + " SELECT *, " + ", ".join(
        f"{e} AS {n}" for n, e in exprs) + " FROM panel"


SK_W = "entity_id, series_id"


@register("yoy_change", PANEL_SPEC + [("yoy_change", 6)],
          _win_sql("supplier_monthly", [("yoy_change", f"value / lag(value, 12) {S.w()} - 1")]))
def _yoy(spark, d):
    return FT.yoy_change(panel_view(spark, d, "supplier_monthly"))


@register("log_value", PANEL_SPEC + [("log_value", 6)],
          _win_sql("supplier_monthly", [("log_value", "ln(value)")]))
def _log_value(spark, d):
    return FT.log_value(panel_view(spark, d, "supplier_monthly"))


@register("date_parts",
          [("entity_id", "s"), ("series_id", "s"), ("date", "d"), ("value", 2), ("mom_pct", 6),
           ("log_value", 6), ("yoy_change", 6), ("year", "i"), ("month", "i"), ("quarter", "i")],
          S.with_(*S.analysis_ctes("monthly_orders", TARGET)[:3]) + " SELECT * FROM ty")
def _date_parts(spark, d):
    target, _ = RL.role_split(panel_view(spark, d, "monthly_orders"), TARGET)
    return FT.target_features(target)


@register("rolling_mean3", PANEL_SPEC + [("ma3", 3)],
          _win_sql("daily_ship", [("ma3", S.strict("avg", 3))]))
def _rm3(spark, d):
    return FT.rolling_features(panel_view(spark, d, "daily_ship"), means=(3,), stds=())


@register("rolling_std3", PANEL_SPEC + [("vol3", 2)],
          _win_sql("daily_ship", [("vol3", S.strict("stddev_samp", 3))]))
def _rs3(spark, d):
    return FT.rolling_features(panel_view(spark, d, "daily_ship"), means=(), stds=(3,))


@register("rolling_mean6", PANEL_SPEC + [("ma6", 3)],
          _win_sql("daily_ship", [("ma6", S.strict("avg", 6))]))
def _rm6(spark, d):
    return FT.rolling_features(panel_view(spark, d, "daily_ship"), means=(6,), stds=())


@register("predictor_lags", PANEL_SPEC + [(f"value_lag{k}", 2) for k in (1, 2, 3)],
          _win_sql("nation_priority", [(f"value_lag{k}", f"lag(value, {k}) {S.w()}") for k in (1, 2, 3)]))
def _plags(spark, d):
    return FT.lags(panel_view(spark, d, "nation_priority"), "value", 3)


@register("ar_lags",
          [("entity_id", "s"), ("date", "d"), ("mom_pct", 6)]
          + [(f"mom_pct_lag{k}", 6) for k in (1, 2, 3)],
          S.with_(*S.analysis_ctes("nation_priority", TARGET)[:3])
          + " SELECT entity_id, date, mom_pct, "
          + ", ".join(f"lag(mom_pct, {k}) OVER (PARTITION BY entity_id ORDER BY date) AS mom_pct_lag{k}"
                      for k in (1, 2, 3)) + " FROM ty")
def _arlags(spark, d):
    target, _ = RL.role_split(panel_view(spark, d, "nation_priority"), TARGET)
    ty = FT.target_features(target).select("entity_id", "date", "mom_pct")
    return FT.lags(ty, "mom_pct", 3, keys=("entity_id",))


@register("momentum_diff3", PANEL_SPEC + [("mom3", 2)],
          _win_sql("supplier_monthly", [("mom3", f"value - lag(value, 3) {S.w()}")]))
def _md3(spark, d):
    return FT.momentum(panel_view(spark, d, "supplier_monthly")).drop("mom6")


@register("momentum_ratio6", PANEL_SPEC + [("mom6", 6)],
          _win_sql("supplier_monthly", [("mom6", f"value / lag(value, 6) {S.w()} - 1")]))
def _mr6(spark, d):
    return FT.momentum(panel_view(spark, d, "supplier_monthly")).drop("mom3")


FM_SPEC = [("entity_id", "s"), ("date", "d"), ("mom_pct", 6), ("feature", "s"),
           ("ordinal", "i"), ("value", 4)]


@register("feature_matrix", FM_SPEC,
          S.with_(*S.feature_matrix_ctes("monthly_orders", TARGET))
          + " SELECT entity_id, date, mom_pct, feature, ordinal, value FROM fm")
def _fm(spark, d):
    return MX.feature_matrix(RL.analysis_series(panel_view(spark, d, "monthly_orders"), TARGET))


@register("feature_matrix_first10", FM_SPEC,
          S.with_(*S.feature_matrix_ctes("monthly_orders", TARGET, 10))
          + " SELECT entity_id, date, mom_pct, feature, ordinal, value FROM fm")
def _fm10(spark, d):
    return MX.feature_matrix(RL.analysis_series(panel_view(spark, d, "monthly_orders"), TARGET), n_predictors=10)

# --------------------------------------------------------------- step 5: relate

PRI_SERIES = ("1-URGENT", "2-HIGH")


@register("full_join_pair", [("entity_id", "s"), ("date", "d"), ("urgent", 2), ("high", 2)],
          S.with_(S.panel_cte("nation_priority"))
          + f" SELECT * FROM (SELECT entity_id, date, value AS urgent FROM panel WHERE series_id = '{PRI_SERIES[0]}')"
            f" FULL OUTER JOIN (SELECT entity_id, date, value AS high FROM panel WHERE series_id = '{PRI_SERIES[1]}')"
            " USING (entity_id, date)")
def _full_join_pair(spark, d):
    from pyspark.sql import functions as F
    p = panel_view(spark, d, "nation_priority")
    p = materialize(p.filter(F.col("series_id").isin(list(PRI_SERIES))))
    a = p.filter(F.col("series_id") == PRI_SERIES[0]).select("entity_id", "date", F.col("value").alias("urgent"))
    b = p.filter(F.col("series_id") == PRI_SERIES[1]).select("entity_id", "date", F.col("value").alias("high"))
    return RL.full_join_pair(a, b)


@register("predictors_wide",
          [("entity_id", "s"), ("date", "d")] + [(v, 6 if v.endswith("mom_pct") else 4) for v in WIDE_VARS],
          S.with_(*S.analysis_ctes("nation_priority", TARGET)[:5])
          + " SELECT entity_id, date, "
          + ", ".join(f"max(CASE WHEN variable = '{v}' THEN x END) AS \"{v}\"" for v in WIDE_VARS)
          + " FROM pl GROUP BY 1, 2")
def _predictors_wide(spark, d):
    return RL.predictors_wide(panel_view(spark, d, "nation_priority"), TARGET)


@register("complete_cases",
          [("entity_id", "s"), ("date", "d"), ("mom_pct", 6), ("variable", "s"), ("x", 4)],
          S.with_(*S.analysis_ctes("nation_priority", TARGET))
          + " SELECT entity_id, date, mom_pct, variable, x FROM al")
def _complete_cases(spark, d):
    return RL.analysis_frame(panel_view(spark, d, "nation_priority"), TARGET)


LL = 6


@register("lead_lag_corr", [("entity_id", "s"), ("variable", "s"), ("lag", "i"), ("correlation", 6)],
          S.with_(*S.corr_ctes("nation_priority", TARGET),
                  "alt AS (SELECT al.* FROM al SEMI JOIN (SELECT entity_id, variable FROM rk WHERE rank <= 5) t"
                  " USING (entity_id, variable))",
                  "lg AS (SELECT entity_id, variable, mom_pct, x, "
                  + ", ".join(f"lag(x, {k}) OVER (PARTITION BY entity_id, variable ORDER BY date) AS xl{k},"
                              f" lag(mom_pct, {k}) OVER (PARTITION BY entity_id, variable ORDER BY date) AS yl{k}"
                              for k in range(1, LL + 1)) + " FROM alt)",
                  "ll AS (" + " UNION ALL ".join(
                      [f"SELECT entity_id, variable, 0 AS lag, corr(mom_pct, x) AS correlation FROM lg GROUP BY 1, 2"]
                      + [f"SELECT entity_id, variable, {k}, corr(mom_pct, xl{k}) FROM lg GROUP BY 1, 2"
                         for k in range(1, LL + 1)]
                      + [f"SELECT entity_id, variable, -{k}, corr(yl{k}, x) FROM lg GROUP BY 1, 2"
                         for k in range(1, LL + 1)]) + ")")
          + " SELECT * FROM ll WHERE correlation IS NOT NULL AND NOT isnan(correlation)")
def _lead_lag(spark, d):
    return RL.lead_lag_top(panel_view(spark, d, "nation_priority"), TARGET, top_k=5, max_lag=LL)


WIDE_LAGS = 24


@register("lead_lag_wide", [("entity_id", "s"), ("variable", "s"), ("lag", "i"), ("correlation", 6)],
          S.with_(*S.analysis_ctes("monthly_orders", TARGET),
                  "nb AS (SELECT *, row_number() OVER (PARTITION BY entity_id, variable ORDER BY date) AS t FROM al)",
                  f"sh AS (SELECT a.entity_id, a.variable, a.t - b.t AS lag, corr(a.mom_pct, b.x) AS correlation FROM nb a JOIN nb b"
                  f" ON a.entity_id = b.entity_id AND a.variable = b.variable AND abs(a.t - b.t) <= {WIDE_LAGS} GROUP BY 1, 2, 3)")
          + " SELECT * FROM sh WHERE correlation IS NOT NULL AND NOT isnan(correlation)")
def _lead_lag_wide(spark, d):
    return RL.lead_lag_all(RL.analysis_series(panel_view(spark, d, "monthly_orders"), TARGET), WIDE_LAGS)


@register("topk_predictors", [("entity_id", "s"), ("rank", "i"), ("variable", "s"), ("correlation", 6)],
          S.with_(*S.corr_ctes("nation_priority", TARGET))
          + " SELECT entity_id, rank, variable, correlation FROM rk WHERE rank <= 5")
def _topk(spark, d):
    return RL.corr_rank(panel_view(spark, d, "nation_priority"), TARGET, top_k=5)


# --------------------------------------------------------------- step 6: splits

from panelcast.operators import split as SP  # noqa: E402

SPLIT_SQL = ("SELECT *, CASE WHEN rn < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'"
             " WHEN rn < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) + CAST(trunc(n * 0.15::DOUBLE) AS BIGINT)"
             " THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER"
             " (PARTITION BY entity_id, series_id ORDER BY date) - 1 AS rn,"
             " count(*) OVER (PARTITION BY entity_id, series_id) AS n FROM panel)")


@register("ts_split", PANEL_SPEC + [("rn", "i"), ("n", "i"), ("split", "s")],
          S.with_(S.panel_cte("daily_ship")) + " " + SPLIT_SQL)
def _ts_split(spark, d):
    return SP.ts_split(panel_view(spark, d, "daily_ship"))


@register("split_counts",
          [("entity_id", "s"), ("series_id", "s"), ("split", "s"), ("rows", "i"),
           ("first_date", "d"), ("last_date", "d")],
          S.with_(S.panel_cte("nation_priority"), f"sp AS ({SPLIT_SQL})")
          + " SELECT entity_id, series_id, split, count(*) AS rows, min(date) AS first_date,"
            " max(date) AS last_date FROM sp GROUP BY 1, 2, 3")
def _split_counts(spark, d):
    return SP.split_counts(SP.ts_split(panel_view(spark, d, "nation_priority")))


@register("expanding_folds",
          [("entity_id", "s"), ("series_id", "s"), ("fold", "i"), ("n_train", "i"), ("n_test", "i"),
           ("train_start", "d"), ("train_end", "d"), ("test_start", "d"), ("test_end", "d")],
          S.with_(S.panel_cte("daily_ship"),
                  "rn AS (SELECT entity_id, series_id, date, row_number() OVER (PARTITION BY entity_id,"
                  " series_id ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY entity_id, series_id) AS n,"
                  " min(date) OVER (PARTITION BY entity_id, series_id) AS train_start,"
                  " lag(date) OVER (PARTITION BY entity_id, series_id ORDER BY date) AS train_end,"
                  " lead(date, 11) OVER (PARTITION BY entity_id, series_id ORDER BY date) AS test_end FROM panel)",
                  "fo AS (SELECT entity_id, series_id, unnest(range(60, n - 12, 12)) AS e"
                  " FROM (SELECT DISTINCT entity_id, series_id, n FROM rn) x)")
          + " SELECT fo.entity_id, fo.series_id, CAST((e - 60) / 12 AS BIGINT) AS fold, e AS n_train,"
            " 12 AS n_test, train_start, train_end, date AS test_start, test_end"
            " FROM fo JOIN rn ON rn.entity_id = fo.entity_id AND rn.series_id = fo.series_id AND rn.rn = fo.e")
def _folds(spark, d):
    return SP.expanding_folds(panel_view(spark, d, "daily_ship"))

# --------------------------------------------------------------- step 7: linear models

from pyspark.sql import functions as _F  # noqa: E402

from panelcast.operators import linear as LN, evaluate as EV  # noqa: E402

SER = ["entity_id", "series_id"]


def _ar_split(spark, d):
    rows = LN.ar_rows(panel_view(spark, d, "supplier_monthly"))
    return materialize(SP.ts_split(rows, keys=SER).drop("rn", "n"))     # read to fit and to score


def _ar_fits(spark, d):
    sp = _ar_split(spark, d)
    return sp, LN.fit_ar(sp.filter(_F.col("split") == "train"), SER)


@register("ar3_gram",
          [("entity_id", "s"), ("series_id", "s"), ("n", "i"), ("mean_y", 6)]
          + [(f"mean_x{i}", 6) for i in (1, 2, 3)]
          + [(f"sxx{i}{j}", 4) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
          + [(f"sxy{i}", 4) for i in (1, 2, 3)] + [("syy", 4)],
          S.with_(*S.ar_ctes("supplier_monthly")[:7])
          + " SELECT entity_id, series_id, n, my AS mean_y, m1 AS mean_x1, m2 AS mean_x2, m3 AS mean_x3, "
          + ", ".join(f"a{i}{j} * n AS sxx{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)
          + ", b1 * n AS sxy1, b2 * n AS sxy2, b3 * n AS sxy3, vy * n AS syy FROM g")
def _ar3_gram(spark, d):
    sp = _ar_split(spark, d)
    g = LN.gram(sp.filter(_F.col("split") == "train"), SER, 3)
    cols = [_F.col("mean_x")[i].alias(f"mean_x{i + 1}") for i in range(3)]
    cols += [_F.col("xtx")[i * 3 + j].alias(f"sxx{i + 1}{j + 1}") for i in range(3) for j in range(3) if i <= j]
    cols += [_F.col("xty")[i].alias(f"sxy{i + 1}") for i in range(3)]
    return g.select(*SER, "n", "mean_y", *cols, "yty").withColumnRenamed("yty", "syy")


@register("ar3_fit",
          [("entity_id", "s"), ("series_id", "s"), ("n_train", "i"), ("status", "s"), ("intercept", 6),
           ("lag1", 6), ("lag2", 6), ("lag3", 6)],
          S.with_(*S.ar_ctes("supplier_monthly"))
          + " SELECT entity_id, series_id, n AS n_train, status, intercept, c1 AS lag1, c2 AS lag2, c3 AS lag3 FROM fit")
def _ar3_fit(spark, d):
    _, fits = _ar_fits(spark, d)
    return fits.select(*SER, "n_train", "status", "intercept",
                       *[_F.col("coef")[i].alias(f"lag{i + 1}") for i in range(3)])


@register("predict_linear",
          [("entity_id", "s"), ("series_id", "s"), ("date", "d"), ("split", "s"), ("y", 6),
           ("prediction", 6)],
          S.with_(*S.ar_ctes("supplier_monthly"))
          + " SELECT entity_id, series_id, date, split, y, prediction FROM pr")
def _predict_linear(spark, d):
    sp, fits = _ar_fits(spark, d)
    return LN.predict(sp.filter(_F.col("split") != "train"), fits, SER)


@register("eval_metrics",
          [("entity_id", "s"), ("series_id", "s"), ("split", "s"), ("rmse", 6), ("mae", 6),
           ("directional_accuracy", 6), ("n_predictions", "i")],
          S.with_(*S.ar_ctes("supplier_monthly"))
          + " SELECT entity_id, series_id, split, sqrt(avg((y - prediction) * (y - prediction))) AS rmse,"
            " avg(abs(y - prediction)) AS mae,"
            " avg(CAST(CAST(sign(y) AS DOUBLE) = CAST(sign(prediction) AS DOUBLE) AS DOUBLE))"
            " AS directional_accuracy, count(*) AS n_predictions FROM pr GROUP BY 1, 2, 3")
def _eval_metrics(spark, d):
    sp, fits = _ar_fits(spark, d)
    return EV.metrics(LN.predict(sp.filter(_F.col("split") != "train"), fits, SER), SER + ["split"])


@register("standardise", PANEL_SPEC + [("split", "s"), ("z", 6)],
          S.with_(S.panel_cte("supplier_monthly"), "sp AS (" + SPLIT_SQL + ")",
                  "st AS (SELECT entity_id, series_id, avg(value) AS m, stddev_pop(value) AS s"
                  " FROM sp WHERE split = 'train' GROUP BY 1, 2)")
          + " SELECT sp.entity_id, sp.series_id, sp.date, sp.value, sp.split,"
            " (sp.value - st.m) / CASE WHEN st.s = 0 THEN 1.0 ELSE st.s END AS z"
            " FROM sp JOIN st USING (entity_id, series_id)")
def _standardise(spark, d):
    sp = SP.ts_split(panel_view(spark, d, "supplier_monthly"))
    return LN.standardise(sp.filter(_F.col("split") == "train"), sp, SER, "value")

# --------------------------------------------------------------- step 8: forest and comparison

from panelcast.plans import comparison as CMP  # noqa: E402
from panelcast.operators import forest as FR, trees as TR  # noqa: E402

MET_SPEC = [("entity_id", "s"), ("model", "s"), ("split", "s"), ("rmse", 6), ("mae", 6),
            ("directional_accuracy", 6), ("n_predictions", "i")]


N_RIDGE = CMP.RIDGE_FEATURES


@register("ridge_fit",
          [("entity_id", "s"), ("model", "s"), ("status", "s"), ("n_train", "i"), ("intercept", 4)]
          + [(f"c{i}", 4) for i in range(N_RIDGE)],
          S.with_(*S.ridge_ctes("nation_priority", TARGET, N_RIDGE))
          + " SELECT entity_id, 'ridge' AS model, status, n_train, intercept, "
          + ", ".join(f"c{i}" for i in range(N_RIDGE)) + " FROM ridge")
def _ridge_fit(spark, d):
    fm = CMP.split_matrix(panel_view(spark, d, "nation_priority"), TARGET)
    v = CMP.vectors(fm, N_RIDGE)
    fit = LN.fit_ridge(v.filter(_F.col("split") == "train"), ["entity_id"])
    return fit.select("*", *[_F.col("coef")[i].alias(f"c{i}") for i in range(N_RIDGE)])


def _training(spark, d, view):
    vec = materialize(CMP.vectors(CMP.split_matrix(panel_view(spark, d, view), TARGET)))
    return vec, vec.filter(_F.col("split") == "train")


@register("forest_fit", MET_SPEC, notes="100 trees of unlimited depth; the same trees as a recursive NumPy fit in tests")
def _forest_fit(spark, d):
    vec, train = _training(spark, d, "monthly_orders")
    nodes, _ = TR.fit_forest(train)
    scored = vec.join(TR.predict(nodes, vec, ["entity_id", "date"]), ["entity_id", "date"])
    return EV.metrics(scored.withColumn("model", _F.lit("forest")), ["entity_id", "model", "split"])


NODE_SPEC = [("entity_id", "s"), ("tree", "i"), ("level", "i"), ("node", "i"), ("n", "i"), ("value", 4), ("feature", "s"),
             ("threshold", 4)]
FEW_ROWS = 5            # training rows that the two checks on small panels need


def _feature_names(train):
    return train.groupBy("entity_id").agg(_F.first("features").alias("features"))


def _named_nodes(nodes, train):
    return nodes.join(_feature_names(train), "entity_id").withColumn("feature", _F.expr("features[feature]"))


@register("forest_depth2", NODE_SPEC,
          S.with_(*S.forest_ctes("nation_priority", TARGET, 3, 2, TR.SEED, FEW_ROWS))
          + " SELECT entity_id, tree, level, node, n, value, feature, thr AS threshold FROM nodes")
def _forest_depth2(spark, d):
    _, train = _training(spark, d, "nation_priority")
    return _named_nodes(TR.fit_forest(train, 3, 2, min_rows=FEW_ROWS)[0], train)


@register("importance_depth2", [("entity_id", "s"), ("rank", "i"), ("feature", "s"), ("importance", 6)],
          S.with_(*S.forest_ctes("nation_priority", TARGET, 3, 2, TR.SEED, FEW_ROWS))
          + " SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY round(importance, 9) DESC, feature) AS rank, feature, importance"
            " FROM im")
def _importance_depth2(spark, d):
    _, train = _training(spark, d, "nation_priority")
    return TR.importances(TR.fit_forest(train, 3, 2, min_rows=FEW_ROWS)[0], _feature_names(train))


@register("boosted_stumps", NODE_SPEC,
          S.with_(*S.stump_ctes("nation_priority", TARGET, 3, 0.3, FEW_ROWS))
          + " SELECT entity_id, tree, level, node, n, value, feature, thr AS threshold FROM nodes")
def _boosted_stumps(spark, d):
    _, train = _training(spark, d, "nation_priority")
    return _named_nodes(TR.boost(train, 3, 1, 0.3, min_rows=FEW_ROWS)[0], train)


@register("top_importance", [("rank", "i"), ("feature", "s"), ("importance", 6)],
          notes="forest importances; their sum and order are tested")
def _top_importance(spark, d):
    _, train = _training(spark, d, "monthly_orders")
    return FR.top_importance(TR.importances(TR.fit_forest(train)[0], _feature_names(train)), 10)


@register("model_compare", MET_SPEC, notes="AR + ridge + forest metrics; ridge and AR against NumPy in tests")
def _model_compare(spark, d):
    return CMP.compare(panel_view(spark, d, "monthly_orders"), TARGET).metrics


TABLE_SPEC = [("entity_id", "s"), ("model", "s"), ("status", "s"), ("n_train", "i"), ("n_features", "i")] + [
    (f"{s}_{m}", k) for s in CMP.SPLITS for m, k in (("rmse", 6), ("mae", 6), ("directional_accuracy", 6),
                                                     ("n_predictions", "i"))] + [("best", "b"), ("skill", "s")]


@register("model_table", TABLE_SPEC, notes="linear models per nation on all features; against NumPy in tests")
def _model_table(spark, d):
    return CMP.model_table(CMP.compare(panel_view(spark, d, "nation_priority"), TARGET, with_forest=False))


@register("best_model", [("entity_id", "s"), ("best_model", "s"), ("rmse", 6)],
          notes="minimum test RMSE per nation; follows from model_table")
def _best_model(spark, d):
    return CMP.best_model(CMP.compare(panel_view(spark, d, "nation_priority"), TARGET, with_forest=False))


def _table_sql(models: str) -> str:
    """Status, training rows and feature counts that every (entity, model) must have."""
    return (S.with_(*S.feature_matrix_ctes("nation_priority", TARGET), *S.split_date_ctes(),
                    "en AS (SELECT DISTINCT entity_id FROM panel)",
                    "nt AS (SELECT entity_id, count(*) FILTER (WHERE split = 'train') AS n_train,"
                    " count(*) FILTER (WHERE split = 'test') AS n_test FROM sd GROUP BY 1)",
                    "nf AS (SELECT entity_id, count(DISTINCT ordinal) AS n_all FROM fm GROUP BY 1)",
                    f"md AS (SELECT * FROM (VALUES {models}) v(model, least_rows, few))")
            + " SELECT entity_id, model, CASE WHEN coalesce(n_train, 0) = 0 THEN 'No complete rows' WHEN n_train"
              " < least_rows THEN 'Insufficient training data' ELSE 'ok' END AS status, coalesce(n_train, 0) AS n_train,"
              " CASE WHEN n_train > 0 THEN coalesce(few, n_all) END AS n_features,"
              " CASE WHEN n_train >= least_rows AND n_test > 0 THEN n_test END AS test_n_predictions"
              " FROM en LEFT JOIN nt USING (entity_id) LEFT JOIN nf USING (entity_id), md")


@register("model_table_shape",
          [("entity_id", "s"), ("model", "s"), ("status", "s"), ("n_train", "i"), ("n_features", "i"),
           ("test_n_predictions", "i")], _table_sql("('ar', 10, 3), ('ridge', 20, NULL)"))
def _model_table_shape(spark, d):
    return CMP.model_table(CMP.compare(panel_view(spark, d, "nation_priority"), TARGET, with_forest=False))


@register("importance_total", [("n_features", "i"), ("total", 6), ("top_first", "b")],
          S.with_(*S.feature_matrix_ctes("monthly_orders", TARGET))
          + " SELECT count(DISTINCT ordinal) AS n_features, 1.0 AS total, TRUE AS top_first FROM fm")
def _importance_total(spark, d):
    _, train = _training(spark, d, "monthly_orders")
    imp = materialize(TR.importances(TR.fit_forest(train, 10)[0], _feature_names(train)))
    top = imp.agg(_F.max("importance")).first()[0]
    return imp.agg(_F.count(_F.lit(1)).alias("n_features"), _F.sum("importance").alias("total"),
                   _F.max((_F.col("rank") == 1) & (_F.col("importance") == top)).alias("top_first"))


# The run as the reference has it: 10 predictors, 20 ridge features. Metrics of all models, checked in SQL.
CAPPED = dict(n_predictors=10, ridge_features=CMP.RIDGE_FEATURES, with_forest=False)


def _capped(spark, d, view="nation_priority"):
    return CMP.compare(panel_view(spark, d, view), TARGET, **CAPPED)


def _capped_sql(select: str, view: str = "nation_priority") -> str:
    return S.with_(*S.comparison_ctes(view, TARGET, CAPPED["n_predictors"], CMP.RIDGE_FEATURES)) + select


@register("compare_capped", MET_SPEC, _capped_sql(" SELECT * FROM mt", "monthly_orders"))
def _compare_capped(spark, d):
    return _capped(spark, d, "monthly_orders").metrics


@register("model_table_capped", TABLE_SPEC, _capped_sql(" SELECT * FROM tb"))
def _model_table_capped(spark, d):
    return CMP.model_table(_capped(spark, d))


@register("best_model_capped", [("entity_id", "s"), ("best_model", "s"), ("rmse", 6)],
          _capped_sql(" SELECT entity_id, max(CASE WHEN best THEN model END) AS best_model,"
                      " max(CASE WHEN best THEN test_rmse END) AS rmse FROM tb GROUP BY 1"))
def _best_model_capped(spark, d):
    return CMP.best_model(_capped(spark, d))


@register("metrics_long_capped", [("entity_id", "s"), ("model", "s"), ("split", "s"), ("metric", "s"), ("value", 6)],
          _capped_sql(" SELECT entity_id, model, split, unnest(['rmse', 'mae', 'directional_accuracy']) AS metric,"
                      " unnest([rmse, mae, directional_accuracy]) AS value FROM mt", "monthly_orders"))
def _metrics_long_capped(spark, d):
    return CMP.metrics_long(_capped(spark, d, "monthly_orders").metrics)

# --------------------------------------------------------------- step 9: second tier

from panelcast.operators import align as AL, derived as DV, hidden as HD  # noqa: E402


@register("align_monthly",
          [("entity_id", "s"), ("series_id", "s"), ("date", "d"), ("mean_value", 6), ("last_value", 2),
           ("n_obs", "i"), ("first_obs", "d"), ("last_obs", "d")],
          S.with_(S.panel_cte("daily_ship"))
          + " SELECT entity_id, series_id, CAST(date_trunc('month', date) AS DATE) AS date,"
            " avg(value) AS mean_value, arg_max(value, date) AS last_value, count(value) AS n_obs,"
            " min(date) AS first_obs, max(date) AS last_obs FROM panel GROUP BY 1, 2, 3")
def _align_monthly(spark, d):
    return AL.to_monthly(panel_view(spark, d, "daily_ship"))


DELAY = 15


@register("asof_release",
          [("entity_id", "s"), ("series_id", "s"), ("date", "d"), ("value", 2), ("source_date", "d")],
          S.with_(S.panel_cte("monthly_orders", "mo"), S.panel_cte("daily_ship", "ds"),
                  f"t AS (SELECT DISTINCT entity_id, date FROM mo WHERE series_id = '{TARGET}')",
                  "s AS (SELECT DISTINCT entity_id, series_id FROM ds)",
                  "g AS (SELECT t.entity_id, s.series_id, t.date FROM t JOIN s USING (entity_id))",
                  f"r AS (SELECT entity_id, series_id, CAST(date + INTERVAL {DELAY} DAY AS DATE) AS avail,"
                  " date AS src, value FROM ds)")
          + " SELECT g.entity_id, g.series_id, g.date, r.value, r.src AS source_date FROM g"
            " ASOF LEFT JOIN r ON g.entity_id = r.entity_id AND g.series_id = r.series_id AND g.date >= r.avail")
def _asof(spark, d):
    mo = panel_view(spark, d, "monthly_orders")
    targets = mo.filter(_F.col("series_id") == TARGET)
    return AL.asof_align(targets, panel_view(spark, d, "daily_ship"), DELAY)


@register("latest_vintage",
          [("series_id", "s"), ("date", "d"), ("value", 2), ("vintage", "t"), ("n_revisions", "i")],
          "SELECT series_id, date, value, vintage, n_revisions FROM (SELECT event_type AS series_id,"
          " CAST(ts AS DATE) AS date, value, ts AS vintage, count(*) OVER (PARTITION BY event_type,"
          " CAST(ts AS DATE)) AS n_revisions, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE)"
          " ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _latest_vintage(spark, d):
    ev = VW.read_table(spark, d, "events", ["event_id", "event_type", "ts", "value"])
    obs = ev.select(_F.col("event_type").alias("series_id"), _F.col("ts").cast("date").alias("date"),
                    "value", _F.col("ts").alias("vintage"), "event_id")
    return AL.latest_vintage(obs, vintage="vintage", tie="event_id")


# Vintages of a day's value: every event is a revision, published 6 hours to 4 days after it happened.
VINTAGE_SQL = ("vt AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, ts + INTERVAL 6 HOUR + (event_id % 5) * INTERVAL 22 HOUR AS known,"
               " event_id, CAST(value AS DOUBLE) AS value FROM events)",
               "v1 AS (SELECT series_id, date, known, arg_max(value, event_id) AS value FROM vt GROUP BY ALL)")
KNOWN_SPEC = [("series_id", "s"), ("known", "t"), ("value", 2), ("source_date", "d"), ("source_known", "t")]


def _vintages(spark, d):
    ev = VW.read_table(spark, d, "events", ["event_id", "event_type", "ts", "value"])
    wait = _F.expr("ts + INTERVAL 6 HOUR + (event_id % 5) * INTERVAL 22 HOUR")
    return ev.select(_F.col("event_type").alias("series_id"), _F.col("ts").cast("date").alias("date"), wait.alias("known"),
                     _F.col("value").cast("double").alias("value"), "event_id")


@register("known_latest", KNOWN_SPEC,
          S.with_(*VINTAGE_SQL, S.panel_cte("hourly_events"), "rq AS (SELECT series_id, date AS known FROM panel)",
                  "j AS (SELECT rq.series_id, rq.known, max(CASE WHEN v1.known IS NOT NULL THEN struct_pack(a := v1.date, b := v1.known, c := v1.value) END) AS m"
                  " FROM rq LEFT JOIN v1 ON v1.series_id = rq.series_id AND v1.known <= rq.known GROUP BY 1, 2)")
          + " SELECT series_id, known, m.c AS value, m.a AS source_date, m.b AS source_known FROM j")
def _known_latest(spark, d):
    asked = panel_view(spark, d, "hourly_events").select("series_id", _F.col("date").alias("known"))
    return AL.known_then(asked, _vintages(spark, d), tie="event_id")


@register("known_exact", [("series_id", "s"), ("date", "d")] + KNOWN_SPEC[1:],
          S.with_(*VINTAGE_SQL, "rq AS (SELECT DISTINCT series_id, date, CAST(date AS TIMESTAMP) + INTERVAL 2 DAY AS known FROM vt)")
          + " SELECT rq.series_id, rq.date, rq.known, v1.value, v1.date AS source_date, v1.known AS source_known FROM rq ASOF LEFT JOIN v1"
            " ON v1.series_id = rq.series_id AND v1.date = rq.date AND rq.known >= v1.known")
def _known_exact(spark, d):
    v = _vintages(spark, d)
    asked = v.select("series_id", "date").distinct().withColumn("known", _F.expr("CAST(date AS TIMESTAMP_NTZ) + INTERVAL 2 DAY"))
    return AL.known_then(asked, v, valid="exact", tie="event_id")


@register("known_upto", [("series_id", "s"), ("date", "d")] + KNOWN_SPEC[1:],
          S.with_(*VINTAGE_SQL, "rq AS (SELECT DISTINCT series_id, date, CAST(date AS TIMESTAMP) + INTERVAL 36 HOUR AS known FROM vt)",
                  "j AS (SELECT rq.series_id, rq.date, rq.known, max(CASE WHEN v1.known IS NOT NULL THEN struct_pack(a := v1.date, b := v1.known,"
                  " c := v1.value) END) AS m FROM rq LEFT JOIN v1 ON v1.series_id = rq.series_id AND v1.known <= rq.known AND v1.date <= rq.date"
                  " GROUP BY 1, 2, 3)")
          + " SELECT series_id, date, known, m.c AS value, m.a AS source_date, m.b AS source_known FROM j")
def _known_upto(spark, d):
    v = _vintages(spark, d)
    asked = v.select("series_id", "date").distinct().withColumn("known", _F.expr("CAST(date AS TIMESTAMP_NTZ) + INTERVAL 36 HOUR"))
    return AL.known_then(asked, v, valid="upto", tie="event_id")


@register("lags12", PANEL_SPEC + [(f"value_lag{k}", 2) for k in range(1, 13)],
          _win_sql("nation_monthly", [(f"value_lag{k}", f"lag(value, {k}) {S.w()}") for k in range(1, 13)]))
def _lags12(spark, d):
    return FT.lags(panel_view(spark, d, "nation_monthly"), "value", 12)


VOL_DAYS = (30, 91, 182)


@register("rolling_vol_days", PANEL_SPEC + [(f"vol{v}d", 2) for v in VOL_DAYS],
          _win_sql("daily_ship", [(f"vol{v}d", f"stddev_samp(value) OVER (PARTITION BY entity_id, series_id"
                                   f" ORDER BY date RANGE BETWEEN INTERVAL {v - 1} DAY PRECEDING AND CURRENT ROW)")
                                  for v in VOL_DAYS]))
def _rolling_vol_days(spark, d):
    return DV.rolling_vol_days(panel_view(spark, d, "daily_ship"), VOL_DAYS)


@register("regime_stats",
          [("entity_id", "s"), ("series_id", "s"), ("regime", "s"), ("n", "i"), ("mean", 6), ("std", 6)],
          S.with_(S.panel_cte("supplier_monthly"),
                  f"r AS (SELECT *, {S.mom_expr()} AS mom_pct, {S.strict('avg', 6)} AS ma6 FROM panel)",
                  "rg AS (SELECT *, CASE WHEN ma6 IS NULL THEN NULL WHEN value > ma6 THEN 'high' ELSE 'low' END"
                  " AS regime FROM r)")
          + " SELECT entity_id, series_id, regime, count(mom_pct) AS n, avg(mom_pct) AS mean,"
            " stddev_samp(mom_pct) AS std FROM rg WHERE regime IS NOT NULL GROUP BY 1, 2, 3")
def _regime_stats(spark, d):
    return DV.regime_stats(DV.regimes(FT.mom_pct(panel_view(spark, d, "supplier_monthly"))), "mom_pct")


@register("hidden_regime", [("entity_id", "s"), ("series_id", "s"), ("date", "d"), ("y", 6), ("filtered", 6)],
          S.with_(S.panel_cte("supplier_monthly"), f"m AS (SELECT *, {S.mom_expr()} AS y FROM panel)",
                  "s AS (SELECT entity_id, series_id, date, y, row_number() OVER (PARTITION BY entity_id, series_id ORDER BY date) AS t FROM m"
                  " WHERE y IS NOT NULL)",
                  "pr AS (SELECT entity_id, series_id, avg(y) - 0.5 * sqrt(var_pop(y)) AS m0, avg(y) + 0.5 * sqrt(var_pop(y)) AS m1, var_pop(y) AS v"
                  " FROM s GROUP BY 1, 2 HAVING var_pop(y) > 0)",
                  "b AS (SELECT s.*, exp(l0 - greatest(l0, l1)) AS b0, exp(l1 - greatest(l0, l1)) AS b1 FROM (SELECT s.*,"
                  " -0.5 * (y - m0) * (y - m0) / v AS l0, -0.5 * (y - m1) * (y - m1) / v AS l1 FROM s JOIN pr USING (entity_id, series_id)) s)",
                  "f AS (SELECT entity_id, series_id, t, date, y, b1 / (b0 + b1) AS p FROM b WHERE t = 1 UNION ALL"
                  " SELECT b.entity_id, b.series_id, b.t, b.date, b.y, (0.1 * (1 - f.p) + 0.9 * f.p) * b1"
                  " / ((0.9 * (1 - f.p) + 0.1 * f.p) * b0 + (0.1 * (1 - f.p) + 0.9 * f.p) * b1) FROM f JOIN b ON b.entity_id = f.entity_id"
                  " AND b.series_id = f.series_id AND b.t = f.t + 1)").replace("WITH ", "WITH RECURSIVE ", 1)
          + " SELECT entity_id, series_id, date, y, p AS filtered FROM f")
def _hidden_regime(spark, d):
    rows = materialize(FT.mom_pct(panel_view(spark, d, "supplier_monthly"), out="y").filter("y IS NOT NULL"))
    return HD.probabilities(rows, HD.start_params(rows), block=16)


PAIRS = (("2_high_mom_pct", "3_medium_vol3"), ("4_not_specified_level", "5_low_mom_pct"))


@register("interactions",
          [("entity_id", "s"), ("date", "d")] + [(f"{a}_x_{b}", 2) for a, b in PAIRS],
          S.with_(*S.analysis_ctes("monthly_orders", TARGET)[:5],
                  "wd AS (SELECT entity_id, date, "
                  + ", ".join(f"max(CASE WHEN variable = '{v}' THEN x END) AS \"{v}\""
                              for v in sorted({c for p in PAIRS for c in p}))
                  + " FROM pl GROUP BY 1, 2)")
          + " SELECT entity_id, date, " + ", ".join(f"\"{a}\" * \"{b}\" AS \"{a}_x_{b}\"" for a, b in PAIRS)
          + " FROM wd")
def _interactions(spark, d):
    w = RL.predictors_wide(panel_view(spark, d, "monthly_orders"), TARGET)
    return DV.interactions(w, PAIRS)


@register("calendar_effects",
          [("entity_id", "s"), ("series_id", "s"), ("month", "i"), ("n", "i"), ("mean", 6),
           ("quarter_end", "b")],
          S.with_(S.panel_cte("supplier_monthly"), f"m AS (SELECT *, {S.mom_expr()} AS mom_pct FROM panel)")
          + " SELECT entity_id, series_id, month(date) AS month, count(mom_pct) AS n, avg(mom_pct) AS mean,"
            " month(date) % 3 = 0 AS quarter_end FROM m GROUP BY 1, 2, 3")
def _calendar_effects(spark, d):
    return DV.calendar_effects(FT.mom_pct(panel_view(spark, d, "supplier_monthly")), "mom_pct")


@register("spread", [("entity_id", "s"), ("date", "d"), ("a", 2), ("b", 2), ("spread", 2)],
          S.with_(S.panel_cte("nation_priority"))
          + " SELECT a.entity_id, a.date, a.value AS a, b.value AS b, a.value - b.value AS spread"
            " FROM panel a JOIN panel b ON a.entity_id = b.entity_id AND a.date = b.date"
            " WHERE a.series_id = '1-URGENT' AND b.series_id = '5-LOW'")
def _spread(spark, d):
    two = panel_view(spark, d, "nation_priority").filter(_F.col("series_id").isin("1-URGENT", "5-LOW"))
    return DV.spread(materialize(two), "1-URGENT", "5-LOW")

# --------------------------------------------------------------- step 9: second tier

from panelcast.operators import diagnostics as DG, selection as SL, validation as VL  # noqa: E402
from panelcast.streaming import incremental as INC  # noqa: E402


def _pooled(spark, d, kind):
    fm = CMP.split_matrix(panel_view(spark, d, "monthly_orders"), TARGET)
    vec = materialize(CMP.vectors(fm))
    m = FR.fit_pooled(vec.filter(_F.col("split") == "train"), kind)
    return EV.metrics(FR.predict_pooled(m, vec, kind), ["entity_id", "model", "split"])


POOLED_SQL = (S.with_(*S.feature_matrix_ctes("monthly_orders", TARGET), *S.split_date_ctes())
              + " SELECT split, count(*) AS n_predictions, CASE WHEN split = 'train' THEN var_pop(mom_pct) > 0 END AS beats_mean"
                " FROM sd JOIN (SELECT DISTINCT entity_id, date, mom_pct FROM fm) USING (entity_id, date) GROUP BY 1")


def _pooled_shape(spark, d, kind):
    """Rows scored in each split, and whether the fit explains its training rows."""
    vec = materialize(CMP.vectors(CMP.split_matrix(panel_view(spark, d, "monthly_orders"), TARGET)))
    train = vec.filter(_F.col("split") == "train")
    if kind == "forest":
        scored = FR.predict_forest(FR.fit_forest(train), vec)
    else:
        scored = FR.predict_pooled(FR.fit_pooled(train, kind), vec, kind)
    err = _F.col("y") - _F.col("prediction")
    return scored.groupBy("split").agg(
        _F.count("prediction").alias("n_predictions"),
        _F.when(_F.col("split") == "train", _F.avg(err * err) < _F.var_pop("y")).alias("beats_mean"))


for _kind in ("forest", "gbt", "lasso"):
    register(f"{_kind}_shape", [("split", "s"), ("n_predictions", "i"), ("beats_mean", "b")], POOLED_SQL)(
        lambda spark, d, kind=_kind: _pooled_shape(spark, d, kind))


@register("lasso_fit", MET_SPEC, notes="pooled L1 linear regression (pyspark.ml); optimality tested")
def _lasso(spark, d):
    return _pooled(spark, d, "lasso")


LASSO_SHARE = 0.3


@register("lasso_pair", [("entity_id", "s"), ("n_train", "i"), ("penalty", 6), ("c0", 6), ("c1", 6), ("intercept", 4)],
          S.with_(*S.lasso_pair_ctes("nation_priority", TARGET, LASSO_SHARE, FEW_ROWS)) + " SELECT * FROM lp")
def _lasso_pair(spark, d):
    vec = CMP.vectors(CMP.split_matrix(panel_view(spark, d, "nation_priority"), TARGET), 2)
    fit = SL.fit_lasso(vec.filter(_F.col("split") == "train"), share=LASSO_SHARE, min_rows=FEW_ROWS)
    return fit.filter("status = 'ok'").select("*", _F.col("coef")[0].alias("c0"), _F.col("coef")[1].alias("c1"))


@register("lasso_entities", MET_SPEC, notes="lasso per nation on all features; optimality conditions in tests")
def _lasso_entities(spark, d):
    vec, train = _training(spark, d, "nation_priority")
    fit = SL.fit_lasso(train, min_rows=FEW_ROWS)
    return EV.metrics(LN.predict(vec, fit, ["entity_id"]), ["entity_id", "model", "split"])


STEPS, F_ENTER = 3, 4.0


@register("stepwise_order", [("entity_id", "s"), ("step", "i"), ("feature", "s"), ("rss", 4), ("f", 4)],
          S.with_(*S.stepwise_ctes("monthly_orders", TARGET, STEPS, 10, F_ENTER)) + " SELECT entity_id, step, feature, rss, f FROM sw")
def _stepwise_order(spark, d):
    _, train = _training(spark, d, "monthly_orders")
    return SL.forward_stepwise(train, max_steps=STEPS, f_enter=F_ENTER)


@register("break_date", [("entity_id", "s"), ("series_id", "s"), ("n", "i"), ("break_date", "d"), ("sup_f", 4)],
          S.with_(*S.break_ctes("supplier_monthly", LN.TRIM)) + " SELECT entity_id, series_id, n, break_date, sup_f FROM bt")
def _break_date(spark, d):
    return LN.break_test(LN.ar_rows(panel_view(spark, d, "supplier_monthly")), SER, 3)


@register("gbt_fit", MET_SPEC, notes="pooled gradient-boosted trees (pyspark.ml); invariants tested")
def _gbt(spark, d):
    return _pooled(spark, d, "gbt")


@register("var_fit",
          [("entity_id", "s"), ("equation", "s"), ("status", "s"), ("n_train", "i"), ("intercept", 4),
           ("feature", "s"), ("coef", 4)],
          S.with_(*S.var_ctes("nation_priority", 5))
          + " SELECT entity_id, equation, status, n_train, intercept, feature, coef FROM var_long")
def _var(spark, d):
    rows = LN.var_rows(panel_view(spark, d, "nation_priority"))
    fits = LN.fit_linear(rows, ["entity_id", "equation"], "var")
    pairs = _F.transform(_F.sequence(_F.lit(0), _F.size("features") - 1), lambda i: _F.struct(
        _F.get("features", i).alias("feature"), _F.get("coef", i).alias("coef")))
    return fits.select("entity_id", "equation", "status", "n_train", "intercept", _F.inline(pairs))


CV_SPEC = [("entity_id", "s"), ("series_id", "s"), ("fold", "i"), ("rmse", 6), ("mae", 6),
           ("directional_accuracy", 6), ("n_predictions", "i")]


@register("expanding_cv_ar", CV_SPEC,
          S.with_(*S.cv_ctes("daily_ship", 60, 12, 12))
          + f" SELECT entity_id, series_id, fold, {S.METRICS_SELECT} FROM cvp GROUP BY 1, 2, 3")
def _cv(spark, d):
    return VL.cv_metrics(LN.ar_rows(panel_view(spark, d, "daily_ship")), SER, 3, 60, 12, 12)


@register("walk_forward_ar", [c for c in CV_SPEC if c[0] != "fold"],
          S.with_(*S.cv_ctes("supplier_monthly", 24, 1, 1))
          + f" SELECT entity_id, series_id, {S.METRICS_SELECT} FROM cvp GROUP BY 1, 2")
def _walk_forward(spark, d):
    p = VL.cv_predictions(LN.ar_rows(panel_view(spark, d, "supplier_monthly")), SER, 3, 24, 1, 1)
    return EV.metrics(p, SER)


@register("holdout_split", PANEL_SPEC + [("split", "s")],
          S.with_(S.panel_cte("supplier_monthly"))
          + " SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity_id, series_id ORDER BY date DESC)"
            " <= 24 THEN 'holdout' ELSE 'train' END AS split FROM panel")
def _holdout(spark, d):
    return VL.holdout(panel_view(spark, d, "supplier_monthly"), SER, 24)


@register("corr_matrix", [("entity_id", "s"), ("a", "s"), ("b", "s"), ("n", "i"), ("correlation", 6)],
          S.with_(S.panel_cte("nation_monthly"))
          + " SELECT x.entity_id, x.series_id AS a, y.series_id AS b, count(*) AS n,"
            " CASE WHEN isnan(corr(x.value, y.value)) THEN NULL ELSE corr(x.value, y.value) END AS correlation"
            " FROM panel x JOIN panel y ON x.entity_id = y.entity_id AND x.date = y.date"
            " AND x.series_id < y.series_id GROUP BY 1, 2, 3")
def _corr_matrix(spark, d):
    return DG.correlation_matrix(panel_view(spark, d, "nation_monthly"))


@register("corr_matrix_entities", [("entity_id", "s"), ("a", "s"), ("b", "s"), ("n", "i"), ("correlation", 6)],
          S.with_(S.panel_cte("nation_priority"))
          + " SELECT x.entity_id, x.series_id AS a, y.series_id AS b, count(*) AS n,"
            " CASE WHEN isnan(corr(x.value, y.value)) THEN NULL ELSE corr(x.value, y.value) END AS correlation"
            " FROM panel x JOIN panel y ON x.entity_id = y.entity_id AND x.date = y.date"
            " AND x.series_id < y.series_id GROUP BY 1, 2, 3")
def _corr_matrix_entities(spark, d):
    return DG.correlation_matrix(panel_view(spark, d, "nation_priority"))


@register("winsorize",
          PANEL_SPEC + [("lower", 4), ("upper", 4), ("clipped", 4), ("is_outlier", "b")],
          S.with_(S.panel_cte("supplier_monthly"),
                  "q AS (SELECT entity_id, series_id, quantile_cont(value, 0.05) AS lower,"
                  " quantile_cont(value, 0.95) AS upper FROM panel GROUP BY 1, 2)")
          + " SELECT p.*, lower, upper, CASE WHEN value < lower THEN lower WHEN value > upper THEN upper ELSE value END"
            " AS clipped, value < lower OR value > upper AS is_outlier FROM panel p JOIN q USING (entity_id, series_id)")
def _winsorize(spark, d):
    return DG.winsorize(panel_view(spark, d, "supplier_monthly"), 0.05, 0.95)


@register("winsorize_missing",
          PANEL_SPEC + [("lower", 4), ("upper", 4), ("clipped", 4), ("is_outlier", "b")],
          S.with_(S.panel_cte("nation_priority", "full_panel"),
                  "panel AS (SELECT entity_id, series_id, date, CASE WHEN month(date) = 6 OR entity_id = '3'"
                  " THEN NULL ELSE value END AS value FROM full_panel)",
                  "q AS (SELECT entity_id, series_id, quantile_cont(value, 0.05) AS lower,"
                  " quantile_cont(value, 0.95) AS upper FROM panel WHERE value IS NOT NULL GROUP BY 1, 2)")
          + " SELECT p.*, lower, upper, CASE WHEN value < lower THEN lower WHEN value > upper THEN upper ELSE value END"
            " AS clipped, value < lower OR value > upper AS is_outlier"
            " FROM panel p LEFT JOIN q USING (entity_id, series_id)")
def _winsorize_missing(spark, d):
    p = panel_view(spark, d, "nation_priority")
    gone = (_F.month("date") == 6) | (_F.col("entity_id") == "3")
    return DG.winsorize(p.withColumn("value", _F.when(~gone, _F.col("value"))), 0.05, 0.95)


@register("decompose", PANEL_SPEC + [("trend", "f"), ("seasonal", "f"), ("resid", "f")],
          S.with_(S.panel_cte("supplier_monthly"),
                  "t0 AS (SELECT *, CASE WHEN count(value) OVER (PARTITION BY entity_id, series_id ORDER BY date"
                  " ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN sum(CAST(value AS DECIMAL(20,2))) OVER"
                  " (PARTITION BY entity_id, series_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)"
                  f" - (lag(CAST(value AS DECIMAL(20,2)), 6) {S.w()} + lead(CAST(value AS DECIMAL(20,2)), 6) {S.w()})"
                  " * 0.5 END AS num FROM panel)",
                  "t AS (SELECT *, CAST(num AS DOUBLE) / 12.0 AS trend,"
                  " CAST(value AS DECIMAL(20,2)) * 12 - num AS dd, month(date) AS mon FROM t0)",
                  "s AS (SELECT entity_id, series_id, mon, CAST(sum(dd) AS DOUBLE) / (12.0 * count(dd)) AS s"
                  " FROM t GROUP BY 1, 2, 3)",
                  "wd AS (SELECT entity_id, series_id, "
                  + ", ".join(f"max(CASE WHEN mon = {m} THEN s END) AS s{m}" for m in range(1, 13))
                  + " FROM s GROUP BY 1, 2)",
                  "mn AS (SELECT entity_id, series_id, ("
                  + "(" * 11 + "0.0 + coalesce(s1, 0.0)" + "".join(f") + coalesce(s{m}, 0.0)" for m in range(2, 13))
                  + ") / CAST(" + " + ".join(f"CAST(s{m} IS NOT NULL AS INT)" for m in range(1, 13))
                  + " AS DOUBLE) AS mean FROM wd)",
                  "s2 AS (SELECT s.entity_id, s.series_id, s.mon, s.s - mn.mean AS seasonal FROM s JOIN mn"
                  " ON s.entity_id = mn.entity_id AND s.series_id = mn.series_id)")
          + " SELECT t.entity_id, t.series_id, t.date, t.value, t.trend, s2.seasonal,"
            " t.value - t.trend - s2.seasonal AS resid FROM t LEFT JOIN s2 ON t.entity_id = s2.entity_id"
            " AND t.series_id = s2.series_id AND t.mon = s2.mon")
def _decompose(spark, d):
    return DG.decompose(panel_view(spark, d, "supplier_monthly"))


@register("resid_autocorr",
          [("entity_id", "s"), ("series_id", "s"), ("resid_autocorr", 6), ("n_pairs", "i")],
          S.with_(*S.ar_ctes("supplier_monthly"),
                  "tr AS (SELECT sp.entity_id, sp.series_id, sp.date, sp.y - (fit.intercept + (((0.0 + sp.x1 * fit.c1)"
                  " + sp.x2 * fit.c2) + sp.x3 * fit.c3)) AS e FROM sp JOIN fit USING (entity_id, series_id)"
                  " WHERE fit.status = 'ok' AND sp.split = 'train')",
                  "tl AS (SELECT *, lag(e) OVER (PARTITION BY entity_id, series_id ORDER BY date) AS el FROM tr)")
          + " SELECT entity_id, series_id, CASE WHEN isnan(corr(e, el)) THEN NULL ELSE corr(e, el) END"
            " AS resid_autocorr, count(el) AS n_pairs FROM tl GROUP BY 1, 2")
def _resid_autocorr(spark, d):
    sp, fits = _ar_fits(spark, d)
    pred = LN.predict(sp.filter(_F.col("split") == "train"), fits, SER)
    return DG.residual_autocorr(pred, SER)


@register("chow_break", [("entity_id", "s"), ("series_id", "s"), ("n", "i"), ("chow_f", 4)],
          S.with_(*S.chow_ctes("supplier_monthly")) + " SELECT entity_id, series_id, n, chow_f FROM chow")
def _chow(spark, d):
    return LN.chow_test(LN.ar_rows(panel_view(spark, d, "supplier_monthly")), SER, 3)


@register("cross_check",
          [("entity_id", "s"), ("series_id", "s"), ("date", "d"), ("value_a", 2), ("value_b", 2),
           ("diff", 2), ("status", "s")],
          S.with_(S.panel_cte("monthly_orders", "pa"),
                  "pb AS (SELECT 'all' AS entity_id, o_orderpriority AS series_id,"
                  " CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS date,"
                  " CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 + CAST(l_tax AS DECIMAL(4,2)))"
                  " * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS value"
                  " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)")
          + " SELECT entity_id, series_id, date, pa.value AS value_a, pb.value AS value_b,"
            " pa.value - pb.value AS diff, CASE WHEN pa.value IS NULL THEN 'missing_a'"
            " WHEN pb.value IS NULL THEN 'missing_b' WHEN abs(pa.value - pb.value) > 0.01 THEN 'mismatch'"
            " ELSE 'match' END AS status FROM pa FULL OUTER JOIN pb USING (entity_id, series_id, date)")
def _cross_check(spark, d):
    a = panel_view(spark, d, "monthly_orders")
    li = VW.read_table(spark, d, "lineitem", ["l_orderkey", "l_extendedprice", "l_tax", "l_discount"])
    # pre-aggregate line revenue per order before the order join (fewer shuffled rows)
    # cents, and hundredths that the tax adds and the discount leaves: one exact product of longs for each line
    cents, tax, off = ((_F.col(c).cast(t) * 100).cast("long") for c, t in (
        ("l_extendedprice", "decimal(12,2)"), ("l_tax", "decimal(4,2)"), ("l_discount", "decimal(4,2)")))
    rev = li.groupBy("l_orderkey").agg(_F.sum((cents * (100 + tax) * (100 - off)).cast("decimal(18,0)")).alias("rev"))
    o = VW.read_table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderdate"])
    j = rev.join(o, rev.l_orderkey == o.o_orderkey)
    b = j.groupBy(_F.lit("all").alias("entity_id"), _F.col("o_orderpriority").alias("series_id"),
                  VW.month_of("o_orderdate").alias("date")).agg((_F.sum("rev") / 1000000).cast("double").alias("value"))
    return DG.cross_check(a, b, 0.01)


@register("stream_hourly", [("entity_id", "s"), ("series_id", "s"), ("date", "t"), ("value", 2)],
          S.with_(S.panel_cte("hourly_events")) + " SELECT * FROM panel")
def _stream_hourly(spark, d):
    return INC.hourly_panel_incremental(spark, d)


@register("stream_state_hourly", [("entity_id", "s"), ("series_id", "s"), ("date", "t"), ("value", 2)],
          S.with_(S.panel_cte("hourly_events")) + " SELECT * FROM panel")
def _stream_state_hourly(spark, d):
    return INC.hourly_panel_incremental(spark, d, state=True)


@register("feature_matrix_lags_only", FM_SPEC,
          S.with_(*S.feature_matrix_ctes("monthly_orders", TARGET))
          + " SELECT entity_id, date, mom_pct, feature, ordinal, value FROM"
            " (SELECT *, count(*) OVER (PARTITION BY entity_id, date) AS c FROM fr"
            " WHERE regexp_matches(feature, '_lag[0-9]+$')) z"
            " QUALIFY count(value) OVER (PARTITION BY entity_id, date) = c")
def _fm_lags(spark, d):
    return MX.feature_matrix(RL.analysis_series(panel_view(spark, d, "monthly_orders"), TARGET),
                             lags_only=True)


@register("metrics_long", [("entity_id", "s"), ("model", "s"), ("split", "s"), ("metric", "s"), ("value", 6)],
          notes="chart table of model_table's metrics")
def _metrics_long(spark, d):
    return CMP.metrics_long(CMP.compare(panel_view(spark, d, "nation_priority"), TARGET, with_forest=False).metrics)


@register("expanding_cv_ridge", CV_SPEC,
          S.with_(*S.ridge_cv_ctes("daily_ship", 60, 12, 12))
          + f" SELECT entity_id, series_id, fold, {S.METRICS_SELECT} FROM rcv GROUP BY 1, 2, 3")
def _cv_ridge(spark, d):
    return VL.ridge_cv_metrics(LN.ar_rows(panel_view(spark, d, "daily_ship")), SER, 3, 1.0, 60, 12, 12)
