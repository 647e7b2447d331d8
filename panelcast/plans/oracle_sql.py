"""DuckDB SQL building blocks for the side-by-side oracle.

Each block is an independent SQL formulation of a panel view or operator
(written from the semantics in the operator docstrings, not generated from
the Spark plan). Blocks are CTE lists joined by ``with_``.
"""

from __future__ import annotations

FEATURES = ("level", "mom_pct", "ma3", "vol3")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def _panel(select_from: str, entity: str, series: str, date: str, value: str,
           group_from: str | None = None) -> str:
    return (f"SELECT CAST({entity} AS VARCHAR) AS entity_id, CAST({series} AS VARCHAR) AS series_id,"
            f" {date} AS date, CAST(sum(CAST({value} AS DECIMAL(18,2))) AS DOUBLE) AS value"
            f" FROM {select_from} GROUP BY 1, 2, 3")


def _month(c: str) -> str:
    return f"CAST(date_trunc('month', CAST({c} AS DATE)) AS DATE)"


_ORD_CUST = "orders JOIN customer ON o_custkey = c_custkey"

VIEW_SQL = {
    "monthly_orders": _panel("orders", "'all'", "o_orderpriority", _month("o_orderdate"),
                             "o_totalprice"),
    "nation_monthly": _panel(_ORD_CUST + " JOIN nation ON c_nationkey = n_nationkey", "'all'",
                             "n_name", _month("o_orderdate"), "o_totalprice"),
    "nation_priority": _panel(_ORD_CUST, "c_nationkey", "o_orderpriority",
                              _month("o_orderdate"), "o_totalprice"),
    "supplier_monthly": _panel("lineitem", "'all'", "l_suppkey", _month("l_shipdate"),
                               "l_extendedprice"),
    "daily_ship": _panel("lineitem", "'all'", "l_returnflag", "CAST(l_shipdate AS DATE)",
                         "l_extendedprice"),
    "hourly_events": _panel("events", "'all'", "event_type",
                            "date_trunc('hour', CAST(ts AS TIMESTAMP))", "value"),
    "user_daily": _panel("events", "'all'", "user_id", "CAST(ts AS DATE)", "value"),
}


def panel_cte(view: str, name: str = "panel") -> str:
    return f"{name} AS ({VIEW_SQL[view]})"


def w(keys: str = "entity_id, series_id", frame: str = "") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY date {frame})"


PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def rows(n: int) -> str:
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def mom_expr(keys: str = "entity_id, series_id", value: str = "value") -> str:
    """(filled current - previous non-null) / previous non-null * 100."""
    prev = f"last_value({value} IGNORE NULLS) {w(keys, PREV)}"
    return f"(coalesce({value}, {prev}) - {prev}) / {prev} * 100"


def strict(agg: str, n: int, keys: str = "entity_id, series_id", value: str = "value") -> str:
    return (f"CASE WHEN count({value}) {w(keys, rows(n))} = {n} "
            f"THEN {agg}({value}) {w(keys, rows(n))} END")


def series_key(c: str = "series_id") -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g')"


def target_features_select(src: str, keys: str = "entity_id") -> str:
    return (f"SELECT *, {mom_expr(keys)} AS mom_pct,"
            f" CASE WHEN value > 0 THEN ln(value) WHEN value = 0 THEN '-inf'::DOUBLE"
            f" WHEN value < 0 OR isnan(value) THEN 'nan'::DOUBLE END AS log_value,"
            f" value / lag(value, 12) {w(keys)} - 1 AS yoy_change,"
            f" CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month,"
            f" CAST(quarter(date) AS BIGINT) AS quarter FROM {src}")


def predictor_features_select(src: str) -> str:
    return (f"SELECT entity_id, series_id, date, value AS level, {mom_expr()} AS mom_pct,"
            f" {strict('avg', 3)} AS ma3, {strict('stddev_samp', 3)} AS vol3 FROM {src}")


def long_select(src: str) -> str:
    parts = [f"SELECT entity_id, series_id, date, {i} AS feature_idx,"
             f" {series_key()} || '_{f}' AS variable, CAST({f} AS DOUBLE) AS x FROM {src}"
             for i, f in enumerate(FEATURES)]
    return "\nUNION ALL\n".join(parts)


def analysis_ctes(view: str, target: str) -> list[str]:
    """CTEs ending in ``al``: the long complete-case analysis frame."""
    return [
        panel_cte(view),
        f"tgt AS (SELECT * FROM panel WHERE series_id = '{target}')",
        f"ty AS ({target_features_select('tgt')})",
        f"pf AS ({predictor_features_select(f'(SELECT * FROM panel WHERE series_id <> {chr(39)}{target}{chr(39)})')})",
        f"pl AS ({long_select('pf')})",
        "npred AS (SELECT entity_id, count(DISTINCT series_id) AS n_pred FROM pf GROUP BY 1)",
        "okd AS (SELECT entity_id, date, count(*) AS n_ok FROM pf WHERE level IS NOT NULL"
        " AND mom_pct IS NOT NULL AND ma3 IS NOT NULL AND vol3 IS NOT NULL GROUP BY 1, 2)",
        "cd AS (SELECT okd.entity_id, okd.date, ty.mom_pct FROM okd JOIN npred USING (entity_id)"
        " JOIN ty ON ty.entity_id = okd.entity_id AND ty.date = okd.date"
        " WHERE okd.n_ok = npred.n_pred AND ty.mom_pct IS NOT NULL)",
        "al AS (SELECT pl.*, cd.mom_pct FROM pl JOIN cd USING (entity_id, date))",
    ]


def corr_ctes(view: str, target: str) -> list[str]:
    return analysis_ctes(view, target) + [
        "cr AS (SELECT entity_id, series_id, feature_idx, variable, corr(mom_pct, x) AS correlation"
        " FROM al GROUP BY 1, 2, 3, 4"
        " HAVING corr(mom_pct, x) IS NOT NULL AND NOT isnan(corr(mom_pct, x)))",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id"
        " ORDER BY abs(correlation) DESC, series_id, feature_idx) AS rank FROM cr)",
    ]


def raw_obs_sql() -> str:
    return ("SELECT event_type AS series_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date,"
            " CASE WHEN event_id % 17 = 0 THEN '.' ELSE CAST(value AS VARCHAR) END AS value"
            " FROM events")


def collected_ctes(target: str = "1-URGENT") -> list[str]:
    return [
        panel_cte("monthly_orders", "mo"),
        panel_cte("daily_ship", "ds"),
        panel_cte("nation_monthly", "nm"),
        "cp AS ("
        f"SELECT *, 'target' AS category FROM mo WHERE series_id = '{target}'"
        f" UNION ALL SELECT *, 'market_returns' FROM mo WHERE series_id <> '{target}'"
        " UNION ALL SELECT *, 'bond_market' FROM ds"
        " UNION ALL SELECT *, 'macro_indicators' FROM nm)",
        "keys AS (SELECT DISTINCT category, series_id, category || '_' || lower(series_id) AS key FROM cp)",
        "cat AS (SELECT series_id, category, CASE WHEN category = 'target' THEN 'target'"
        " ELSE 'predictor' END AS role, key FROM keys"
        " UNION ALL SELECT 'NO-OBSERVATIONS', 'macro_indicators', 'predictor',"
        " 'macro_indicators_no-observations')",
    ]


def dirty_ctes() -> list[str]:
    return [
        panel_cte("monthly_orders"),
        "dirty0 AS (SELECT entity_id, series_id, date,"
        " CASE WHEN month(date) = 6 THEN NULL ELSE value END AS value FROM panel)",
        "dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE month(date) = 1)",
    ]


def feature_matrix_ctes(view: str, target: str, n_pred: int | None = None, L: int = 3, TL: int = 3) -> list[str]:
    k = "entity_id, series_id, feature_idx"
    wv = f"OVER (PARTITION BY {k} ORDER BY date)"

    def fr(n):
        return f"OVER (PARTITION BY {k} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    sm = lambda agg, n: f"CASE WHEN count(x) {fr(n)} = {n} THEN {agg}(x) {fr(n)} END"
    base = f"P + P * {L} + {TL}"
    parts = ["SELECT entity_id, date, mom_pct, variable AS feature, pidx AS ordinal, x AS value FROM sel"]
    for j in range(1, L + 1):
        parts.append(f"SELECT entity_id, date, mom_pct, variable || '_lag{j}', P + pidx * {L} + {j - 1},"
                     f" lag(x, {j}) {wv} FROM sel")
    parts += [
        f"SELECT entity_id, date, mom_pct, variable || '_ma3', {base} + pidx * 3, {sm('avg', 3)} FROM sel",
        f"SELECT entity_id, date, mom_pct, variable || '_vol3', {base} + pidx * 3 + 1,"
        f" {sm('stddev_samp', 3)} FROM sel",
        f"SELECT entity_id, date, mom_pct, variable || '_ma6', {base} + pidx * 3 + 2, {sm('avg', 6)} FROM sel",
        f"SELECT entity_id, date, mom_pct, variable || '_mom3', {base} + 3 * P + pidx * 2,"
        f" x - lag(x, 3) {wv} FROM sel",
        f"SELECT entity_id, date, mom_pct, variable || '_mom6', {base} + 3 * P + pidx * 2 + 1,"
        f" x / lag(x, 6) {wv} - 1 FROM sel",
    ]
    for j in range(1, TL + 1):
        parts.append(f"SELECT entity_id, date, mom_pct, 'mom_pct_lag{j}', P + P * {L} + {j - 1},"
                     f" lag(mom_pct, {j}) OVER (PARTITION BY entity_id ORDER BY date)"
                     f" FROM sel WHERE pidx = 0")
    return analysis_ctes(view, target) + [
        "vars AS (SELECT entity_id, series_id, feature_idx, variable, row_number() OVER"
        " (PARTITION BY entity_id ORDER BY series_id, feature_idx) - 1 AS pidx"
        " FROM (SELECT DISTINCT entity_id, series_id, feature_idx, variable FROM al))",
        f"vsel AS (SELECT entity_id, series_id, feature_idx, pidx, count(*) OVER (PARTITION BY entity_id) AS P"
        f" FROM vars {'' if n_pred is None else f'WHERE pidx < {n_pred}'})",
        "sel AS (SELECT al.*, vsel.pidx, vsel.P FROM al JOIN vsel USING (entity_id, series_id, feature_idx))",
        "fr AS (" + "\nUNION ALL\n".join(parts) + ")",
        "fm AS (SELECT * FROM fr QUALIFY count(value) OVER (PARTITION BY entity_id, date)"
        " = count(*) OVER (PARTITION BY entity_id, date))",
    ]


def split_date_ctes() -> list[str]:
    """``sd``: the 70 / 15 / 15 split of each entity's complete dates in ``fm``."""
    return [
        "dt0 AS (SELECT entity_id, date, row_number() OVER (PARTITION BY entity_id ORDER BY date) - 1 AS rn,"
        " count(*) OVER (PARTITION BY entity_id) AS n FROM (SELECT DISTINCT entity_id, date FROM fm) q)",
        "sd AS (SELECT entity_id, date, CASE WHEN rn < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'"
        " WHEN rn < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) + CAST(trunc(n * 0.15::DOUBLE) AS BIGINT)"
        " THEN 'validation' ELSE 'test' END AS split FROM dt0)",
    ]


def ar_ctes(view: str) -> list[str]:
    """Per-series AR(3) rows, 70/15/15 split, Gram by covar_pop, Cramer solve."""
    k = "entity_id, series_id"
    lagc = ", ".join(f"lag(mom_pct, {j}) OVER (PARTITION BY {k} ORDER BY date) AS x{j}" for j in (1, 2, 3))
    det = "a11*(a22*a33 - a23*a23) - a12*(a12*a33 - a23*a13) + a13*(a12*a23 - a22*a13)"
    return [
        panel_cte(view),
        f"m AS (SELECT {k}, date, {mom_expr()} AS mom_pct FROM panel)",
        f"lg AS (SELECT {k}, date, mom_pct AS y, {lagc} FROM m)",
        "ar AS (SELECT * FROM lg WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL)",
        f"sp AS (SELECT *, CASE WHEN rn < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'"
        f" WHEN rn < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) + CAST(trunc(n * 0.15::DOUBLE) AS BIGINT)"
        f" THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER"
        f" (PARTITION BY {k} ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM ar))",
        f"g AS (SELECT {k}, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3,"
        " covar_pop(x1, x1) AS a11, covar_pop(x1, x2) AS a12, covar_pop(x1, x3) AS a13,"
        " covar_pop(x2, x2) AS a22, covar_pop(x2, x3) AS a23, covar_pop(x3, x3) AS a33,"
        " covar_pop(x1, y) AS b1, covar_pop(x2, y) AS b2, covar_pop(x3, y) AS b3, var_pop(y) AS vy"
        f" FROM sp WHERE split = 'train' GROUP BY 1, 2)",
        f"d AS (SELECT *, {det} AS det FROM g)",
        "cf AS (SELECT *,"
        " (b1*(a22*a33 - a23*a23) - a12*(b2*a33 - a23*b3) + a13*(b2*a23 - a22*b3)) / det AS c1,"
        " (a11*(b2*a33 - a23*b3) - b1*(a12*a33 - a23*a13) + a13*(a12*b3 - b2*a13)) / det AS c2,"
        " (a11*(a22*b3 - b2*a23) - a12*(a12*b3 - b2*a13) + b1*(a12*a23 - a22*a13)) / det AS c3 FROM d)",
        "fit AS (SELECT entity_id, series_id, n, CASE WHEN n >= 10 THEN 'ok' ELSE 'Insufficient training data' END"
        " AS status, CASE WHEN n >= 10 THEN my - (m1*c1 + m2*c2 + m3*c3) END AS intercept,"
        " CASE WHEN n >= 10 THEN c1 END AS c1, CASE WHEN n >= 10 THEN c2 END AS c2,"
        " CASE WHEN n >= 10 THEN c3 END AS c3 FROM cf)",
        "pr AS (SELECT sp.entity_id, sp.series_id, sp.date, sp.split, sp.y,"
        " fit.intercept + (((0.0 + sp.x1 * fit.c1) + sp.x2 * fit.c2) + sp.x3 * fit.c3) AS prediction"
        " FROM sp JOIN fit USING (entity_id, series_id) WHERE fit.status = 'ok' AND sp.split <> 'train')",
    ]


def cv_ctes(view: str, m: int, step: int, horizon: int) -> list[str]:
    """Expanding CV of AR(3) per series from the definition: a fold's training
    rows are joined to it and aggregated; coefficients by Cramer."""
    k = "entity_id, series_id"
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    cov = ", ".join([f"covar_pop(x{i}, x{j}) * count(*) AS a{i}{j}" for i, j in pairs]
                    + [f"covar_pop(x{i}, y) * count(*) AS b{i}" for i in (1, 2, 3)]
                    + [f"avg(x{i}) AS m{i}" for i in (1, 2, 3)])
    det = "a11*(a22*a33 - a23*a23) - a12*(a12*a33 - a23*a13) + a13*(a12*a23 - a22*a13)"
    return ar_ctes(view)[:4] + [
        f"ps AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY date) - 1 AS rn,"
        f" count(*) OVER (PARTITION BY {k}) AS n FROM ar)",
        f"fs AS (SELECT {k}, unnest(range({m}, max(n) - {horizon}, {step})) AS e FROM ps GROUP BY 1, 2)",
        f"fe AS (SELECT fs.entity_id, fs.series_id, (e - {m}) // {step} AS fold, CAST(count(*) AS DOUBLE) AS s_n,"
        f" avg(y) AS my, {cov} FROM fs JOIN ps ON fs.entity_id = ps.entity_id AND fs.series_id = ps.series_id"
        f" AND ps.rn < fs.e GROUP BY 1, 2, 3)",
        f"fd AS (SELECT *, {det} AS det FROM fe)",
        "fc AS (SELECT *,"
        " (b1*(a22*a33 - a23*a23) - a12*(b2*a33 - a23*b3) + a13*(b2*a23 - a22*b3)) / det AS c1,"
        " (a11*(b2*a33 - a23*b3) - b1*(a12*a33 - a23*a13) + a13*(a12*b3 - b2*a13)) / det AS c2,"
        " (a11*(a22*b3 - b2*a23) - a12*(a12*b3 - b2*a13) + b1*(a12*a23 - a22*a13)) / det AS c3 FROM fd)",
        "ff AS (SELECT entity_id, series_id, fold, c1, c2, c3,"
        " my - (c1 * m1 + c2 * m2 + c3 * m3) AS intercept FROM fc)",
        f"cvp AS (SELECT ps.entity_id, ps.series_id, ff.fold, ps.y,"
        f" ff.intercept + (((0.0 + ps.x1 * ff.c1) + ps.x2 * ff.c2) + ps.x3 * ff.c3) AS prediction"
        f" FROM ps JOIN ff ON ps.entity_id = ff.entity_id AND ps.series_id = ff.series_id"
        f" AND ff.fold = (ps.rn - {m}) // {step}"
        f" WHERE ps.rn >= {m} AND (ps.rn - {m}) % {step} < {horizon})",
    ]


METRICS_SELECT = ("sqrt(avg((y - prediction) * (y - prediction))) AS rmse, avg(abs(y - prediction)) AS mae,"
                  " avg(CAST(CAST(sign(y) AS DOUBLE) = CAST(sign(prediction) AS DOUBLE) AS DOUBLE))"
                  " AS directional_accuracy, count(*) AS n_predictions")


def ridge_cv_ctes(view: str, m: int, step: int, horizon: int, alpha: float = 1.0) -> list[str]:
    """Expanding-fold standardised ridge (3 features): a fold's centred sums,
    population std scaling (zero std -> 1), (Z'Z + alpha I) w = Z'y by Cramer."""
    base = cv_ctes(view, m, step, horizon)[:7]           # ... ps, fs, fe (centred sums per fold)
    d = ", ".join(f"CASE WHEN a{i}{i} <= 0 THEN 1.0 ELSE sqrt(a{i}{i} / s_n) END AS d{i}" for i in (1, 2, 3))
    r = ", ".join([f"a{i}{j} / (d{i} * d{j}){' + ' + repr(alpha) if i == j else ''} AS r{i}{j}"
                   for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
                  + [f"b{i} / d{i} AS q{i}" for i in (1, 2, 3)])
    det = "r11*(r22*r33 - r23*r23) - r12*(r12*r33 - r23*r13) + r13*(r12*r23 - r22*r13)"
    return base + [
        f"sd AS (SELECT *, {d} FROM fe)",
        f"rr AS (SELECT *, {r} FROM sd)",
        f"rd AS (SELECT *, {det} AS rdet FROM rr)",
        "rw AS (SELECT *,"
        " (q1*(r22*r33 - r23*r23) - r12*(q2*r33 - r23*q3) + r13*(q2*r23 - r22*q3)) / rdet / d1 AS c1,"
        " (r11*(q2*r33 - r23*q3) - q1*(r12*r33 - r23*r13) + r13*(r12*q3 - q2*r13)) / rdet / d2 AS c2,"
        " (r11*(r22*q3 - q2*r23) - r12*(r12*q3 - q2*r13) + q1*(r12*r23 - r22*r13)) / rdet / d3 AS c3 FROM rd)",
        "rf AS (SELECT entity_id, series_id, fold, c1, c2, c3,"
        " my - (c1 * m1 + c2 * m2 + c3 * m3) AS intercept FROM rw)",
        f"rcv AS (SELECT ps.entity_id, ps.series_id, rf.fold, ps.y,"
        f" rf.intercept + (((0.0 + ps.x1 * rf.c1) + ps.x2 * rf.c2) + ps.x3 * rf.c3) AS prediction"
        f" FROM ps JOIN rf ON ps.entity_id = rf.entity_id AND ps.series_id = rf.series_id"
        f" AND rf.fold = (ps.rn - {m}) // {step}"
        f" WHERE ps.rn >= {m} AND (ps.rn - {m}) % {step} < {horizon})",
    ]


def elimination_ctes(src: str, keep: str, p: int) -> list[str]:
    """Gauss elimination of p equations a{i}_{j} w{j} = b{i} for each row of
    ``src`` (symmetric positive definite, so without pivoting), one CTE for each
    step; ends in ``solved`` with w0..w{p-1} and the columns ``keep``."""
    out, name = [], src
    for k in range(p):
        cols = [f"a{k}_{j}" for j in range(k, p)] + [f"b{k}"]
        for i in range(k + 1, p):
            f = f"(a{i}_{k} / a{k}_{k})"
            cols += [f"a{i}_{j} - {f} * a{k}_{j} AS a{i}_{j}" for j in range(k + 1, p)] + [f"b{i} - {f} * b{k} AS b{i}"]
        done = [f"a{i}_{j}" for i in range(k) for j in range(i, p)] + [f"b{i}" for i in range(k)]
        out.append(f"e{k} AS MATERIALIZED (SELECT {keep}, {', '.join(done + cols)} FROM {name})")
        name = f"e{k}"
    for k in range(p - 1, -1, -1):
        right = "".join(f" - a{k}_{j} * w{j}" for j in range(k + 1, p))
        out.append(f"w{k}s AS MATERIALIZED (SELECT *, (b{k}{right}) / a{k}_{k} AS w{k} FROM {name})")
        name = f"w{k}s"
    out.append(f"solved AS (SELECT {keep}, {', '.join(f'w{i}' for i in range(p))} FROM {name})")
    return out


def ridge_ctes(view: str, target: str, p: int, alpha: float = 1.0) -> list[str]:
    """Standardised ridge on the first ``p`` features of each entity's training
    dates, from the definition."""
    rows = ", ".join(f"max(value) FILTER (WHERE ordinal = {i}) AS x{i}" for i in range(p))
    sums = ", ".join([f"covar_pop(x{i}, x{j}) * count(*) AS s{i}_{j}" for i in range(p) for j in range(i, p)]
                     + [f"covar_pop(x{i}, y) * count(*) AS t{i}, avg(x{i}) AS m{i},"
                        f" CASE WHEN var_pop(x{i}) = 0 THEN 1.0 ELSE sqrt(var_pop(x{i})) END AS d{i}" for i in range(p)])
    std = ", ".join([f"s{min(i, j)}_{max(i, j)} / (d{i} * d{j}){f' + {alpha}' if i == j else ''} AS a{i}_{j}"
                     for i in range(p) for j in range(p)] + [f"t{i} / d{i} AS b{i}" for i in range(p)])
    keep = "entity_id, n_train, my, " + ", ".join(f"m{i}, d{i}" for i in range(p))
    return feature_matrix_ctes(view, target) + [
        "dt AS (SELECT entity_id, date, row_number() OVER (PARTITION BY entity_id ORDER BY date) - 1 AS rn,"
        " count(*) OVER (PARTITION BY entity_id) AS n FROM (SELECT DISTINCT entity_id, date FROM fm) q)",
        f"tr AS (SELECT fm.entity_id, fm.date, max(mom_pct) AS y, {rows} FROM fm JOIN dt"
        " ON fm.entity_id = dt.entity_id AND fm.date = dt.date WHERE rn < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT)"
        " GROUP BY 1, 2)",
        f"gs AS MATERIALIZED (SELECT entity_id, count(*) AS n_train, avg(y) AS my, {sums} FROM tr GROUP BY 1)",
        f"st AS MATERIALIZED (SELECT {keep}, {std} FROM gs)",
        *elimination_ctes("st", keep, p),
        "ridge AS (SELECT entity_id, n_train, CASE WHEN n_train >= 20 THEN 'ok' ELSE 'Insufficient training data' END"
        " AS status, " + ", ".join(f"CASE WHEN n_train >= 20 THEN w{i} / d{i} END AS c{i}" for i in range(p))
        + ", CASE WHEN n_train >= 20 THEN my - (" + " + ".join(f"m{i} * w{i} / d{i}" for i in range(p))
        + ") END AS intercept FROM solved)",
    ]


def var_ctes(view: str, p: int) -> list[str]:
    """VAR(1) per entity with ``p`` series: OLS of each series' change on all
    series' changes of the row before, over dates where all are known."""
    k = "entity_id, series_id"
    x = ", ".join(f"max(l) FILTER (WHERE i = {j}) AS x{j}" for j in range(p))
    cov = ", ".join([f"covar_pop(x{i}, x{j}) * count(*) AS a{i}_{j}" for i in range(p) for j in range(p)]
                    + [f"covar_pop(x{i}, y) * count(*) AS b{i}, avg(x{i}) AS m{i}" for i in range(p)])
    keep = "entity_id, equation, n_train, my, " + ", ".join(f"m{i}" for i in range(p))
    long = " UNION ALL ".join(
        f"SELECT s.entity_id, s.equation, n_train, {j} AS i, CASE WHEN n_train >= {p + 2} THEN w{j} END AS coef,"
        f" CASE WHEN n_train >= {p + 2} THEN my - ({' + '.join(f'm{i} * w{i}' for i in range(p))}) END AS intercept"
        " FROM solved s" for j in range(p))
    return [
        panel_cte(view),
        f"m AS (SELECT {k}, date, {mom_expr()} AS c FROM panel)",
        f"lg AS (SELECT {k}, date, c, lag(c) OVER (PARTITION BY {k} ORDER BY date) AS l FROM m)",
        "nm AS (SELECT entity_id, series_id, row_number() OVER (PARTITION BY entity_id ORDER BY series_id) - 1 AS i"
        " FROM (SELECT DISTINCT entity_id, series_id FROM panel) q)",
        "ok AS (SELECT lg.*, nm.i FROM lg JOIN nm USING (entity_id, series_id) WHERE c IS NOT NULL AND l IS NOT NULL)",
        f"wd AS (SELECT entity_id, date, {x} FROM ok GROUP BY 1, 2 HAVING count(*) = {p})",
        "ds AS (SELECT ok.entity_id, ok.series_id AS equation, ok.c AS y, wd.* EXCLUDE (entity_id) FROM ok"
        " JOIN wd ON ok.entity_id = wd.entity_id AND ok.date = wd.date)",
        f"st AS MATERIALIZED (SELECT entity_id, equation, count(*) AS n_train, avg(y) AS my, {cov} FROM ds GROUP BY 1, 2)",
        *elimination_ctes("st", keep, p),
        f"ll AS ({long})",
        f"var_long AS (SELECT ll.entity_id, equation, CASE WHEN n_train >= {p + 2} THEN 'ok' ELSE"
        " 'Insufficient training data' END AS status, n_train, intercept, nm.series_id || '_lag1' AS feature, coef"
        " FROM ll JOIN nm ON ll.entity_id = nm.entity_id AND ll.i = nm.i)",
    ]


def chow_ctes(view: str) -> list[str]:
    """Chow F of AR(3) at the midpoint: residual sums of squares of the pooled
    sample and of both halves, each by its own regression (Cramer)."""
    k = "entity_id, series_id"
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    cov = ", ".join([f"covar_pop(x{i}, x{j}) * count(*) AS a{i}{j}" for i, j in pairs]
                    + [f"covar_pop(x{i}, y) * count(*) AS b{i}" for i in (1, 2, 3)])
    det = "(a11*(a22*a33 - a23*a23) - a12*(a12*a33 - a23*a13) + a13*(a12*a23 - a22*a13))"
    c = ["(b1*(a22*a33 - a23*a23) - a12*(b2*a33 - a23*b3) + a13*(b2*a23 - a22*b3))",
         "(a11*(b2*a33 - a23*b3) - b1*(a12*a33 - a23*a13) + a13*(a12*b3 - b2*a13))",
         "(a11*(a22*b3 - b2*a23) - a12*(a12*b3 - b2*a13) + b1*(a12*a23 - a22*a13))"]
    return ar_ctes(view)[:4] + [
        f"h AS (SELECT *, CASE WHEN 2 * row_number() OVER (PARTITION BY {k} ORDER BY date)"
        f" > count(*) OVER (PARTITION BY {k}) THEN 1 ELSE 0 END AS half FROM ar)",
        "hh AS (SELECT * FROM h UNION ALL SELECT * REPLACE (-1 AS half) FROM h)",
        f"g AS (SELECT {k}, half, count(*) AS n, var_pop(y) * count(*) AS yy, {cov} FROM hh GROUP BY 1, 2, 3)",
        f"r AS (SELECT {k}, half, n, yy - (b1 * {c[0]} + b2 * {c[1]} + b3 * {c[2]}) / {det} AS ssr FROM g)",
        "z AS (SELECT p.entity_id, p.series_id, p.n, p.ssr AS sp, a.ssr + b.ssr AS sh FROM r p"
        " JOIN r a ON p.entity_id = a.entity_id AND p.series_id = a.series_id AND a.half = 0"
        " JOIN r b ON p.entity_id = b.entity_id AND p.series_id = b.series_id AND b.half = 1 WHERE p.half = -1)",
        "chow AS (SELECT entity_id, series_id, n, CASE WHEN n > 8 AND sh > 0 THEN ((sp - sh) / 4) / (sh / (n - 8)) END"
        " AS chow_f FROM z)",
    ]


# ------------------------------------------------------------------ trees

def poisson_sql(seed: int) -> str:
    """The bootstrap weight of ``operators.trees.poisson_weight``, from its definition."""
    a = f"((row * 7919 + tree * 104729 + {seed * 1299709 + 12345}) % 2147483647)"
    for c in (1013904223, 362437):
        a = f"(({a} * {a} + {c}) % 2147483647)"
    cdf = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    return "CASE " + " ".join(f"WHEN {a} / 2147483647.0::DOUBLE < {p}::DOUBLE THEN {k}" for k, p in enumerate(cdf)) + f" ELSE {len(cdf)} END"


def training_ctes(view: str, target: str, min_rows: int) -> list[str]:
    """``tx``: (entity_id, row, y, f, bin, x) of the training rows of entities with enough of them; ``nf``: names."""
    return feature_matrix_ctes(view, target) + split_date_ctes() + [
        "td AS (SELECT entity_id, date, row_number() OVER (PARTITION BY entity_id ORDER BY date) - 1 AS row,"
        " count(*) OVER (PARTITION BY entity_id) AS n FROM sd WHERE split = 'train')",
        "tx AS MATERIALIZED (SELECT fm.entity_id, row, mom_pct AS y, ordinal AS f, value AS x, dense_rank() OVER"
        " (PARTITION BY fm.entity_id, ordinal ORDER BY value) AS bin FROM fm JOIN td ON fm.entity_id = td.entity_id"
        f" AND fm.date = td.date WHERE n >= {min_rows})",
        "tr AS (SELECT DISTINCT entity_id, row, y FROM tx)",
        "nf AS (SELECT DISTINCT entity_id, ordinal AS f, feature FROM fm)",
    ]


def level_ctes(at: str, tag: str) -> list[str]:
    """Nodes ``n{tag}`` of a level from its rows ``at`` (entity_id, row, tree, w, yi, node), each with its
    best cut, and the rows of the next level ``r{tag}``."""
    k = "entity_id, tree, node"
    on = "USING (entity_id, tree, node)"
    return [
        f"s{tag} AS MATERIALIZED (SELECT {k}, sum(w) AS n, sum(w * yi) AS s, min(yi) < max(yi) AS mixed FROM {at} GROUP BY {k})",
        f"h{tag} AS (SELECT a.entity_id, a.tree, a.node, f, bin, sum(w) AS w, sum(w * yi) AS s, min(x) AS lo, max(x) AS hi"
        f" FROM {at} a JOIN s{tag} {on} JOIN tx ON tx.entity_id = a.entity_id AND tx.row = a.row WHERE mixed GROUP BY ALL)",
        f"c{tag} AS (SELECT {k}, f, bin, hi, lead(lo) OVER w AS nxt, CAST(sum(w) OVER w AS DOUBLE) AS wl,"
        f" CAST(sum(s) OVER w AS DOUBLE) AS sl, CAST(sum(w) OVER v AS DOUBLE) AS wa, CAST(sum(s) OVER v AS DOUBLE) AS sa"
        f" FROM h{tag} WINDOW w AS (PARTITION BY {k}, f ORDER BY bin), v AS (PARTITION BY {k}, f))",
        f"g{tag} AS (SELECT {k}, f, bin, CASE WHEN (hi + nxt) / 2 < nxt THEN (hi + nxt) / 2 ELSE hi END AS thr,"
        f" sl * sl / wl + (sa - sl) * (sa - sl) / (wa - wl) AS g FROM c{tag} WHERE wl < wa)",
        f"b{tag} AS (SELECT *, 2 * (row_number() OVER (PARTITION BY entity_id, tree ORDER BY node) - 1) AS l FROM (SELECT * FROM g{tag}"
        f" QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY g DESC, f, bin) = 1))",
        f"n{tag} AS MATERIALIZED (SELECT {k}, n, CAST(s AS DOUBLE) / n / 1000000.0::DOUBLE AS value, f, thr, l,"
        f" (g - CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / n) / 1e12::DOUBLE AS gain FROM s{tag} LEFT JOIN b{tag} {on})",
        f"r{tag} AS MATERIALIZED (SELECT a.entity_id, a.row, a.tree, a.w, a.yi, l + CASE WHEN x > thr THEN 1 ELSE 0 END AS node"
        f" FROM {at} a JOIN b{tag} {on} JOIN tx ON tx.entity_id = a.entity_id AND tx.row = a.row AND tx.f = b{tag}.f)",
    ]


def leaf_nodes_cte(at: str, tag: str) -> str:
    """Nodes of a level at which the trees end."""
    return (f"n{tag} AS (SELECT entity_id, tree, node, sum(w) AS n, CAST(sum(w * yi) AS DOUBLE) / sum(w) / 1000000.0::DOUBLE AS value,"
            f" NULL AS f, NULL AS thr, NULL AS l, NULL AS gain FROM {at} GROUP BY ALL)")


def forest_ctes(view: str, target: str, n_trees: int, depth: int, seed: int, min_rows: int) -> list[str]:
    """``nodes``: a bootstrap forest grown to a fixed depth for each entity."""
    out = training_ctes(view, target, min_rows) + [
        "a0 AS MATERIALIZED (SELECT *, CAST(0 AS BIGINT) AS node FROM (SELECT entity_id, row, tree, CAST(round(y * 1000000) AS BIGINT) AS yi,"
        f" {poisson_sql(seed)} AS w FROM tr, range({n_trees}) t(tree)) WHERE w > 0)"]
    at = "a0"
    for k in range(depth):
        out += level_ctes(at, str(k))
        at = f"r{k}"
    out.append(leaf_nodes_cte(at, str(depth)))
    union = " UNION ALL ".join(f"SELECT entity_id, tree, {k} AS level, node, n, value, f, thr, gain FROM n{k}" for k in range(depth + 1))
    return out + [
        f"nodes AS MATERIALIZED (SELECT u.*, feature FROM ({union}) u LEFT JOIN nf ON nf.entity_id = u.entity_id AND nf.f = u.f)",
        "sh AS (SELECT entity_id, tree, feature, sum(gain) AS g, sum(sum(gain)) OVER (PARTITION BY entity_id, tree) AS t FROM nodes"
        " WHERE f IS NOT NULL GROUP BY 1, 2, 3)",
        "tn AS (SELECT entity_id, count(DISTINCT tree) AS k FROM sh GROUP BY 1)",
        "im AS (SELECT tn.entity_id, nf.feature, coalesce(sum(sh.g / sh.t) / max(k), 0.0) AS importance FROM tn JOIN nf USING (entity_id)"
        " LEFT JOIN sh ON sh.entity_id = nf.entity_id AND sh.feature = nf.feature GROUP BY 1, 2)"]


def stump_ctes(view: str, target: str, rounds: int, rate: float, min_rows: int) -> list[str]:
    """``nodes``: boosting with depth-1 trees: each fitted on the residual of those before."""
    out = training_ctes(view, target, min_rows) + [
        "m0 AS (SELECT entity_id, count(*) AS n, CAST(sum(CAST(round(y * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000.0::DOUBLE AS value"
        " FROM tr GROUP BY 1)",
        "e0 AS MATERIALIZED (SELECT tr.entity_id, row, y - value AS e FROM tr JOIN m0 USING (entity_id))"]
    for r in range(rounds):
        out.append(f"q{r} AS MATERIALIZED (SELECT entity_id, row, CAST({r} AS BIGINT) AS tree, 1 AS w, CAST(round(e * 1000000) AS BIGINT) AS yi,"
                   f" CAST(0 AS BIGINT) AS node FROM e{r})")
        out += level_ctes(f"q{r}", f"x{r}")
        out.append(leaf_nodes_cte(f"rx{r}", f"y{r}"))
        out.append(f"p{r} AS (SELECT a.entity_id, a.row, CAST(CAST(n.value * {rate}::DOUBLE AS DECIMAL(38,12)) AS DOUBLE) AS p FROM rx{r} a JOIN ny{r} n"
                   f" USING (entity_id, tree, node) UNION ALL SELECT q.entity_id, q.row, CAST(CAST(n.value * {rate}::DOUBLE AS DECIMAL(38,12)) AS DOUBLE)"
                   f" FROM q{r} q JOIN nx{r} n USING (entity_id, tree, node) WHERE n.f IS NULL)")
        out.append(f"e{r + 1} AS MATERIALIZED (SELECT entity_id, row, e - p AS e FROM e{r} JOIN p{r} USING (entity_id, row))")
    union = " UNION ALL ".join(
        ["SELECT entity_id, -1 AS tree, 0 AS level, 0 AS node, n, value, CAST(NULL AS BIGINT) AS f, CAST(NULL AS DOUBLE) AS thr FROM m0"]
        + [f"SELECT entity_id, tree, {i}, node, n, value * {rate}::DOUBLE, f, thr FROM n{c}{r}" for r in range(rounds) for i, c in enumerate("xy")])
    return out + [f"nodes AS (SELECT u.*, feature FROM ({union}) u LEFT JOIN nf ON nf.entity_id = u.entity_id AND nf.f = u.f)"]


def _solved_fit(model: str, p: int, where: str, least: int, alpha: float) -> list[str]:
    """Coefficients of the first ``p`` of the features numbered in ``k{model}``, by elimination of the centred sums;
    ``alpha`` = 0 is least squares. Ends in ``p{model}``: predictions of every complete date."""
    m = model
    rows = ", ".join(f"max(value) FILTER (WHERE k = {i}) AS x{i}" for i in range(p))
    sums = ", ".join([f"covar_pop(x{i}, x{j}) * count(*) AS s{i}_{j}" for i in range(p) for j in range(i, p)]
                     + [f"covar_pop(x{i}, y) * count(*) AS t{i}, avg(x{i}) AS m{i}, "
                        + (f"CASE WHEN var_pop(x{i}) = 0 THEN 1.0 ELSE sqrt(var_pop(x{i})) END" if alpha else "1.0") + f" AS d{i}"
                        for i in range(p)])
    std = ", ".join([f"s{min(i, j)}_{max(i, j)} / (d{i} * d{j}){f' + {alpha}' if i == j and alpha else ''} AS a{i}_{j}"
                     for i in range(p) for j in range(p)] + [f"t{i} / d{i} AS b{i}" for i in range(p)])
    keep = "entity_id, n_train, my, " + ", ".join(f"m{i}, d{i}" for i in range(p))
    names = {f"e{k}": f"{m}_e{k}" for k in range(p)} | {f"w{k}s": f"{m}_w{k}s" for k in range(p)} | {"solved": f"{m}_solved"}
    steps = []
    for c in elimination_ctes(f"st{m}", keep, p):
        head, body = c.split(" AS ", 1)
        for old, new in names.items():
            body = body.replace(f" FROM {old})", f" FROM {new})")
        steps.append(f"{names[head]} AS {body}")
    return [
        f"k{m} AS (SELECT entity_id, date, mom_pct, value, k FROM ({where}) WHERE k < {p})",
        f"xr{m} AS MATERIALIZED (SELECT q.entity_id, q.date, split, max(mom_pct) AS y, {rows} FROM k{m} q JOIN sd"
        f" ON q.entity_id = sd.entity_id AND q.date = sd.date GROUP BY 1, 2, 3)",
        f"gs{m} AS MATERIALIZED (SELECT entity_id, count(*) AS n_train, avg(y) AS my, {sums} FROM xr{m} WHERE split = 'train'"
        f" GROUP BY 1 HAVING count(*) >= {least})",
        f"st{m} AS MATERIALIZED (SELECT {keep}, {std} FROM gs{m})", *steps,
        f"p{m} AS (SELECT x.entity_id, '{m}' AS model, split, y, my + " + " + ".join(f"(x{i} - m{i}) * w{i} / d{i}" for i in range(p))
        + f" AS prediction FROM xr{m} x JOIN {m}_solved USING (entity_id))"]


def comparison_ctes(view: str, target: str, n_pred: int, p: int) -> list[str]:
    """``mt``: AR(3) and ridge (first ``p`` features) metrics of every split; ``tb``: the comparison table."""
    names = ("rmse", "mae", "directional_accuracy", "n_predictions")
    wide = ", ".join(f"max(CASE WHEN split = '{s}' THEN {c} END) AS {s}_{c}" for s in ("train", "validation", "test") for c in names)
    lags = "SELECT *, CAST(right(feature, 1) AS INT) - 1 AS k FROM fm WHERE regexp_matches(feature, '^mom_pct_lag[123]$')"
    return feature_matrix_ctes(view, target, n_pred) + split_date_ctes() + [
        *_solved_fit("ar", 3, lags, 10, 0.0), *_solved_fit("ridge", p, "SELECT *, ordinal AS k FROM fm", 20, 1.0),
        f"mt AS MATERIALIZED (SELECT entity_id, model, split, {METRICS_SELECT} FROM (SELECT * FROM par UNION ALL SELECT * FROM pridge)"
        " GROUP BY 1, 2, 3)",
        "en AS (SELECT DISTINCT entity_id FROM panel)",
        "nt AS (SELECT entity_id, count(*) FILTER (WHERE split = 'train') AS n_train FROM sd GROUP BY 1)",
        f"mw AS (SELECT entity_id, model, {wide} FROM mt GROUP BY 1, 2)",
        "t0 AS (SELECT entity_id, model, CASE WHEN coalesce(n_train, 0) = 0 THEN 'No complete rows' WHEN n_train < least THEN"
        " 'Insufficient training data' ELSE 'ok' END AS status, coalesce(n_train, 0) AS n_train, CASE WHEN n_train > 0 THEN few END AS n_features,"
        " * EXCLUDE (entity_id, model, n_train, least, few) FROM en LEFT JOIN nt USING (entity_id)"
        f" CROSS JOIN (VALUES ('ar', 10, 3), ('ridge', 20, {p})) v(model, least, few) LEFT JOIN mw USING (entity_id, model))",
        "tb AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY test_rmse NULLS LAST, model) = 1 AND test_rmse IS NOT NULL AS best,"
        " CASE WHEN test_directional_accuracy > 0.5 THEN 'has predictive power' WHEN test_rmse IS NOT NULL THEN 'no directional skill' END AS skill"
        " FROM t0)",
    ]


# ------------------------------------------------------------------ selection, breaks

def lasso_pair_ctes(view: str, target: str, share: float, min_rows: int) -> list[str]:
    """``lp``: the two-feature lasso in closed form: both in with their signs, one alone, or none."""
    return training_ctes(view, target, min_rows) + [
        "w2 AS (SELECT entity_id, row, max(y) AS y, max(x) FILTER (WHERE f = 0) AS x0, max(x) FILTER (WHERE f = 1) AS x1 FROM tx WHERE f < 2 GROUP BY 1, 2)",
        "st AS (SELECT entity_id, count(*) AS n, avg(y) AS my, avg(x0) AS m0, avg(x1) AS m1, stddev_pop(x0) AS d0, stddev_pop(x1) AS d1,"
        " covar_pop(x0, y) / stddev_pop(x0) AS b0, covar_pop(x1, y) / stddev_pop(x1) AS b1, corr(x0, x1) AS r FROM w2 GROUP BY 1)",
        f"la AS (SELECT *, {share}::DOUBLE * greatest(abs(b0), abs(b1)) AS lam FROM st)",
        "bo AS (SELECT entity_id, (b0 - lam * s0 - r * (b1 - lam * s1)) / (1 - r * r) AS u0, (b1 - lam * s1 - r * (b0 - lam * s0)) / (1 - r * r) AS u1"
        " FROM la, (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) v(s0, s1) WHERE (b0 - lam * s0 - r * (b1 - lam * s1)) * s0 > 0"
        " AND (b1 - lam * s1 - r * (b0 - lam * s0)) * s1 > 0)",
        "so AS (SELECT la.*, u0, u1, sign(b0) * greatest(abs(b0) - lam, 0) AS a0, sign(b1) * greatest(abs(b1) - lam, 0) AS a1 FROM la LEFT JOIN bo USING (entity_id))",
        "lw AS (SELECT *, CASE WHEN u0 IS NOT NULL THEN u0 WHEN abs(b1 - r * a0) <= lam THEN a0 ELSE 0 END AS w0,"
        " CASE WHEN u0 IS NOT NULL THEN u1 WHEN abs(b1 - r * a0) <= lam THEN 0 ELSE a1 END AS w1 FROM so)",
        "lp AS (SELECT entity_id, n AS n_train, lam AS penalty, w0 / d0 AS c0, w1 / d1 AS c1, my - m0 * w0 / d0 - m1 * w1 / d1 AS intercept FROM lw)",
    ]


def stepwise_ctes(view: str, target: str, steps: int, min_rows: int, f_enter: float) -> list[str]:
    """``sw``: forward selection by sweeping the long table of centred products, one step for each CTE group."""
    out = training_ctes(view, target, min_rows) + [
        "al2 AS (SELECT entity_id, row, f, x FROM tx UNION ALL SELECT entity_id, row, -1, y FROM tr)",
        "g0 AS MATERIALIZED (SELECT a.entity_id, a.f AS i, b.f AS j, covar_pop(a.x, b.x) * count(*) AS v FROM al2 a JOIN al2 b"
        " ON a.entity_id = b.entity_id AND a.row = b.row GROUP BY 1, 2, 3)",
        "dg AS (SELECT entity_id, i, v AS first FROM g0 WHERE i = j)",
        "nn AS (SELECT entity_id, count(*) AS n FROM tr GROUP BY 1)"]
    for s in range(1, steps + 1):
        old = f"g{s - 1}"
        gone = "".join(f" AND NOT EXISTS (FROM k{t} z WHERE z.entity_id = d.entity_id AND z.k = d.i)" for t in range(1, s))
        out += [
            f"k{s} AS MATERIALIZED (SELECT entity_id, k, rss, fs FROM (SELECT d.entity_id, d.i AS k, yy.v - c.v * c.v / d.v AS rss,"
            f" (c.v * c.v / d.v) / ((yy.v - c.v * c.v / d.v) / (n - {s + 1})) AS fs, c.v * c.v / d.v AS gain FROM {old} d"
            f" JOIN {old} c ON c.entity_id = d.entity_id AND c.i = d.i AND c.j = -1"
            f" JOIN {old} yy ON yy.entity_id = d.entity_id AND yy.i = -1 AND yy.j = -1 JOIN nn ON nn.entity_id = d.entity_id"
            f" JOIN dg ON dg.entity_id = d.entity_id AND dg.i = d.i WHERE d.i = d.j AND d.i >= 0 AND d.v > 1e-9 * first AND n - {s + 1} >= 1{gone}"
            f" QUALIFY row_number() OVER (PARTITION BY d.entity_id ORDER BY gain DESC, d.i) = 1) WHERE fs >= {f_enter})",
            f"g{s} AS MATERIALIZED (SELECT g.entity_id, g.i, g.j, g.v - a.v * b.v / p.v AS v FROM {old} g JOIN k{s} k USING (entity_id)"
            f" JOIN {old} a ON a.entity_id = g.entity_id AND a.i = g.i AND a.j = k.k JOIN {old} b ON b.entity_id = g.entity_id AND b.i = k.k AND b.j = g.j"
            f" JOIN {old} p ON p.entity_id = g.entity_id AND p.i = k.k AND p.j = k.k)"]
    union = " UNION ALL ".join(f"SELECT entity_id, {s} AS step, k, rss, fs FROM k{s}" for s in range(1, steps + 1))
    return out + [f"sw AS (SELECT u.entity_id, step, feature, rss, fs AS f FROM ({union}) u JOIN nf ON nf.entity_id = u.entity_id AND nf.f = u.k)"]


def break_ctes(view: str, trim: float) -> list[str]:
    """``bt``: sup-F of AR(3) per series: running and remaining sums of products, each solved by elimination."""
    k = "entity_id, series_id"
    v = ["1.0::DOUBLE", "z1", "z2", "z3", "zy"]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    run = ", ".join(f"sum({v[i]} * {v[j]}) OVER w AS p{i}_{j}, sum({v[i]} * {v[j]}) OVER t AS q{i}_{j}" for i, j in pairs)

    def system(expr) -> str:
        return ", ".join([f"{expr(min(i, j), max(i, j))} AS a{i}_{j}" for i in range(4) for j in range(4)]
                         + [f"{expr(i, 4)} AS b{i}" for i in range(4)] + [f"{expr(i, 4)} AS h{i}" for i in range(4)] + [f"{expr(4, 4)} AS yy"])
    sides = " UNION ALL ".join(
        f"SELECT {k}, r, nxt, n, {side} AS side, {system(e)} FROM pf" for side, e in (
            (0, lambda i, j: f"q{i}_{j}"), (1, lambda i, j: f"p{i}_{j}"), (2, lambda i, j: f"(q{i}_{j} - p{i}_{j})")))
    return ar_ctes(view)[:4] + [
        f"mn AS (SELECT {k}, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM ar GROUP BY 1, 2)",
        "cn AS (SELECT ar.entity_id, ar.series_id, date, x1 - m1 AS z1, x2 - m2 AS z2, x3 - m3 AS z3, y - my AS zy FROM ar JOIN mn"
        " ON ar.entity_id = mn.entity_id AND ar.series_id = mn.series_id)",
        f"pf AS MATERIALIZED (SELECT * FROM (SELECT {k}, row_number() OVER w AS r, lead(date) OVER w AS nxt, count(*) OVER t AS n, {run} FROM cn"
        f" WINDOW w AS (PARTITION BY {k} ORDER BY date), t AS (PARTITION BY {k}))"
        f" WHERE r >= greatest(8, ceil(n * {trim}::DOUBLE)) AND r <= n - greatest(8, ceil(n * {trim}::DOUBLE)))",
        f"sd3 AS MATERIALIZED ({sides})",
        *elimination_ctes("sd3", f"{k}, r, nxt, n, side, yy, h0, h1, h2, h3", 4),
        f"rs AS (SELECT {k}, r, max(nxt) AS nxt, max(n) AS n, sum(yy - (h0 * w0 + h1 * w1 + h2 * w2 + h3 * w3)) FILTER (WHERE side = 0) AS sp,"
        " sum(yy - (h0 * w0 + h1 * w1 + h2 * w2 + h3 * w3)) FILTER (WHERE side > 0) AS sh FROM solved GROUP BY 1, 2, 3)",
        f"fs AS (SELECT {k}, nxt, ((sp - sh) / 4) / (sh / (n - 8)) AS f FROM rs WHERE n > 8 AND sh > 0)",
        f"bt AS (SELECT a.entity_id, a.series_id, a.n, b.break_date, b.sup_f FROM (SELECT {k}, count(*) AS n FROM ar GROUP BY 1, 2) a LEFT JOIN"
        f" (SELECT {k}, max(f) AS sup_f, arg_max(nxt, f) AS break_date FROM fs GROUP BY 1, 2) b USING (entity_id, series_id))",
    ]
