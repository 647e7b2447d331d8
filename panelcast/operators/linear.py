"""Linear models fitted per group through distributed Gram sums.

A fit never moves a group's rows to one place. Either the Gram is one
partial + final aggregate on the JVM (:func:`gram`, a known small number of
features), or each Arrow batch is reduced to centred co-moments per group in
NumPy and the few partial rows per group are merged exactly
(:func:`gram_any`, any number of features, each group its own). Only the small
(p x p) Gram row of each group reaches the solver, which works on stacked
matrices. Scoring is a JVM-side dot product against the joined coefficients.

Input rows: group keys, ``y`` DOUBLE, ``x`` ARRAY<DOUBLE>,
``features`` ARRAY<STRING> (names, same for all rows of a group).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Minimum training rows per model kind.
MIN_ROWS = {"ar": 10, "ridge": 20, "forest": 30}
OK = "ok"
INSUFFICIENT = "Insufficient training data"
NOT_FINITE = "Non-finite features"
MIXED = "Rows with different feature counts"


def gram(df: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Per group: n, mean_y, mean_x[p], centred xtx[p*p] (row-major), xty[p],
    yty, and the feature names, as one partial + final aggregate; centred sums
    are ``n * covar_pop``, whose buffers Spark merges with the stable pairwise
    co-moment update. For rows that all have ``p`` features, p small."""
    keys = list(keys)
    x = [F.col("x")[i] for i in range(p)]
    n = F.count(F.lit(1))
    cov = {}
    for i in range(p):
        for j in range(i, p):
            cov[(i, j)] = F.covar_pop(x[i], x[j])
    xtx = [cov[(min(i, j), max(i, j))] * n for i in range(p) for j in range(p)]
    return df.groupBy(*keys).agg(
        n.alias("n"), F.avg("y").alias("mean_y"),
        F.array(*[F.avg(x[i]) for i in range(p)]).alias("mean_x"),
        F.first("features").alias("features"),
        F.array(*xtx).alias("xtx"),
        F.array(*[F.covar_pop(x[i], F.col("y")) * n for i in range(p)]).alias("xty"),
        (F.var_pop("y") * n).alias("yty"))


def _gram_schema(df: DataFrame, keys: list[str], with_names: bool = True) -> T.StructType:
    fields = [df.schema[k] for k in keys] + [
        T.StructField("n", T.LongType()), T.StructField("mean_y", T.DoubleType()),
        T.StructField("mean_x", T.ArrayType(T.DoubleType())),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("xtx", T.ArrayType(T.DoubleType())),
        T.StructField("xty", T.ArrayType(T.DoubleType())), T.StructField("yty", T.DoubleType())]
    return T.StructType(fields)


def gram_any(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As :func:`gram` for any number of features, taken from each group's own
    rows. A group whose rows differ in their feature count gets a row with
    NULL sums. A batch sends the co-moments of a group, or its rows where these are
    smaller (fewer rows than features)."""
    keys = list(keys)
    schema = _gram_schema(df, keys)
    sent = T.StructType([*schema.fields, T.StructField("p", T.LongType()), T.StructField("rows", T.ArrayType(T.DoubleType()))])
    names, sent_names = [f.name for f in schema.fields], [f.name for f in sent.fields]

    def moments(x: np.ndarray, y: np.ndarray) -> tuple:
        mx, my = x.mean(0), y.mean()
        with np.errstate(invalid="ignore"):                # inf stays visible in the sums
            xc, yc = x - mx, y - my
            return len(y), mx, my, xc.T @ xc, xc.T @ yc, float(yc @ yc)

    def partial(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            pdf["_p"] = pdf["x"].map(len)
            for key, g in pdf.groupby([*keys, "_p"], sort=False, dropna=False):
                x = np.stack(g["x"].map(np.asarray).to_numpy()).astype(float).reshape(-1, key[-1])
                y = g["y"].to_numpy(float)
                rec = dict.fromkeys(sent_names) | dict(zip(keys, key)) | {
                    "n": len(y), "p": key[-1], "features": list(g["features"].iloc[0])}
                if len(y) < key[-1]:
                    rec["rows"] = np.column_stack([x, y]).ravel().tolist()
                else:
                    _, mx, my, xtx, xty, yty = moments(x, y)
                    rec.update(mean_y=my, mean_x=mx.tolist(), xtx=xtx.ravel().tolist(), xty=xty.tolist(), yty=yty)
                out.append(rec)
            yield pd.DataFrame(out, columns=sent_names)

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        rec = dict.fromkeys(names) | {k: parts.iloc[0][k] for k in keys}
        if parts["p"].nunique() > 1:
            rec.update(n=int(parts["n"].sum()))
            return pd.DataFrame([rec], columns=names)
        p = int(parts["p"].iloc[0])
        whole = parts[parts["rows"].isna()]
        each = [(r.n, np.asarray(r.mean_x, float), r.mean_y, np.asarray(r.xtx, float).reshape(p, p), np.asarray(r.xty, float), r.yty)
                for r in whole.itertuples()]
        raw = [np.asarray(r, float).reshape(-1, p + 1) for r in parts["rows"].dropna()]
        if raw:
            rows = np.concatenate(raw)
            each.append(moments(rows[:, :p], rows[:, p]))
        n_b = np.array([e[0] for e in each], float)
        mx_b, my_b = np.stack([e[1] for e in each]), np.array([e[2] for e in each])
        n = n_b.sum()
        with np.errstate(invalid="ignore"):
            mx, my = (n_b[:, None] * mx_b).sum(0) / n, (n_b * my_b).sum() / n
            dx, dy = mx_b - mx, my_b - my
            xtx = sum(e[3] for e in each) + (n_b[:, None] * dx).T @ dx
            xty = sum(e[4] for e in each) + (n_b[:, None] * dx).T @ dy
            yty = sum(e[5] for e in each) + (n_b * dy) @ dy
        rec.update(n=int(n), mean_y=my, mean_x=mx.tolist(), features=list(parts["features"].iloc[0]),
                   xtx=xtx.ravel().tolist(), xty=xty.tolist(), yty=float(yty))
        return pd.DataFrame([rec], columns=names)

    vec = df.select(*keys, "y", "x", "features")
    # one partial row per (group, Arrow batch); the merge group is that small
    return vec.mapInPandas(partial, sent).groupBy(*keys).applyInPandas(merge, schema)


def _fit_schema(keys_schema: T.StructType) -> T.StructType:
    return T.StructType(list(keys_schema.fields) + [
        T.StructField("model", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("mean_x", T.ArrayType(T.DoubleType())),
        T.StructField("scale_x", T.ArrayType(T.DoubleType())),
    ])


def solve_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of stacked systems (n, p, p), (n, p). A singular one gets its
    least-norm solution and does not change how the others are solved."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        out = np.empty_like(b)
        for i, (ai, bi) in enumerate(zip(a, b)):
            try:
                out[i] = np.linalg.solve(ai, bi)
            except np.linalg.LinAlgError:
                out[i] = np.linalg.lstsq(ai, bi, rcond=None)[0]
        return out


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.map(np.asarray).to_numpy()).astype(float)


def solve_gram(g: DataFrame, keys: Sequence[str], model: str, alpha: float = 0.0,
               standardize: bool = False, min_rows: int | None = None) -> DataFrame:
    """Solve each group's Gram row. OLS when ``alpha == 0``; ridge
    ``min ||y - Zw||^2 + alpha ||w||^2`` on standardised features (population
    std, a constant feature scales by 1) with an unpenalised intercept.
    Coefficients are returned in original units. Every group gets a row; a
    ``status`` other than ``ok`` says why it has no coefficients. Without a
    fixed minimum a model needs p + 2 rows."""
    keys = list(keys)
    fixed = min_rows if min_rows is not None else MIN_ROWS.get(model)
    keys_schema = T.StructType([g.schema[k] for k in keys])
    schema = _fit_schema(keys_schema)
    names = [f.name for f in schema.fields]

    def fit(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            out = pdf[keys].copy()
            out["model"], out["n_train"] = model, pdf["n"].astype("int64")
            out["features"] = pdf["features"]
            for c in ("coef", "intercept", "mean_x", "scale_x"):
                out[c] = None
            p = pdf["features"].map(lambda f: -1 if f is None else len(f))
            out["status"] = MIXED
            known = p >= 0
            few = pdf["n"] < (fixed if fixed is not None else p + 2)
            out.loc[known, "status"] = OK
            out.loc[known & few, "status"] = INSUFFICIENT
            for size in sorted(set(p[out["status"] == OK])):
                at = np.flatnonzero((out["status"] == OK) & (p == size))
                part = pdf.iloc[at]
                n, my = part["n"].to_numpy(float), part["mean_y"].to_numpy(float)
                mx, b = _stack(part["mean_x"]), _stack(part["xty"])
                a = _stack(part["xtx"]).reshape(-1, size, size)
                good = np.isfinite(a).all((1, 2)) & np.isfinite(b).all(1) & np.isfinite(mx).all(1) & np.isfinite(my)
                out.iloc[at[~good], out.columns.get_loc("status")] = NOT_FINITE
                at, n, my, mx, a, b = at[good], n[good], my[good], mx[good], a[good], b[good]
                if not len(at):
                    continue
                scale = np.ones_like(mx)
                if standardize:
                    scale = np.sqrt(np.clip(np.einsum("nii->ni", a) / n[:, None], 0.0, None))
                    scale[scale == 0.0] = 1.0
                w = solve_each(a / (scale[:, :, None] * scale[:, None, :]) + alpha * np.eye(size), b / scale)
                coef = w / scale
                intercept = my - (mx * coef).sum(1)
                for i, j in enumerate(at):
                    row = out.index[j]
                    out.at[row, "coef"], out.at[row, "intercept"] = coef[i].tolist(), float(intercept[i])
                    out.at[row, "mean_x"], out.at[row, "scale_x"] = mx[i].tolist(), scale[i].tolist()
            out["intercept"] = out["intercept"].astype(float)
            yield out[names]

    return g.mapInPandas(fit, schema)


def fit_linear(df: DataFrame, keys: Sequence[str], model: str, p: int | None = None, alpha: float = 0.0,
               standardize: bool = False) -> DataFrame:
    """Gram + solve. ``df`` needs y, x, features; ``p`` names the number of
    features where it is the same small number for all rows."""
    g = gram(df, keys, p) if p is not None else gram_any(df, keys)
    return solve_gram(g, keys, model, alpha, standardize)


def fit_ar(df: DataFrame, keys: Sequence[str], p: int | None = 3) -> DataFrame:
    """M1: OLS with intercept of y on its lags (features already in ``x``);
    ``p=None`` uses the lags that each group has."""
    return fit_linear(df, keys, "ar", p)


def fit_ridge(df: DataFrame, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """M3: ridge, alpha = 1, on standardised features."""
    return fit_linear(df, keys, "ridge", alpha=alpha, standardize=True)


def ar_rows(panel: DataFrame, keys: Sequence[str] = ("entity_id", "series_id"),
            lags: int = 3, y: str = "mom_pct") -> DataFrame:
    """Per series: y = month-on-month % change, x = its lags 1..``lags``;
    rows with any NULL dropped (NaN / inf stay)."""
    from panelcast.operators.features import lags as add_lags, mom_pct
    names = [f"{y}_lag{k}" for k in range(1, lags + 1)]
    m = add_lags(mom_pct(panel, keys=keys, out=y), y, lags, keys=keys)
    cond = F.col(y).isNotNull()
    for c in names:
        cond = cond & F.col(c).isNotNull()
    return m.filter(cond).select(*keys, "date", F.col(y).alias("y"),
                                 F.array(*[F.col(c) for c in names]).alias("x"),
                                 F.array(*[F.lit(c) for c in names]).alias("features"))


def dot(x, coef) -> F.Column:
    x = F.col(x) if isinstance(x, str) else x
    coef = F.col(coef) if isinstance(coef, str) else coef
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def predict(df: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M6: score rows with their group's coefficients (JVM-side dot product).
    Groups without a fitted model produce no predictions."""
    keys = list(keys)
    f = fits.filter(F.col("status") == "ok").select(*keys, "model", "coef", "intercept")
    return df.join(f, keys).withColumn("prediction", F.col("intercept") + dot("x", "coef"))


def standardise(train: DataFrame, apply_to: DataFrame, keys: Sequence[str], col: str,
                out: str = "z") -> DataFrame:
    """M2: z = (x - mean) / std_pop fitted on ``train``; a zero std scales by 1."""
    keys = list(keys)
    st = train.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    s = F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.col("_s"))
    return apply_to.join(st, keys).withColumn(out, (F.col(col) - F.col("_m")) / s).drop("_m", "_s")


def var_rows(panel: DataFrame, keys: Sequence[str] = ("entity_id",), order: int = 1,
             value: str = "mom_pct") -> DataFrame:
    """VAR(order) design: for each entity and complete date, one row per
    equation (series) with y = that series now and x = every series at lags
    1..order (series in sorted order). Only dates where all series of the
    entity have current and lagged values are kept."""
    keys = list(keys)
    from panelcast.operators.features import mom_pct as add_mom
    w = Window.partitionBy(*keys, "series_id").orderBy("date")
    base = add_mom(panel, keys=keys + ["series_id"], out="mom_pct") if value == "mom_pct" else panel
    lagged = base.select(*keys, "series_id", "date", F.col(value).alias("_y"),
                         *[F.lag(value, k).over(w).alias(f"_l{k}") for k in range(1, order + 1)])
    ok = F.col("_y").isNotNull()
    for k in range(1, order + 1):
        ok = ok & F.col(f"_l{k}").isNotNull()
    lagged = lagged.filter(ok)
    n_series = panel.groupBy(*keys).agg(F.countDistinct("series_id").alias("_k"))
    per_date = (lagged.groupBy(*keys, "date")
                .agg(F.array_sort(F.collect_list(F.struct("series_id", "_y", *[f"_l{k}" for k in range(1, order + 1)])))
                     .alias("_s"), F.count(F.lit(1)).alias("_c"))
                .join(n_series, keys).filter(F.col("_c") == F.col("_k")))
    def lag_of(k):
        return lambda s: s[f"_l{k}"]

    def name_of(k):
        return lambda s: F.concat(s["series_id"], F.lit(f"_lag{k}"))
    xs = F.flatten(F.array(*[F.transform("_s", lag_of(k)) for k in range(1, order + 1)]))
    names = F.flatten(F.array(*[F.transform("_s", name_of(k)) for k in range(1, order + 1)]))
    return per_date.select(*keys, "date", xs.alias("x"), names.alias("features"),
                           F.posexplode(F.transform("_s", lambda s: F.struct(s["series_id"].alias("equation"),
                                                                               s["_y"].alias("y"))))) \
        .select(*keys, "date", "x", "features", F.col("col.equation").alias("equation"), F.col("col.y").alias("y"))


def chow_test(rows: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Chow structural-break F statistic at each group's midpoint, from
    the Gram sums of the two halves and of the pooled sample (k = p + 1)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    h = rows.select("*", F.row_number().over(w).alias("_r"),
                    F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    h = h.withColumn("half", (F.col("_r") > F.col("_n") / 2).cast("int"))
    part = F.struct("n", "mean_y", "mean_x", "xtx", "xty", "yty")
    g = gram(h, keys + ["half"], p).groupBy(*keys).agg(
        F.max(F.when(F.col("half") == 0, part)).alias("_a"), F.max(F.when(F.col("half") == 1, part)).alias("_b"))
    g = g.filter("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, *[
        F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("_a", "_b") for c in ("n", "mean_y", "mean_x", "xtx", "xty", "yty")])
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("n", T.LongType()), T.StructField("chow_f", T.DoubleType())])

    def ssr(a, b, yty):
        return yty - (solve_each(a, b) * b).sum(1)

    def stat(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            half = {}
            for s in ("_a", "_b"):
                half[s] = (pdf[f"{s}_n"].to_numpy(float), pdf[f"{s}_mean_y"].to_numpy(float),
                           _stack(pdf[f"{s}_mean_x"]), _stack(pdf[f"{s}_xtx"]).reshape(-1, p, p),
                           _stack(pdf[f"{s}_xty"]), pdf[f"{s}_yty"].to_numpy(float))
            (n1, y1, x1, a1, b1, c1), (n2, y2, x2, a2, b2, c2) = half["_a"], half["_b"]
            n, share = n1 + n2, n1 * n2 / (n1 + n2)
            dx, dy = x2 - x1, y2 - y1                   # pooled sums from the two halves
            pooled = ssr(a1 + a2 + share[:, None, None] * dx[:, :, None] * dx[:, None, :],
                         b1 + b2 + (share * dy)[:, None] * dx, c1 + c2 + share * dy * dy)
            parts = ssr(a1, b1, c1) + ssr(a2, b2, c2)
            k = p + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                f = np.where((n > 2 * k) & (parts > 0), ((pooled - parts) / k) / (parts / (n - 2 * k)), np.nan)
            out = pdf[keys].copy()
            out["n"], out["chow_f"] = n.astype("int64"), f
            yield out

    r = g.mapInPandas(stat, schema)
    return r.withColumn("chow_f", F.when(~F.isnan("chow_f"), F.col("chow_f")))


TRIM = 0.15


def break_test(rows: DataFrame, keys: Sequence[str], p: int, trim: float = TRIM) -> DataFrame:
    """Structural break at an unknown date. Every date that leaves at least ``trim`` of the rows (and 2k of them, k = p + 1) on
    either side is tried: one window pass carries the running sums of products of (1, x, y), the group's sums less these are the
    suffix, and each row is solved by itself, so all dates cost one pass. Returns (keys, n, break_date, sup_f): the largest Chow F
    and the first row after that break (ties: the earliest); NULL where no date can be tried."""
    keys = list(keys)
    k = p + 1
    # centred by the group's means, so that the running sums stay small
    means = rows.groupBy(*keys).agg(F.avg("y").alias("_my"), *[F.avg(F.col("x")[i]).alias(f"_m{i}") for i in range(p)])
    v = ["1.0", *[f"(x[{i}] - _m{i})" for i in range(p)], "(y - _my)"]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    along = Window.partitionBy(*keys).orderBy("date")
    whole = Window.partitionBy(*keys)
    parts = rows.join(means, keys).select(*keys, "date", F.row_number().over(along).alias("_r"), F.count(F.lit(1)).over(whole).alias("_n"),
                                          F.lead("date").over(along).alias("_next"),
                                          F.array(*[F.expr(f"{v[i]} * {v[j]}") for i, j in pairs]).alias("_q"))
    sums = parts.select(*keys, "_r", "_n", "_next", F.array(*[F.sum(F.col("_q")[i]).over(along) for i in range(len(pairs))]).alias("_a"),
                        F.array(*[F.sum(F.col("_q")[i]).over(whole) for i in range(len(pairs))]).alias("_t"))
    least = F.greatest(F.lit(2 * k), F.ceil(F.col("_n") * F.lit(trim)))
    tried = sums.filter((F.col("_r") >= least) & (F.col("_r") <= F.col("_n") - least))
    schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("_next", rows.schema["date"].dataType), T.StructField("f", T.DoubleType())])

    def rss(q: np.ndarray) -> np.ndarray:
        m = np.zeros((len(q), k + 1, k + 1))
        for at, (i, j) in enumerate(pairs):
            m[:, i, j] = m[:, j, i] = q[:, at]
        b = m[:, :k, k]
        return m[:, k, k] - (solve_each(m[:, :k, :k], b) * b).sum(1)

    def stat(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            a, t = _stack(pdf["_a"]), _stack(pdf["_t"])
            n = pdf["_n"].to_numpy(float)
            pooled, parted = rss(t), rss(a) + rss(t - a)
            out = pdf[[*keys, "_next"]].copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                out["f"] = np.where((n > 2 * k) & (parted > 0), ((pooled - parted) / k) / (parted / (n - 2 * k)), np.nan)
            yield out
    f = tried.mapInPandas(stat, schema).filter(F.col("f").isNotNull() & ~F.isnan("f"))
    best = f.groupBy(*keys).agg(F.max("f").alias("sup_f"), F.max_by("_next", F.struct("f", -F.datediff("_next", F.lit("1970-01-01").cast("date"))))
                                .alias("break_date"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(best, keys, "left").select(*keys, "n", "break_date", "sup_f")
