"""Relating a target to many predictors: joins, complete cases, correlation
ranking and lead-lag correlation.

Everything is computed in long form ``(entity_id, variable, date, x)`` so the
number of predictors never changes the plan: correlation is one partial +
final aggregate per (entity, variable), never one job per column. The wide
form (one column per variable) is built only at the model edge.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.ieee import pearson
from panelcast.operators.features import predictor_features
from panelcast.session import materialize

# Predictor feature suffixes, in their column order.
FEATURE_SUFFIXES = ("level", "mom_pct", "ma3", "vol3")


def series_key(series: str | Column) -> Column:
    """Column-name-safe key of a series id: lower case, non-alphanumerics -> '_'."""
    c = F.col(series) if isinstance(series, str) else series
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")


def role_split(panel: DataFrame, target_series: str) -> tuple[DataFrame, DataFrame]:
    """(target rows, predictor rows) of a panel by target series id."""
    is_target = F.col("series_id") == F.lit(target_series)
    return panel.filter(is_target), panel.filter(~is_target)


def predictors_long(pred_features: DataFrame, *carry: str) -> DataFrame:
    """Unpivot level / mom_pct / ma3 / vol3 into rows:
    (entity_id, series_id, date, feature_idx, variable, x). A variable is
    identified by (series_id, feature_idx); ``variable`` is its shown name."""
    key = series_key("series_id")
    pairs = F.array(*[F.struct(F.lit(i).alias("feature_idx"), F.col(s).cast("double").alias("x"))
                      for i, s in enumerate(FEATURE_SUFFIXES)])
    names = F.array(*[F.lit(s) for s in FEATURE_SUFFIXES])
    return (pred_features
            .select("entity_id", "series_id", "date", *carry, F.inline(pairs))
            .withColumn("variable", F.concat_ws("_", key, F.element_at(names, F.col("feature_idx") + 1))))


def complete_dates(pred_features: DataFrame, target_y: DataFrame) -> DataFrame:
    """(entity_id, date, y) where the target change is non-null and every
    predictor series of the entity has a row with all four features non-null
    (the inner join of the target with the full outer join of all predictors,
    then drop-nulls). NaN and inf are values, not nulls, and are kept."""
    n_pred = pred_features.groupBy("entity_id").agg(
        F.countDistinct("series_id").alias("n_pred"))
    full = F.lit(True)
    for s in FEATURE_SUFFIXES:
        full = full & F.col(s).isNotNull()
    ok = (pred_features.filter(full)
          .groupBy("entity_id", "date").agg(F.count(F.lit(1)).alias("n_ok")))
    return (ok.join(n_pred, "entity_id")
              .filter(F.col("n_ok") == F.col("n_pred"))
              .join(target_y.filter(F.col("mom_pct").isNotNull()), ["entity_id", "date"])
              .select("entity_id", "date", F.col("mom_pct").alias("y")))


def analysis_series(panel: DataFrame, target_series: str) -> DataFrame:
    """Complete-case analysis frame, one row per (entity, series, date):
    (entity_id, series_id, date, y, level, mom_pct, ma3, vol3), y being the
    target's change. Nothing is unpivoted yet.

    The per-series feature frame feeds three branches (target, complete dates,
    predictors); it is written once, so the landed tables are read once."""
    # one Window stage for every series; the target's change uses the same
    # formula, so target and predictors are split after it (one scan, one sort)
    feats = materialize(predictor_features(panel))
    is_target = F.col("series_id") == F.lit(target_series)
    ty = feats.filter(is_target).select("entity_id", "date", "mom_pct")
    pf = feats.filter(~is_target)
    return pf.join(complete_dates(pf, ty), ["entity_id", "date"]).select(
        "entity_id", "series_id", "date", "y", *FEATURE_SUFFIXES)


def analysis_frame(panel: DataFrame, target_series: str) -> DataFrame:
    """The complete-case analysis frame in long form:
    (entity_id, date, mom_pct, series_id, feature_idx, variable, x)."""
    long = predictors_long(analysis_series(panel, target_series), "y")
    return long.withColumnRenamed("y", "mom_pct")


def correlations(analysis: DataFrame, y: str = "y") -> DataFrame:
    """Pearson correlation of the target with every variable (null pairs
    skipped; NULL / NaN results dropped): four aggregates per series, the
    results unpivoted."""
    r = analysis.groupBy("entity_id", "series_id").agg(
        *[pearson(y, s).alias(s) for s in FEATURE_SUFFIXES])
    r = r.withColumn("date", F.lit(None).cast("date"))
    return (predictors_long(r).drop("date").withColumnRenamed("x", "correlation")
            .filter(F.col("correlation").isNotNull() & ~F.isnan("correlation")))


def rank_correlations(corr: DataFrame, top_k: int | None = None) -> DataFrame:
    """Rank by |correlation| descending; ties keep column order
    (series id, then feature order). ``top_k`` keeps the first k per entity."""
    w = Window.partitionBy("entity_id").orderBy(
        F.abs("correlation").desc(), "series_id", "feature_idx")
    ranked = corr.withColumn("rank", F.row_number().over(w).cast("bigint"))
    if top_k is not None:
        ranked = ranked.filter(F.col("rank") <= top_k)
    return ranked


def corr_rank(panel: DataFrame, target_series: str, top_k: int | None = None) -> DataFrame:
    """Flagship: (entity_id, rank, variable, correlation)."""
    ranked = rank_correlations(correlations(analysis_series(panel, target_series)), top_k)
    return ranked.select("entity_id", "rank", "variable", "correlation")


def lead_lag(analysis: DataFrame, max_lag: int = 6, y: str = "y") -> DataFrame:
    """For lag in -L..L, lag > 0 pairs y_t with x_{t-lag}, lag < 0 pairs
    y_{t-|lag|} with x_t. Shifts are row positions of the complete-case frame,
    per (entity, series, feature). One aggregate per shift, the results
    unpivoted. Input: long rows (entity_id, series_id, feature_idx, variable,
    date, y, x); output (entity_id, series_id, feature_idx, variable, lag,
    correlation)."""
    of = ["entity_id", "series_id", "feature_idx"]
    w = Window.partitionBy(*of).orderBy("date")
    shifted = analysis.select(
        *of, "variable", F.col(y).alias("_y"), "x",
        *[F.lag("x", k).over(w).alias(f"_x{k}") for k in range(1, max_lag + 1)],
        *[F.lag(y, k).over(w).alias(f"_y{k}") for k in range(1, max_lag + 1)])
    pairs = {0: ("_y", "x")}
    for k in range(1, max_lag + 1):
        pairs[k], pairs[-k] = ("_y", f"_x{k}"), (f"_y{k}", "x")
    r = shifted.groupBy(*of, "variable").agg(
        *[pearson(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs.values())])
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"_r{i}").alias("correlation"))
                     for i, k in enumerate(pairs)])
    return (r.select(*of, "variable", F.inline(rows))
            .filter(F.col("correlation").isNotNull() & ~F.isnan("correlation")))


def lead_lag_all(analysis: DataFrame, max_lag: int) -> DataFrame:
    """W11 for wide ranges: as :func:`lead_lag`, for every series and feature of the analysis frame
    (:func:`analysis_series`) and all lags -max_lag..max_lag at once. Products at all shifts come from one Fourier transform of each
    series, the other sums of the overlapping rows from running sums: n log n for any number of
    lags. A group is one series of one entity, bounded by the calendar; a feature with non-finite
    values is correlated shift by shift."""
    keys = ["entity_id", "series_id"]
    schema = T.StructType([*[analysis.schema[k] for k in keys], T.StructField("feature_idx", T.LongType()),
                           T.StructField("variable", T.StringType()), T.StructField("lag", T.LongType()),
                           T.StructField("correlation", T.DoubleType())])

    def series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["y"].to_numpy(float)
        name = pdf["_key"].iloc[0]
        top = min(max_lag, len(y) - 2)
        lags = np.arange(-top, top + 1) if top >= 0 else np.arange(0)
        out = []
        for i, feature in enumerate(FEATURE_SUFFIXES):
            r = correlations_at(y, pdf[feature].to_numpy(float), lags)
            keep = np.isfinite(r)
            out.append(pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "feature_idx": i, "variable": f"{name}_{feature}",
                                     "lag": lags[keep], "correlation": r[keep]}))
        return pd.concat(out)[[f.name for f in schema.fields]]
    return (analysis.withColumn("_key", series_key("series_id")).groupBy(*keys).applyInPandas(series, schema))


def correlations_at(y: np.ndarray, x: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Pearson correlation of y[t] with x[t - lag] (lag > 0) or y[t - |lag|] with x[t], over the rows that
    overlap; NaN where a side is constant or holds a non-finite value."""
    n, out = len(y), np.full(len(lags), np.nan)
    if not len(lags):
        return out
    if not (np.isfinite(y).all() and np.isfinite(x).all()):
        for i, k in enumerate(lags):
            a, b = (y[k:], x[:n - k]) if k >= 0 else (y[:n + k], x[-k:])
            if np.isfinite(a).all() and np.isfinite(b).all():
                out[i] = correlations_at(a, b, np.zeros(1, int))[0]
        return out
    sy, sx = y.std() or 1.0, x.std() or 1.0
    y, x = (y - y.mean()) / sy, (x - x.mean()) / sx                 # sums stay near n
    size = 1 << (2 * n - 1).bit_length()
    both = np.fft.irfft(np.fft.rfft(y, size) * np.conj(np.fft.rfft(x, size)), size)      # at k: sum of y[t] x[t - k]
    run = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    cy, cx, cyy, cxx = run(y), run(x), run(y * y), run(x * x)
    shift = np.abs(lags)
    m = n - shift
    lead = lags >= 0
    part = lambda c, late: np.where(late, c[n] - c[shift], c[m])
    a, aa, b, bb = part(cy, lead), part(cyy, lead), part(cx, ~lead), part(cxx, ~lead)
    va, vb = aa - a * a / m, bb - b * b / m
    ok = (va > 1e-12 * n) & (vb > 1e-12 * n)
    out[ok] = ((both[lags] - a * b / m)[ok]) / np.sqrt(va[ok] * vb[ok])
    return out


def lead_lag_top(panel: DataFrame, target_series: str, top_k: int = 5,
                 max_lag: int = 6) -> DataFrame:
    """Lead-lag correlations for the top-k ranked variables of each entity;
    only the rows of their series are unpivoted."""
    analysis = materialize(analysis_series(panel, target_series))
    top = rank_correlations(correlations(analysis), top_k).select("entity_id", "series_id", "feature_idx")
    rows = analysis.join(top.select("entity_id", "series_id"), ["entity_id", "series_id"], "left_semi")
    return lead_lag(predictors_long(rows, "y").join(top, ["entity_id", "series_id", "feature_idx"], "left_semi"),
                    max_lag)


def full_join_pair(a: DataFrame, b: DataFrame, on: Sequence[str] = ("entity_id", "date")) -> DataFrame:
    """J1 (2-way): full outer equi-join; USING-style keys are coalesced."""
    return a.join(b, list(on), "full")


def wide(long: DataFrame, variables: Sequence[str] | None = None,
         keys: Sequence[str] = ("entity_id", "date")) -> DataFrame:
    """J1 (K-way): one pivot instead of K chained full joins; equal to the
    chained joins because (entity, variable, date) is unique, which is checked:
    two series whose names make one column name are an error. The columns are
    the variables of the data in column order unless they are listed."""
    if variables is None:
        variables = [r["variable"] for r in
                     long.select("series_id", "feature_idx", "variable").distinct()
                     .orderBy("series_id", "feature_idx").collect()]       # they become the columns
        if len(set(variables)) < len(variables):
            raise ValueError("two series share a column name")
    one = F.when(F.count_distinct("series_id") > 1, F.raise_error(F.lit("two series share a column name"))
                 .cast("double")).otherwise(F.max("x"))
    return long.groupBy(*keys).pivot("variable", list(variables)).agg(one)


def predictors_wide(panel: DataFrame, target_series: str,
                    variables: Sequence[str] | None = None) -> DataFrame:
    """Predictor features of all non-target series, one column per variable,
    over the union of their dates (nulls where a series is absent)."""
    _, preds = role_split(panel, target_series)
    return wide(predictors_long(predictor_features(preds)), variables)


def target_join(panel: DataFrame, target_series: str,
                variables: Sequence[str] | None = None) -> DataFrame:
    """Target mom_pct inner-joined with the wide predictor frame on date.
    Both sides come from one feature stage, written once."""
    target, preds = role_split(materialize(predictor_features(panel)), target_series)
    ty = target.select("entity_id", "date", "mom_pct")
    return ty.join(wide(predictors_long(preds), variables), ["entity_id", "date"])


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """PF4: drop a row when any column is NULL; NaN is a value and is kept
    (``na.drop`` would also drop NaN)."""
    cols = list(cols or df.columns)
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"`{c}`").isNotNull()
    return df.filter(cond)
