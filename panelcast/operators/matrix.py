"""Lag / rolling / momentum feature matrix over the complete-case frame.

Long form ``(entity_id, date, mom_pct, feature, ordinal, value)``. ``ordinal``
is the position the feature would have as a column of the wide matrix:
the predictor variables (all, or the first ``n_predictors`` on request), then
their lags, then the target lags, then ma3 / vol3 / ma6 per predictor, then
mom3 / mom6 per predictor. ``lags_only`` keeps only lagged features (a forecast
rather than a nowcast: no same-month predictor values).

All features of a series are columns of one window stage; incomplete dates are
dropped there, and the unpivot comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.ieee import ratio_minus_one
from panelcast.functions.windows import strict_mean, strict_std
from panelcast.operators.relate import FEATURE_SUFFIXES, series_key
from panelcast.session import materialize


def _feat(name: Column, ordinal: Column, value: Column) -> Column:
    return F.struct(name.alias("feature"), ordinal.cast("bigint").alias("ordinal"),
                    value.cast("double").alias("value"))


def feature_matrix(analysis: DataFrame, n_predictors: int | None = None, max_lags: int = 3,
                   target_lags: int = 3, lags_only: bool = False) -> DataFrame:
    """``analysis``: rows of :func:`relate.analysis_series`."""
    analysis = materialize(analysis)
    per = Window.partitionBy("entity_id")
    k = len(FEATURE_SUFFIXES)
    series = analysis.select("entity_id", "series_id").distinct().select(
        "entity_id", "series_id", (F.row_number().over(per.orderBy("series_id")) - 1).alias("_s"),
        (F.count(F.lit(1)).over(per) * k).alias("_all"))
    P = F.col("_all") if n_predictors is None else F.least(F.col("_all"), F.lit(n_predictors))
    w = Window.partitionBy("entity_id", "series_id").orderBy("date")
    L = max_lags
    columns, feats = [], []
    for at, suffix in enumerate(FEATURE_SUFFIXES):
        x, i = F.col(suffix), f"(_s * {k} + {at})"
        own = {"": x} | {f"_lag{j}": F.lag(x, j).over(w) for j in range(1, L + 1)} | {
            "_ma3": strict_mean(x, w, 3), "_vol3": strict_std(x, w, 3), "_ma6": strict_mean(x, w, 6),
            "_mom3": x - F.lag(x, 3).over(w), "_mom6": ratio_minus_one(x, F.lag(x, 6).over(w))}
        roll = f"P + P * {L} + {target_lags}"
        order = {"": i} | {f"_lag{j}": f"P + {i} * {L} + {j - 1}" for j in range(1, L + 1)} | {
            "_ma3": f"{roll} + {i} * 3", "_vol3": f"{roll} + {i} * 3 + 1", "_ma6": f"{roll} + {i} * 3 + 2",
            "_mom3": f"{roll} + 3 * P + {i} * 2", "_mom6": f"{roll} + 3 * P + {i} * 2 + 1"}
        for end, value in own.items():
            if lags_only and not end.startswith("_lag"):
                continue                       # forecast setting: no same-period predictor values
            columns.append(value.alias(f"_{at}{end}"))
            feats.append(f"CASE WHEN {i} < P THEN named_struct('feature', concat(_key, '_{suffix}{end}'), 'ordinal',"
                         f" CAST({order[end]} AS BIGINT), 'value', CAST(_{at}{end} AS DOUBLE)) END")
    # window columns first (a generator cannot hold window functions)
    rows = analysis.join(series, ["entity_id", "series_id"]).select(
        "entity_id", "date", "_s", series_key("series_id").alias("_key"), P.cast("bigint").alias("P"), *columns)
    rows = rows.select("entity_id", "date", "P", F.expr(f"filter(array({', '.join(feats)}), f -> f IS NOT NULL) AS _f"))
    rows = materialize(rows)
    wt = Window.partitionBy("entity_id").orderBy("date")
    tlag = analysis.select("entity_id", "date", "y").distinct().select(
        "entity_id", "date", "y", *[F.lag("y", j).over(wt).alias(f"_t{j}") for j in range(1, target_lags + 1)])
    # drop a date when any of its features is NULL (NaN / inf stay)
    known = F.lit(True)
    for j in range(1, target_lags + 1):
        known = known & F.col(f"_t{j}").isNotNull()
    whole = rows.groupBy("entity_id", "date").agg(
        F.min(F.forall("_f", lambda f: f["value"].isNotNull())).alias("_whole"), F.max("P").alias("P"))
    dates = tlag.filter(known).join(whole.filter("_whole"), ["entity_id", "date"])
    tl = [_feat(F.lit(f"mom_pct_lag{j}"), F.col("P") + F.col("P") * L + (j - 1), F.col(f"_t{j}"))
          for j in range(1, target_lags + 1)]
    out = (rows.drop("P").join(dates.select("entity_id", "date", "y"), ["entity_id", "date"])
           .unionByName(dates.select("entity_id", "date", F.array(*tl).alias("_f"), "y")))
    return out.select("entity_id", "date", F.col("y").alias("mom_pct"), F.inline("_f"))
