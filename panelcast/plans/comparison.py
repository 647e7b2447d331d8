"""Model comparison (M8-M10): features -> chronological split -> AR(3),
ridge and forest fitted on train -> scored on train, validation and test.

Every model is fitted for each entity of its own; every feature and predictor is used
unless a cap is asked for. Nothing but table sizes reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators import evaluate as EV, linear as LN, matrix as MX
from panelcast.operators import relate as RL, split as SP, trees as TR
from panelcast.session import materialize

MAX_LAGS = 3
# The optional caps that the reference runs with (ridge, forest features).
RIDGE_FEATURES = 20
FOREST_FEATURES = 15
AR_FEATURES = ("mom_pct_lag1", "mom_pct_lag2", "mom_pct_lag3")
KEYS = ["entity_id"]
SPLITS = ("train", "validation", "test")
NO_ROWS = "No complete rows"


@dataclass
class Comparison:
    metrics: DataFrame            # entity, model, split, rmse, mae, dir. acc., n
    fits: DataFrame               # entity, model, status, n_train, n_features: one row for each pair
    importance: DataFrame | None  # forest importances: entity, feature, importance, rank


def split_matrix(panel: DataFrame, target: str, n_predictors: int | None = None,
                 max_lags: int = MAX_LAGS) -> DataFrame:
    """Long feature matrix with the 70 / 15 / 15 split of each entity's dates,
    written once."""
    fm = materialize(MX.feature_matrix(RL.analysis_series(panel, target), n_predictors, max_lags))
    dates = fm.select(*KEYS, "date").distinct()
    split = SP.assign_split(SP.positions(dates, KEYS, "date")).drop("rn", "n")
    return materialize(fm.join(split, [*KEYS, "date"]))


def vectors(fm: DataFrame, n_features: int | None = None,
            names: tuple[str, ...] | None = None) -> DataFrame:
    """One row per (entity, date) with its features in order: all, the first
    ``n_features``, or those of ``names`` that exist."""
    f = fm
    if names is not None:
        f = f.filter(F.col("feature").isin(list(names)))
    if n_features is not None:
        f = f.filter(F.col("ordinal") < n_features)
    g = (f.groupBy("entity_id", "date", "mom_pct", "split")
          .agg(F.array_sort(F.collect_list(F.struct("ordinal", "feature", "value"))).alias("_f")))
    return g.select("entity_id", "date", "split", F.col("mom_pct").alias("y"),
                    F.transform("_f", lambda s: s["feature"]).alias("features"),
                    F.transform("_f", lambda s: s["value"]).alias("x"))


def compare(panel: DataFrame, target: str, with_forest: bool = True, n_trees: int = TR.N_TREES,
            n_predictors: int | None = None, ridge_features: int | None = None,
            forest_features: int | None = None) -> Comparison:
    """Fits and scores the models; every entity of the panel gets a row in
    ``fits`` for each of them."""
    panel = materialize(panel)
    fm = split_matrix(panel, target, n_predictors)
    scored, fits = [], []
    for model, vec in (("ar", vectors(fm, names=AR_FEATURES)), ("ridge", vectors(fm, ridge_features))):
        vec = materialize(vec)
        train = vec.filter(F.col("split") == "train")
        fit = materialize(LN.fit_ar(train, KEYS, None) if model == "ar" else LN.fit_ridge(train, KEYS))
        fits.append(fit.select("entity_id", "model", "status", "n_train",
                               F.size("features").cast("bigint").alias("n_features")))
        scored.append(LN.predict(vec, fit, KEYS).select("entity_id", "split", "y", "prediction", "model"))
    imp = None
    if with_forest:
        vec = materialize(vectors(fm, forest_features))
        train = vec.filter(F.col("split") == "train")
        nodes, fit = TR.fit_forest(train, n_trees)
        fits.append(fit.select("entity_id", F.lit("forest").alias("model"), "status", "n_train", "n_features"))
        scored.append(vec.join(TR.predict(nodes, vec, ["entity_id", "date"]), ["entity_id", "date"])
                      .select("entity_id", "split", "y", "prediction", F.lit("forest").alias("model")))
        imp = materialize(TR.importances(nodes, train.groupBy("entity_id").agg(F.first("features").alias("features"))))
    allp, all_fits = scored[0], fits[0]
    for s in scored[1:]:
        allp = allp.unionByName(s)
    for f in fits[1:]:
        all_fits = all_fits.unionByName(f)
    models = F.explode(F.array(*[F.lit(m) for m in ("ar", "ridge", *(["forest"] if with_forest else []))]))
    pairs = panel.select("entity_id").distinct().select("entity_id", models.alias("model"))
    whole = pairs.join(all_fits, ["entity_id", "model"], "left").withColumn(
        "status", F.coalesce("status", F.lit(NO_ROWS))).withColumn("n_train", F.coalesce("n_train", F.lit(0)))
    return Comparison(materialize(EV.metrics(allp, ["entity_id", "model", "split"])), materialize(whole), imp)


def model_table(cmp: Comparison) -> DataFrame:
    """One row per entity and model: status, training rows,
    feature count, metrics of each split in columns of their own, the best
    model (minimum test RMSE) and the skill flag (test dir. acc. > 0.5)."""
    names = ("rmse", "mae", "directional_accuracy", "n_predictions")
    m = cmp.metrics.groupBy("entity_id", "model").agg(*[
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in SPLITS for c in names])
    w = Window.partitionBy("entity_id").orderBy(F.col("test_rmse").asc_nulls_last(), "model")
    return (cmp.fits.join(m, ["entity_id", "model"], "left")
            .withColumn("best", (F.row_number().over(w) == 1) & F.col("test_rmse").isNotNull())
            .withColumn("skill", F.when(F.col("test_directional_accuracy") > 0.5, F.lit("has predictive power"))
                        .when(F.col("test_rmse").isNotNull(), F.lit("no directional skill"))))


def best_model(cmp: Comparison) -> DataFrame:
    """T4: the minimum test RMSE model per entity; NULL where none was scored."""
    t = model_table(cmp)
    return t.groupBy("entity_id").agg(F.max(F.when(F.col("best"), F.col("model"))).alias("best_model"),
                                      F.max(F.when(F.col("best"), F.col("test_rmse"))).alias("rmse"))


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(entity, model, split, metric, value) chart table via ``stack``."""
    return metrics.select("entity_id", "model", "split", F.expr(
        "stack(3, 'rmse', rmse, 'mae', mae, 'directional_accuracy', directional_accuracy)"
        " AS (metric, value)"))
