"""Random forest through ``pyspark.ml`` (distributed tree induction).

One forest is fitted over the pooled rows of all groups (Spark ML fits one
model per DataFrame); per-row vectors come from the ``x`` array column.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Forest settings of the reference (100 trees, seed 42, every feature at each split).
N_TREES = 100
SEED = 42
# Our bound on a tree: at most 2^MAX_DEPTH leaves, so the model held by the driver does not grow with the rows.
MAX_DEPTH = 10


def fit_forest(train: DataFrame, n_trees: int = N_TREES, seed: int = SEED,
               max_depth: int = MAX_DEPTH):
    """M4: returns the fitted ``RandomForestRegressionModel``."""
    rf = RandomForestRegressor(featuresCol="fv", labelCol="y", numTrees=n_trees, seed=seed,
                               featureSubsetStrategy="all", maxDepth=max_depth,
                               minInstancesPerNode=1, subsamplingRate=1.0, bootstrap=True)
    return rf.fit(train.withColumn("fv", array_to_vector("x")))


def predict_forest(model, df: DataFrame) -> DataFrame:
    return (model.transform(df.withColumn("fv", array_to_vector("x")))
            .drop("fv").withColumn("model", F.lit("forest")))


def importances(model, features: list[str], spark) -> DataFrame:
    """M5: (feature, importance, rank) of the fitted forest (normalised to 1).
    The vector has one entry per feature (at most the feature cap), so it is
    ranked here, by importance descending then name."""
    imp = [float(v) for v in model.featureImportances.toArray().tolist()]
    ranked = sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ranked)],
                                 "feature string, importance double, rank bigint")


def top_importance(imp: DataFrame, k: int = 10) -> DataFrame:
    """T5: top-k features by importance (ties by name)."""
    return imp.filter(F.col("rank") <= k)


def fit_pooled(train: DataFrame, kind: str, seed: int = SEED, reg: float = 1.0, max_iter: int = 100,
               rounds: int = 30):
    """R10 lasso (``elasticNetParam=1``) and R11 gradient-boosted trees over the
    pooled rows; both distributed ``pyspark.ml`` estimators."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    df = train.withColumn("fv", array_to_vector("x"))
    if kind == "lasso":
        est = LinearRegression(featuresCol="fv", labelCol="y", elasticNetParam=1.0, regParam=reg,
                               standardization=True, maxIter=max_iter)
    elif kind == "gbt":
        est = GBTRegressor(featuresCol="fv", labelCol="y", seed=seed, maxIter=rounds, maxDepth=3)
    else:
        raise ValueError(kind)
    return est.fit(df)


def predict_pooled(model, df: DataFrame, name: str) -> DataFrame:
    return (model.transform(df.withColumn("fv", array_to_vector("x")))
            .drop("fv").withColumn("model", F.lit(name)))
