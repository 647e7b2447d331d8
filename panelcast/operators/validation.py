"""Expanding-window and walk-forward validation of AR models without
copying training rows per fold.

Running (prefix) sums of the regression cross-products are one Window pass
per series; the training Gram of the fold that ends at row e is simply the
prefix at row e - 1. So every row is read once, and the work is
O(rows + folds), not O(rows x folds).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.evaluate import metrics
from panelcast.operators.linear import dot, solve_each
from panelcast.session import materialize


def _prefix_sums(rows: DataFrame, keys: list[str], p: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = [F.col("x")[i] for i in range(p)]
    y = F.col("y")
    # centred by the series' mean first: covariances do not change, cancellation stays small
    every = Window.partitionBy(*keys)
    rows = rows.withColumns({"m_x": F.array(*[F.avg(x[i]).over(every) for i in range(p)]),
                             "m_y": F.avg("y").over(every)})
    x = [F.col("x")[i] - F.col("m_x")[i] for i in range(p)]
    y = F.col("y") - F.col("m_y")
    return rows.select(
        "*", (F.row_number().over(w) - 1).cast("bigint").alias("rn"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"),
        F.count(F.lit(1)).over(run).cast("double").alias("s_n"),
        F.array(*[F.sum(x[i]).over(run) for i in range(p)]).alias("s_x"),
        F.sum(y).over(run).alias("s_y"),
        F.array(*[F.sum(x[i] * x[j]).over(run) for i in range(p) for j in range(p)]).alias("s_xx"),
        F.array(*[F.sum(x[i] * y).over(run) for i in range(p)]).alias("s_xy"))


def fold_fits(rows: DataFrame, keys: Sequence[str], p: int, min_train: int = 60, step: int = 12,
              horizon: int = 12) -> tuple[DataFrame, DataFrame]:
    """Returns (rows with rn / n / test fold, fold coefficients). Fold f trains
    on the first e = min_train + step*f rows and tests on the next
    ``horizon`` rows, for e in ``range(min_train, n - horizon, step)``;
    requires horizon <= step."""
    if horizon > step:
        raise ValueError("horizon must not exceed step (each row tests in at most one fold)")
    keys = list(keys)
    ps = _prefix_sums(materialize(rows), keys, p)        # read for the folds and for the tests
    e = F.col("rn") + 1                           # prefix at rn covers rows 0..rn -> trains fold e
    is_end = (e >= min_train) & ((e - min_train) % step == 0) & (e < F.col("n") - horizon)  # fold rule
    fold = ((e - min_train) / step).cast("bigint")
    folds = ps.filter(is_end).select(*keys, fold.alias("fold"), "s_n", "s_x", "s_y", "s_xx", "s_xy", "m_x", "m_y")
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("fold", T.LongType()), T.StructField("n_train", T.LongType()),
        T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            n = pdf["s_n"].to_numpy(float)
            sx = np.stack(pdf["s_x"].map(np.asarray).to_numpy()).astype(float)
            sy = pdf["s_y"].to_numpy(float)
            sxx = np.stack(pdf["s_xx"].map(np.asarray).to_numpy()).astype(float).reshape(-1, p, p)
            sxy = np.stack(pdf["s_xy"].map(np.asarray).to_numpy()).astype(float)
            c = sxx - np.einsum("ni,nj->nij", sx, sx) / n[:, None, None]
            b = sxy - sx * (sy / n)[:, None]
            coef = solve_each(c, b)
            out = pdf[keys + ["fold"]].copy()
            out["n_train"] = n.astype("int64")
            out["coef"] = list(coef)
            mx = np.stack(pdf["m_x"].map(np.asarray).to_numpy()).astype(float)
            out["intercept"] = sy / n + pdf["m_y"].to_numpy(float) - ((sx / n[:, None] + mx) * coef).sum(1)
            yield out

    fits = folds.mapInPandas(solve, schema)
    k = (F.col("rn") - min_train)
    test_fold = F.when((F.col("rn") >= min_train) & (k % step < horizon), F.floor(k / step).cast("bigint"))
    tagged = ps.select(*keys, "date", "y", "x", "rn", "n", test_fold.alias("fold"))
    return tagged, fits


def cv_predictions(rows: DataFrame, keys: Sequence[str], p: int, min_train: int = 60,
                   step: int = 12, horizon: int = 12) -> DataFrame:
    """R13 / V2 wired to AR: out-of-fold predictions for every test row."""
    keys = list(keys)
    tagged, fits = fold_fits(rows, keys, p, min_train, step, horizon)
    return (tagged.filter(F.col("fold").isNotNull()).join(fits, keys + ["fold"])
            .withColumn("prediction", F.col("intercept") + dot("x", "coef")))


def cv_metrics(rows: DataFrame, keys: Sequence[str], p: int, min_train: int = 60,
               step: int = 12, horizon: int = 12) -> DataFrame:
    keys = list(keys)
    return metrics(cv_predictions(rows, keys, p, min_train, step, horizon), keys + ["fold"])


def holdout(df: DataFrame, keys: Sequence[str], last: int = 24) -> DataFrame:
    """The last ``last`` rows of each series are the holdout."""
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return df.withColumn("split", F.when(F.row_number().over(w) <= last, F.lit("holdout"))
                         .otherwise(F.lit("train")))


def ridge_fold_fits(rows: DataFrame, keys: Sequence[str], p: int, alpha: float = 1.0,
                    min_train: int = 60, step: int = 12, horizon: int = 12) -> tuple[DataFrame, DataFrame]:
    """Expanding-window folds for standardised ridge (M3), without copying
    training rows per fold: rows are tagged with their ``step``-row block,
    each (group, block) is reduced to centred co-moments (``gram``),
    and the block Grams are merged cumulatively per group (at most n / step
    small rows), giving every fold's training Gram. Returns (tagged rows,
    fold coefficients in original units)."""
    from panelcast.operators.linear import gram
    if horizon > step:
        raise ValueError("horizon must not exceed step")
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    rows = materialize(rows)
    tagged = rows.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("rn"),
                         F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    k = F.col("rn") - min_train
    tagged = tagged.withColumn("block", F.when(F.col("rn") < min_train, F.lit(-1))
                               .otherwise(F.floor(k / step)).cast("bigint"))
    blocks = gram(tagged.select(*keys, "block", "y", "x", "features"), keys + ["block"], p)
    n_rows = tagged.groupBy(*keys).agg(F.first("n").alias("n_rows"))
    schema = T.StructType([rows.schema[c] for c in keys] + [
        T.StructField("fold", T.LongType()), T.StructField("n_train", T.LongType()),
        T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType())])

    def prefix(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        n_total = int(g["n_rows"].iloc[0])
        out = []
        n, mx, my, cxx, cxy = 0.0, np.zeros(p), 0.0, np.zeros((p, p)), np.zeros(p)
        for r in g.itertuples(index=False):
            b = int(r.block)
            if b >= 0:                                   # fold b trains on everything before block b
                e = min_train + step * b
                if e < n_total - horizon and n > 0:
                    scale = np.sqrt(np.clip(np.diag(cxx) / n, 0.0, None))
                    scale[scale == 0.0] = 1.0
                    a = cxx / np.outer(scale, scale) + alpha * np.eye(p)
                    coef = solve_each(a[None], (cxy / scale)[None])[0] / scale
                    rec = {c: getattr(r, c) for c in keys}
                    rec.update(fold=b, n_train=int(n), coef=coef.tolist(), intercept=float(my - mx @ coef))
                    out.append(rec)
            nb, mb, yb = float(r.n), np.asarray(r.mean_x, float), float(r.mean_y)
            tot = n + nb
            dx, dy = mb - mx, yb - my
            cxx = cxx + np.asarray(r.xtx, float).reshape(p, p) + np.outer(dx, dx) * n * nb / tot
            cxy = cxy + np.asarray(r.xty, float) + dx * dy * n * nb / tot
            mx, my, n = mx + dx * nb / tot, my + dy * nb / tot, tot
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    fits = blocks.join(n_rows, keys).groupBy(*keys).applyInPandas(prefix, schema)
    test = tagged.filter((F.col("block") >= 0) & (k % step < horizon)).withColumnRenamed("block", "fold")
    return test, fits


def ridge_cv_metrics(rows: DataFrame, keys: Sequence[str], p: int, alpha: float = 1.0,
                     min_train: int = 60, step: int = 12, horizon: int = 12) -> DataFrame:
    """Out-of-fold ridge metrics per (group, fold)."""
    keys = list(keys)
    test, fits = ridge_fold_fits(rows, keys, p, alpha, min_train, step, horizon)
    pred = test.join(fits, keys + ["fold"]).withColumn("prediction", F.col("intercept") + dot("x", "coef"))
    return metrics(pred, keys + ["fold"])
