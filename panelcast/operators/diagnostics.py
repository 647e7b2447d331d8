"""Diagnostics: correlation matrix, outlier treatment, decomposition,
residual autocorrelation, structural-break statistic, cross-publisher check."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.ieee import pearson
from panelcast.functions.windows import SERIES_KEYS, series_window
from panelcast.operators.quantiles import exact_quantiles
from panelcast.session import materialize


BLOCK = 256       # series in a block of the correlation matrix


def correlation_matrix(panel: DataFrame, keys: Sequence[str] = ("entity_id",), block: int = BLOCK) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair of series
    (a < b) of an entity that share at least one date.

    An entity's series are dealt into blocks of about ``block``; each pair of
    blocks is one task group of at most two blocks' series by the calendar, in
    which masked matrix products give all pairs at once. No pair rows are made
    per date, and the number of series has no bound. Values are centred by
    each series' mean first (numerically stable)."""
    keys = list(keys)
    panel = materialize(panel)               # read for the block counts and for the values
    blocks = (panel.select(*keys, "series_id").distinct().groupBy(*keys)
              .agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("_nb")))
    per_series = Window.partitionBy(*keys, "series_id")      # one row per period
    centred = panel.select(*keys, "date", "series_id",
                           (F.col("value") - F.avg("value").over(per_series)).alias("v"))
    own = F.pmod(F.xxhash64("series_id"), F.col("_nb")).cast("int")
    dealt = (centred.join(blocks, keys).withColumn("_b", own)
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
             .withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
             .select(*keys, "_i", "_j", "_b", "date", "series_id", "v"))
    schema = T.StructType([panel.schema[c] for c in keys] + [
        T.StructField("a", T.StringType()), T.StructField("b", T.StringType()),
        T.StructField("n", T.LongType()), T.StructField("correlation", T.DoubleType())])

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        i, j = g["_i"].iloc[0], g["_j"].iloc[0]
        block_of = g.drop_duplicates("series_id").set_index("series_id")["_b"]
        w = g.pivot(index="date", columns="series_id", values="v").sort_index(axis=1)
        names = np.asarray(w.columns, dtype=object)
        x = w.to_numpy(dtype=float)
        m = ~np.isnan(x)
        x0, mf = np.where(m, x, 0.0), m.astype(float)
        n = mf.T @ mf
        sx, sxx, sxy = x0.T @ mf, (x0 * x0).T @ mf, x0.T @ x0    # sums over the rows where both are present
        at, bt = np.triu_indices(len(names), 1)
        nb = block_of.loc[names].to_numpy()
        keep = (n[at, bt] > 0) & ((i == j) | (nb[at] != nb[bt]))
        at, bt = at[keep], bt[keep]
        k = n[at, bt]
        cov = sxy[at, bt] - sx[at, bt] * sx[bt, at] / k
        den = (sxx[at, bt] - sx[at, bt] ** 2 / k) * (sxx[bt, at] - sx[bt, at] ** 2 / k)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where((k > 1) & (den > 0), cov / np.sqrt(den), np.nan)
        out = pd.DataFrame({"a": names[at], "b": names[bt], "n": k.astype("int64"), "correlation": r})
        for at_key, c in enumerate(keys):
            out.insert(at_key, c, g[c].iloc[0])
        return out

    out = dealt.groupBy(*keys, "_i", "_j").applyInPandas(pairs, schema)
    return out.withColumn("correlation", F.when(~F.isnan("correlation"), F.col("correlation")))


def winsorize(panel: DataFrame, lower: float = 0.05, upper: float = 0.95,
              keys: Sequence[str] = SERIES_KEYS, value: str = "value") -> DataFrame:
    """Clip each series to its own exact [lower, upper] quantiles. NULL
    stays NULL and NaN stays NaN (not outliers); a series without a value
    keeps its rows with NULL bounds."""
    keys = list(keys)
    panel = materialize(panel)               # read for the quantiles and for the clipping
    q = exact_quantiles(panel, keys, value, (lower, upper))
    lo, hi = f"q{int(round(lower * 100))}", f"q{int(round(upper * 100))}"
    v = F.col(value)
    known = v.isNotNull() & ~F.isnan(v)
    return (panel.join(q, keys, "left")
            .withColumn("clipped", F.when(known, F.least(F.greatest(v, F.col(lo)), F.col(hi))).otherwise(v))
            .withColumn("is_outlier", F.when(known, (v < F.col(lo)) | (v > F.col(hi)))
                        .when(v.isNotNull(), F.lit(False)))
            .withColumnRenamed(lo, "lower").withColumnRenamed(hi, "upper"))


def decompose(panel: DataFrame, period: int = 12, keys: Sequence[str] = SERIES_KEYS,
              value: str = "value", scale: int = 2) -> DataFrame:
    """Classical additive decomposition of monthly series. Trend =
    centred moving average (2 x 12 MA), seasonal = mean detrended value per
    month of year centred to mean zero, residual = value - trend - seasonal.

    Reproducible under any partitioning: sums are accumulated as exact
    DECIMALs (values carry ``scale`` decimals) and divided once in DOUBLE,
    and the centring mean adds the twelve month means in calendar order, so
    the result does not depend on the order in which Spark merges partials."""
    if period != 12:
        raise ValueError("decompose works on monthly series (period 12)")
    keys = list(keys)
    w = series_window(keys)
    h = period // 2
    vd = F.col(value).cast(f"decimal(20,{scale})")
    frame = w.rowsBetween(-h, h)
    full = F.count(vd).over(frame) == 2 * h + 1
    half = F.lit(Decimal("0.5"))                                   # exact, not a DOUBLE literal
    num = F.sum(vd).over(frame) - (F.lag(vd, h).over(w) + F.lead(vd, h).over(w)) * half
    t = panel.select("*", F.when(full, num).alias("_num"))
    t = t.select("*", (F.col("_num").cast("double") / F.lit(float(period))).alias("trend"),
                 (vd * F.lit(period) - F.col("_num")).alias("_d"),      # period * (value - trend)
                 F.month("date").alias("_mon"))
    t = materialize(t)                       # read for the season and for the result
    s = t.groupBy(*keys, "_mon").agg(
        (F.sum("_d").cast("double") / (F.lit(float(period)) * F.count("_d"))).alias("_s"))
    wide = s.groupBy(*keys).pivot("_mon", list(range(1, period + 1))).agg(F.first("_s"))
    total, cnt = F.lit(0.0), F.lit(0)
    for m in range(1, period + 1):
        total = total + F.coalesce(F.col(str(m)), F.lit(0.0))
        cnt = cnt + F.col(str(m)).isNotNull().cast("int")
    mean = wide.select(*keys, (total / cnt.cast("double")).alias("_mean"))
    season = s.join(mean, keys).select(*keys, "_mon", (F.col("_s") - F.col("_mean")).alias("seasonal"))
    return (t.join(season, keys + ["_mon"], "left")
             .withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
             .drop("_num", "_d", "_mon"))


def residual_autocorr(pred: DataFrame, keys: Sequence[str], y: str = "y", p: str = "prediction",
                      lag: int = 1) -> DataFrame:
    """Autocorrelation of forecast residuals at ``lag`` per group."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    e = pred.withColumn("_e", F.col(y) - F.col(p))
    return (e.withColumn("_el", F.lag("_e", lag).over(w))
             .groupBy(*keys).agg(pearson("_e", "_el").alias("resid_autocorr"),
                                 F.count("_el").alias("n_pairs")))


def cross_check(a: DataFrame, b: DataFrame, eps: float = 0.01,
                keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Full outer join of two publishers' panels on (series, date);
    flags missing sides and |difference| > eps."""
    keys = list(keys) + ["date"]
    j = (a.withColumnRenamed("value", "value_a")
          .join(b.withColumnRenamed("value", "value_b"), keys, "full"))
    diff = F.col("value_a") - F.col("value_b")
    return j.withColumn("diff", diff).withColumn(
        "status", F.when(F.col("value_a").isNull(), F.lit("missing_a"))
                   .when(F.col("value_b").isNull(), F.lit("missing_b"))
                   .when(F.abs(diff) > eps, F.lit("mismatch")).otherwise(F.lit("match")))
