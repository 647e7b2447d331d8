"""Hidden regimes (R6): a two-state switching model for each series.

``y`` is normal with a mean and variance of the state; states follow a Markov chain. A row's
2 x 2 transfer matrix is the chain times the densities; products of matrices are
associative, so a series is cut into blocks of ``BLOCK`` rows: each block's product is
taken in parallel, a scan over these few matrices gives the state of knowledge
before each block and the evidence after it, and the blocks are finished in parallel.
Expectation maximisation repeats this, and its sums are a grouped aggregate. No task
holds more than blocks of bounded size and a series' block matrices (rows / BLOCK).

A NULL or NaN value says nothing about the state; an infinite one does not either.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.windows import SERIES_KEYS
from panelcast.session import Spool

BLOCK = 256
FLOOR = 1e-3                  # a state's variance is at least this share of the series' own
PARAMS = ("m0", "m1", "v0", "v1", "stay0", "stay1", "first0")


def start_params(rows: DataFrame, keys: Sequence[str] = SERIES_KEYS, y: str = "y", stay: float = 0.9) -> DataFrame:
    """One row for each series: means half a standard deviation below (state 0) and above (state 1) the
    series' own, its variance for both, and chains that stay with probability ``stay``. Series whose values do not vary
    have no model."""
    v = F.when(~F.isnan(y) & (F.abs(y) < float("inf")), F.col(y))
    s = rows.groupBy(*keys).agg(F.avg(v).alias("_m"), F.var_pop(v).alias("_v")).filter("_v > 0")
    half = F.sqrt("_v") * 0.5
    return s.select(*keys, (F.col("_m") - half).alias("m0"), (F.col("_m") + half).alias("m1"), F.col("_v").alias("v0"), F.col("_v").alias("v1"),
                    F.lit(stay).alias("stay0"), F.lit(stay).alias("stay1"), F.lit(0.5).alias("first0"), F.col("_v").alias("spread"))


def blocks(rows: DataFrame, keys: Sequence[str] = SERIES_KEYS, y: str = "y", block: int = BLOCK) -> DataFrame:
    """(keys, block, rows ARRAY<STRUCT<date, y>>): at most ``block`` rows of a series in order of date."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1
    return (rows.withColumn("block", F.floor(n / block).cast("long")).groupBy(*keys, "block")
            .agg(F.array_sort(F.collect_list(F.struct("date", F.col(y).alias("y")))).alias("rows")))


def densities(y: np.ndarray, p: pd.DataFrame) -> np.ndarray:
    """(blocks, rows, 2), the larger one 1; 1 for both where a value is missing. ``y`` (blocks, rows)."""
    mean, var = p[["m0", "m1"]].to_numpy(float)[:, None, :], p[["v0", "v1"]].to_numpy(float)[:, None, :]
    with np.errstate(invalid="ignore", over="ignore"):
        log = -0.5 * ((y[:, :, None] - mean) ** 2 / var + np.log(var))
        log -= log.max(2, keepdims=True)
    return np.where(np.isfinite(y)[:, :, None], np.exp(np.where(np.isfinite(log), log, 0.0)), 1.0)


def chain(p: pd.DataFrame) -> np.ndarray:
    a, b = p["stay0"].to_numpy(float), p["stay1"].to_numpy(float)
    return np.stack([np.stack([a, 1 - a], 1), np.stack([1 - b, b], 1)], 1)


def padded(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are rows) of blocks, as rectangles; missing values are NaN."""
    n = pdf["rows"].map(len).to_numpy()
    y = np.full((len(pdf), n.max()), np.nan)
    for i, r in enumerate(pdf["rows"]):
        y[i, :n[i]] = [np.nan if x["y"] is None else x["y"] for x in r]
    return y, np.arange(n.max())[None, :] < n[:, None]


def _norm(v: np.ndarray) -> np.ndarray:
    return v / v.sum(-1, keepdims=True)


def _matrices(pdf: pd.DataFrame) -> np.ndarray:
    """(blocks, 2, 2): product of the transfer matrices of each block, scaled. The first row of a series has no step before it."""
    y, real = padded(pdf)
    b, step = densities(y, pdf), chain(pdf)
    out = np.broadcast_to(np.eye(2), (len(pdf), 2, 2)).copy()
    for t in range(y.shape[1]):
        first = (pdf["block"].to_numpy() == 0) & (t == 0)
        m = np.where(first[:, None, None], np.eye(2), step) * b[:, t, None, :]
        nxt = out @ m
        out = np.where(real[:, t, None, None], nxt / nxt.sum((1, 2), keepdims=True), out)
    return out


def _scan(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """What is known before each block of a series, and the evidence of the blocks after it."""
    pdf = pdf.sort_values("block", ignore_index=True)
    m = pdf[["a", "b", "c", "d"]].to_numpy(float).reshape(-1, 2, 2)
    before, after = np.empty((len(m), 2)), np.empty((len(m), 2))
    know = np.array([pdf["first0"].iloc[0], 1 - pdf["first0"].iloc[0]])
    for i in range(len(m)):
        before[i], know = know, _norm(know @ m[i])
    evidence = np.ones(2)
    for i in range(len(m) - 1, -1, -1):
        after[i], evidence = evidence, _norm(m[i] @ evidence)
    out = pdf[[*keys, "block"]].copy()
    out["before0"], out["before1"], out["after0"], out["after1"] = before[:, 0], before[:, 1], after[:, 0], after[:, 1]
    return out


def _finish(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, real rows, filtered, smoothed, expected transitions) of blocks with their surroundings."""
    y, real = padded(pdf)
    b, step = densities(y, pdf), chain(pdf)
    n, size = y.shape
    start = pdf["block"].to_numpy() == 0
    f = np.empty((n, size, 2))
    know = pdf[["before0", "before1"]].to_numpy(float)
    for t in range(size):
        ahead = know if t else np.where(start[:, None], know, (know[:, None, :] @ step)[:, 0])
        if t:
            ahead = (know[:, None, :] @ step)[:, 0]
        new = _norm(ahead * b[:, t])
        know = np.where(real[:, t, None], new, know)
        f[:, t] = know
    smooth, moves = np.empty_like(f), np.zeros((n, 2, 2))
    evidence = pdf[["after0", "after1"]].to_numpy(float)
    for t in range(size - 1, -1, -1):
        smooth[:, t] = _norm(f[:, t] * evidence)
        before = f[:, t - 1] if t else pdf[["before0", "before1"]].to_numpy(float)
        xi = before[:, :, None] * step * (b[:, t] * evidence)[:, None, :]
        xi /= xi.sum((1, 2), keepdims=True)
        counts = real[:, t] & ~(start & (t == 0))
        moves += np.where(counts[:, None, None], xi, 0.0)
        back = _norm((step @ (b[:, t] * evidence)[:, :, None])[:, :, 0])
        evidence = np.where(real[:, t, None], back, evidence)
    return y, real, f, smooth, moves


def _surrounded(cut: DataFrame, params: DataFrame, keys: list[str], sp: Spool) -> DataFrame:
    both = cut.join(params, keys)
    schema = T.StructType([*[cut.schema[k] for k in keys], cut.schema["block"], T.StructField("first0", T.DoubleType()),
                           *[T.StructField(c, T.DoubleType()) for c in "abcd"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = pdf[[*keys, "block", "first0"]].copy()
                out[["a", "b", "c", "d"]] = _matrices(pdf).reshape(-1, 4)
                yield out
    where = T.StructType([*schema.fields[:len(keys) + 1], *[T.StructField(c, T.DoubleType()) for c in ("before0", "before1", "after0", "after1")]])
    around = both.mapInPandas(run, schema).groupBy(*keys).applyInPandas(lambda pdf: _scan(pdf, keys), where)
    return both.join(sp.put(around), [*keys, "block"])


def probabilities(rows: DataFrame, params: DataFrame, keys: Sequence[str] = SERIES_KEYS, y: str = "y", block: int = BLOCK) -> DataFrame:
    """(keys, date, y, filtered, smoothed): the probability of state 1 from the values so far, and from all values. Series without
    a model have no rows."""
    keys = list(keys)
    sp = Spool(rows.sparkSession)
    cut = sp.put(blocks(rows, keys, y, block))
    date = cut.schema["rows"].dataType.elementType["date"]
    schema = T.StructType([*[cut.schema[k] for k in keys], date, *[T.StructField(c, T.DoubleType()) for c in ("y", "filtered", "smoothed")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            _, real, f, smooth, _ = _finish(pdf)
            n = real.sum(1)
            out = pdf[keys].loc[pdf.index.repeat(n)].reset_index(drop=True)
            out["date"] = [x["date"] for r in pdf["rows"] for x in r]
            out["y"] = [x["y"] for r in pdf["rows"] for x in r]
            out["filtered"], out["smoothed"] = f[:, :, 1][real], smooth[:, :, 1][real]
            yield out
    return _surrounded(cut, params, keys, sp).mapInPandas(run, schema)


def fit(rows: DataFrame, keys: Sequence[str] = SERIES_KEYS, y: str = "y", rounds: int = 10, block: int = BLOCK) -> DataFrame:
    """Parameters of each series after ``rounds`` of expectation maximisation from :func:`start_params`."""
    keys = list(keys)
    sp = Spool(rows.sparkSession)
    cut = sp.put(blocks(rows, keys, y, block))
    params = sp.put(start_params(rows, keys, y))
    sums = ["g0", "g1", "s0", "s1", "q0", "q1", "x00", "x01", "x10", "x11", "f0"]
    schema = T.StructType([*[cut.schema[k] for k in keys], *[T.StructField(c, T.DoubleType()) for c in sums]])

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            y, real, _, smooth, moves = _finish(pdf)
            seen = real & np.isfinite(y)
            g = np.where(seen[:, :, None], smooth, 0.0)
            v = np.where(seen, y, 0.0)[:, :, None] - pdf[["m0", "m1"]].to_numpy(float)[:, None, :]     # about the old means
            out = pdf[keys].copy()
            out[sums[:10]] = np.column_stack([g.sum(1), (g * v).sum(1), (g * v * v).sum(1), moves.reshape(-1, 4)])
            out["f0"] = np.where(pdf["block"].to_numpy() == 0, smooth[:, 0, 0], 0.0)
            yield out
    for _ in range(rounds):
        e = _surrounded(cut, params, keys, sp).mapInPandas(expect, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        new = {}
        for s in "01":
            shift = F.when(F.col(f"g{s}") > 0, F.col(f"s{s}") / F.col(f"g{s}")).otherwise(F.lit(0.0))
            new[f"m{s}"] = F.col(f"m{s}") + shift
            var = F.when(F.col(f"g{s}") > 0, F.col(f"q{s}") / F.col(f"g{s}") - shift * shift).otherwise(F.col(f"v{s}"))
            new[f"v{s}"] = F.greatest(var, F.col("spread") * FLOOR)
            out_of = F.col(f"x{s}0") + F.col(f"x{s}1")
            new[f"stay{s}"] = F.when(out_of > 0, F.col(f"x{s}{s}") / out_of).otherwise(F.col(f"stay{s}"))
        new["first0"] = F.col("f0")
        params = sp.put(params.join(e, keys).select(*keys, *[new[c].alias(c) for c in PARAMS], "spread"))
    return params
