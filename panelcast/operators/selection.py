"""Feature selection for every entity: lasso (R10) and forward stepwise.

Both work on one Gram row for each entity (:func:`linear.gram_any`, a distributed
aggregate), never on its data rows, and solve the entities of a batch as stacked matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelcast.operators.linear import INSUFFICIENT, MIXED, NOT_FINITE, OK, _fit_schema, _stack, gram_any

TOLERANCE = 1e-9
SWEEPS = 2000                 # coordinate sweeps at the last penalty; beyond them the status says so
WARM = 20                     # sweeps at the penalties before it, which are only starts
POLISH = 4                    # sweeps between attempts to solve for the features that are in
UNSETTLED = "Not converged"


def _polished(a: np.ndarray, b: np.ndarray, w: np.ndarray, lam: float, slack: float) -> np.ndarray | None:
    """The exact minimum where ``w`` has its features and their signs right, else None."""
    on = np.flatnonzero(w)
    out = np.zeros_like(w)
    if len(on):
        try:
            out[on] = np.linalg.solve(a[np.ix_(on, on)], b[on] - lam * np.sign(w[on]))
        except np.linalg.LinAlgError:
            return None
        if (np.sign(out[on]) != np.sign(w[on])).any():
            return None
    return out if (np.abs(b - a @ out) <= lam + slack).all() else None


def descend(a: np.ndarray, b: np.ndarray, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimises w'Aw / 2 - b'w + penalty |w|_1 for stacked problems (n, p, p), (n, p) by cyclic coordinate descent
    along a falling path of ``penalties`` (steps, n), each started from the solution before. As soon as the descent has found which
    features are in, and their signs, the rest is one linear system. Returns (w, converged)."""
    n, p = b.shape
    w, left = np.zeros((n, p)), b.copy()                     # left = b - A w
    diag = np.einsum("nii->ni", a)
    unit = np.where(diag > 0, diag, 1.0)
    slack = TOLERANCE * np.maximum(np.abs(b).max(1, initial=0.0), 1e-300)
    settled = np.ones(n, bool)
    for at_, lam in enumerate(penalties):
        todo, last = np.arange(n), at_ == len(penalties) - 1
        for turn in range(SWEEPS if last else WARM):
            wt, lt, at, dt, ut, pt = w[todo], left[todo], a[todo], diag[todo], unit[todo], lam[todo]
            moved = np.zeros(len(todo))
            for j in range(p):
                rho = lt[:, j] + dt[:, j] * wt[:, j]
                new = np.where(dt[:, j] > 0, np.sign(rho) * np.maximum(np.abs(rho) - pt, 0.0) / ut[:, j], 0.0)
                step = new - wt[:, j]
                if step.any():
                    wt[:, j] = new
                    lt -= at[:, :, j] * step[:, None]
                    moved = np.maximum(moved, np.abs(step) * dt[:, j])
            w[todo], left[todo] = wt, lt
            done = moved <= slack[todo]
            if turn % POLISH == POLISH - 1 or turn == 0:
                for i in np.flatnonzero(~done):
                    k = todo[i]
                    exact = _polished(a[k], b[k], w[k], lam[k], slack[k])
                    if exact is not None:
                        w[k], left[k], done[i] = exact, b[k] - a[k] @ exact, True
            todo = todo[~done]
            if not len(todo):
                break
        else:
            settled[todo] &= not last
    return w, settled


def fit_lasso(train: DataFrame, keys: Sequence[str] = ("entity_id",), share: float = 0.1, steps: int = 20, min_rows: int = 20) -> DataFrame:
    """Min ||y - Zw||^2 / 2n + penalty |w|_1 on standardised features (population std, a constant feature stays
    out) with an unpenalised intercept, for each group. The penalty is ``share`` of the smallest one that leaves no feature, reached over
    ``steps`` falling penalties. Returns fits as of :func:`linear.solve_gram` plus ``penalty``; every group has a row with a
    status."""
    keys = list(keys)
    g = gram_any(train, keys)
    schema = T.StructType([*_fit_schema(T.StructType([g.schema[k] for k in keys])).fields, T.StructField("penalty", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            out = pdf[keys].copy()
            out["model"], out["n_train"], out["features"] = "lasso", pdf["n"].astype("int64"), pdf["features"]
            for c in ("coef", "intercept", "mean_x", "scale_x", "penalty"):
                out[c] = None
            p = pdf["features"].map(lambda f: -1 if f is None else len(f))
            out["status"] = np.where(p < 0, MIXED, np.where(pdf["n"] < min_rows, INSUFFICIENT, OK))
            for size in sorted(set(p[out["status"] == OK])):
                at = np.flatnonzero((out["status"] == OK) & (p == size))
                part = pdf.iloc[at]
                n, my, mx = part["n"].to_numpy(float), part["mean_y"].to_numpy(float), _stack(part["mean_x"])
                a, b = _stack(part["xtx"]).reshape(-1, size, size), _stack(part["xty"])
                good = np.isfinite(a).all((1, 2)) & np.isfinite(b).all(1) & np.isfinite(mx).all(1) & np.isfinite(my)
                out.iloc[at[~good], out.columns.get_loc("status")] = NOT_FINITE
                at, n, my, mx, a, b = at[good], n[good], my[good], mx[good], a[good], b[good]
                if not len(at):
                    continue
                scale = np.sqrt(np.clip(np.einsum("nii->ni", a) / n[:, None], 0.0, None))
                flat = scale == 0
                scale[flat] = 1.0
                z = a / (scale[:, :, None] * scale[:, None, :]) / n[:, None, None]
                zy = np.where(flat, 0.0, b / scale / n[:, None])
                top = np.abs(zy).max(1, initial=0.0)
                path = np.geomspace(1.0, share, steps)[:, None] * top[None, :]
                w, settled = descend(z, zy, path)
                coef = w / scale
                for i, j in enumerate(at):
                    row = out.index[j]
                    out.at[row, "coef"], out.at[row, "intercept"] = coef[i].tolist(), float(my[i] - mx[i] @ coef[i])
                    out.at[row, "mean_x"], out.at[row, "scale_x"] = mx[i].tolist(), scale[i].tolist()
                    out.at[row, "penalty"] = float(path[-1, i])
                    if not settled[i]:
                        out.at[row, "status"] = UNSETTLED
            out["intercept"], out["penalty"] = out["intercept"].astype(float), out["penalty"].astype(float)
            yield out[names]
    return g.mapInPandas(fit, schema)


def sweep(m: np.ndarray, k: int) -> np.ndarray:
    """The sweep operator on pivot ``k`` of a symmetric matrix."""
    d = m[k, k]
    out = m - np.outer(m[:, k], m[k, :]) / d
    out[k, :], out[:, k] = m[k, :] / d, m[:, k] / d
    out[k, k] = -1.0 / d
    return out


def forward_stepwise(train: DataFrame, keys: Sequence[str] = ("entity_id",), max_steps: int | None = None, f_enter: float = 4.0,
                     min_rows: int = 10) -> DataFrame:
    """Features in the order in which least squares takes them up: at each step the one that lowers the residual
    sum of squares most (ties to the first feature), swept into the group's Gram matrix, as long as its F statistic reaches ``f_enter``, a residual
    degree of freedom is left, and ``max_steps`` is not passed. Returns (keys, step, feature, rss, f); groups with too few rows,
    uneven or non-finite features have no steps."""
    keys = list(keys)
    g = gram_any(train, keys)
    schema = T.StructType([*[g.schema[k] for k in keys], T.StructField("step", T.LongType()), T.StructField("feature", T.StringType()),
                           T.StructField("rss", T.DoubleType()), T.StructField("f", T.DoubleType())])

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.features is None or r.n < min_rows:
                    continue
                p = len(r.features)
                m = np.zeros((p + 1, p + 1))
                m[:p, :p], m[p, p] = np.asarray(r.xtx, float).reshape(p, p), r.yty
                m[:p, p] = m[p, :p] = np.asarray(r.xty, float)
                if not np.isfinite(m).all():
                    continue
                free, first = np.ones(p, bool), np.diag(m)[:p].copy()
                for step in range(1, (p if max_steps is None else min(p, max_steps)) + 1):
                    d = np.diag(m)[:p]
                    fits = free & (d > 1e-9 * first)             # neither constant nor a combination of those taken
                    df = r.n - step - 1
                    if not fits.any() or df < 1:
                        break
                    gain = np.where(fits, m[:p, p] ** 2 / np.where(fits, d, 1.0), -1.0)
                    k = int(gain.argmax())
                    rss = m[p, p] - gain[k]
                    f = gain[k] / (rss / df) if rss > 0 else np.inf
                    if f < f_enter:
                        break
                    m = sweep(m, k)
                    free[k] = False
                    out.append((*[getattr(r, c) for c in keys], step, r.features[k], max(rss, 0.0), f))
                    if rss <= 0:
                        break
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])
    return g.mapInPandas(select, schema)
