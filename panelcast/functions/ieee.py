"""IEEE-754 arithmetic under ANSI mode.

Spark 4 raises on ``x / 0.0`` and returns NULL for ``ln(0)``; the analysis
semantics need +-inf / NaN instead (such rows are kept, only NULL rows drop).
The zero is replaced inside ``when`` so the division never sees it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")
_NAN = float("nan")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ieee_div(a, b) -> Column:
    """a / b with IEEE results: b == 0 gives +-inf, or NaN when a is 0 or NaN."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    on_zero = (F.when(F.isnan(a) | (a == 0), F.lit(_NAN))
               .otherwise(F.signum(a) * F.lit(_INF)))
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(b == 0, on_zero)
            .otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b)))


def ieee_ln(x) -> Column:
    """Natural log: ln(0) = -inf, ln(<0) = NaN, NULL stays NULL."""
    x = _c(x).cast("double")
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(F.isnan(x) | (x < 0), F.lit(_NAN))
            .when(x == 0, F.lit(-_INF))
            .otherwise(F.ln(F.when(x > 0, x))))


def ratio_minus_one(a, b) -> Column:
    """a / b - 1 in IEEE arithmetic (year-on-year, momentum ratio)."""
    return ieee_div(a, b) - F.lit(1.0)


def pearson(y, x) -> Column:
    """Pearson correlation aggregate that is NULL (not an ANSI error) when a
    side is constant or has fewer than two pairs; null pairs are skipped."""
    y, x = _c(y).cast("double"), _c(x).cast("double")
    both = y.isNotNull() & x.isNotNull()
    yy, xx = F.when(both, y), F.when(both, x)
    den = F.var_pop(yy) * F.var_pop(xx)
    return F.when(den > 0, F.covar_pop(yy, xx) / F.sqrt(F.when(den > 0, den)))
