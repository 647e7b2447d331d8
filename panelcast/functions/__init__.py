"""Column-level helpers: IEEE arithmetic, window specs, strict rolling stats."""

from panelcast.functions.ieee import ieee_div, ieee_ln, ratio_minus_one
from panelcast.functions.windows import (
    series_window, rolling, strict_mean, strict_std, ordered_lag,
)

__all__ = ["ieee_div", "ieee_ln", "ratio_minus_one", "series_window", "rolling",
           "strict_mean", "strict_std", "ordered_lag"]
