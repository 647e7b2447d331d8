"""Forecast metrics: RMSE, MAE and row-wise directional accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(pred: DataFrame, keys: Sequence[str], y: str = "y",
            p: str = "prediction") -> DataFrame:
    """A11 / A12 / M7 in one aggregate: rmse, mae, directional accuracy
    (share of rows with sign(y) == sign(prediction)) and n."""
    err = F.col(y) - F.col(p)
    return pred.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("directional_accuracy"),
        F.count(F.lit(1)).alias("n_predictions"))
