"""panelcast: distributed time-series panel analytics on Spark.

Every public function takes and returns lazy DataFrames over a long panel
``(entity_id, series_id, date, value)``; nothing is collected except small
metadata (feature names) and metric tables.
"""

from panelcast.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
