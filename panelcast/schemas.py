"""Explicit schemas: every read names its types, ``date`` is always DATE."""

from pyspark.sql import types as T

PANEL_KEYS = ("entity_id", "series_id", "date")

# (entity_id, series_id, date, value), unique on the first three.
PANEL = T.StructType([
    T.StructField("entity_id", T.StringType(), False),
    T.StructField("series_id", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("value", T.DoubleType(), True),
])

# Landed API payload: {"observations": [{"date": "...", "value": "..."}]};
# value '.' marks a missing observation.
PAYLOAD = T.StructType([
    T.StructField("series_id", T.StringType(), True),
    T.StructField("observations", T.ArrayType(T.StructType([
        T.StructField("date", T.StringType(), True),
        T.StructField("value", T.StringType(), True),
    ])), True),
])

# Cached series file: JSON array of {date, value, series_id}.
CACHED_SERIES = T.StructType([
    T.StructField("date", T.DateType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("series_id", T.StringType(), True),
])
