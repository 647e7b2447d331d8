import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from panelcast.session import get_spark
    s = get_spark("local[4]", app="panelcast-tests", shuffle_partitions=4)
    yield s
    s.stop()


def panel_df(spark, rows, schema="entity_id string, series_id string, date date, value double"):
    return spark.createDataFrame(rows, schema)
