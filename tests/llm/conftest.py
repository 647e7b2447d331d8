import os

import pytest


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def write_tables(path, spark, **frames):
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(os.path.join(str(path), f"{name}.parquet"))
    return str(path)
