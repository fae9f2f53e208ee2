import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import os

    import duckdb

    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return c


def rows(frame):
    """Rows of a pandas frame, columns by name, in an order of their own; doubles to nine places."""
    import numbers

    import pandas as pd

    def plain(v):
        if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return bool(v)
        if isinstance(v, numbers.Integral):
            return int(v)
        if isinstance(v, numbers.Real):
            return int(v) if float(v).is_integer() else round(float(v), 9)
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=lambda r: tuple((v is not None, str(v)) for v in r))
