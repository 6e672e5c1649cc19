"""One small local session for all tests, and the comparison of a query with its SQL."""

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    cpus = os.environ.get("TEST_CPUS", "4")
    session = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normalized(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name; floats to nine digits."""

    def cell(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NA or x is pd.NaT:
            return "∅"
        if isinstance(x, float):
            return f"{x:.9g}" if x != int(x) else str(int(x))
        return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in row) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(left: pd.DataFrame, right: pd.DataFrame) -> None:
        assert sorted(left.columns) == sorted(right.columns)
        a, b = normalized(left), normalized(right)
        assert len(a) == len(b)
        assert a == b

    return check
