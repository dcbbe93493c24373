"""One local session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

from subgrade.session import make_importable

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").appName("tests")
    for key, value in {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoint')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    make_importable(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def same_rows(got, wanted) -> None:
    """Both frames hold the same rows under the same columns, in any order."""
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)

    def rows(frame):
        return sorted((tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)), key=repr)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return v + 0.0 if isinstance(v, float) else v

    a, b = rows(got), rows(wanted)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:5]
