import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in sorted(os.listdir(SMALL)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return int(value) if type(value).__name__ in ("bool", "bool_") else value


def _same_rows(df, con, sql):
    left, right = df.toPandas(), con.execute(sql).fetchdf()
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    rows = [sorted(tuple(str(plain(v)) for v in r) for r in x[columns].itertuples(index=False)) for x in (left, right)]
    assert rows[0] == rows[1]
    return len(left)


@pytest.fixture(scope="session")
def same_rows():
    """Asserts that a DataFrame and a query give the same columns and rows, and returns how many."""
    return _same_rows
