import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def canonical(frame):
    """Rows of a pandas frame, columns and rows in order, for comparison."""
    import pandas as pd

    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(text(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, small):
    def check(query, sql):
        assert canonical(query(spark, small).toPandas()) == canonical(duck.execute(sql).fetch_df())

    return check
