import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Whether a query and its SQL give the same columns and rows, in any order."""

    def shown(v):
        if v is pd.NA or v is None or v != v:
            return ""
        return str(int(v) if isinstance(v, float) and v == int(v) else v)

    def rows(df, columns):
        return sorted(tuple(map(shown, r)) for r in df[columns].astype(object).itertuples(index=False))

    def check(found, sql):
        a, b = found.toPandas(), duck.sql(sql).df()
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        assert rows(a, columns) == rows(b, columns)

    return check
