import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(v)
    return v


def same_rows(df, rel):
    """Rows of a Spark frame and a DuckDB relation, columns by name, in any order."""
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    spark_rows = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    at = [rel.columns.index(c) for c in cols]
    duck_rows = [tuple(_plain(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(spark_rows, key=key) == sorted(duck_rows, key=key)
