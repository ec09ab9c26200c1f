import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tests-')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


def same_rows(df, con, sql):
    """Both engines' rows as sorted texts, columns by name."""
    names = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    mine = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert mine == theirs
    return len(mine)
