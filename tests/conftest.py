import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return SMALL


def rounded(v):
    import math

    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.7g}") + 0.0
    return v


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def same_as_sql(spark, duck, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = [tuple(rounded(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = [tuple(rounded(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(mine, key=key) == sorted(theirs, key=key)
