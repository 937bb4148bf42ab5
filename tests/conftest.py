import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='inkwell-test-')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def same(spark_df, duck, sql):
    """Both sides' rows, columns by name, in any order."""

    def rows(columns, values):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        show = lambda v: None if v is None else round(v, 4) if isinstance(v, float) else v
        return sorted((str([show(r[i]) for i in order]) for r in values)), sorted(columns)

    r = duck.execute(sql)
    theirs = rows([c[0] for c in r.description], r.fetchall())
    assert rows(spark_df.columns, [tuple(x) for x in spark_df.collect()]) == theirs
