import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def same_rows(df, sql, sf_dir):
    """Does the result equal that of the SQL, whatever the order of rows?"""
    from collections import Counter

    import pandas as pd

    got, want = df.toPandas(), duck(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(x):
        return Counter(tuple(None if v is None or v is pd.NA or v != v else v for v in r) for r in x[sorted(x.columns)].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)
