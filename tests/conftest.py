import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from ravelin.runtime import prepare

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return prepare(s)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return repr(v)


@pytest.fixture(scope="session")
def same_as_sql(duck):
    def check(df, sql):
        cols = sorted(df.columns)
        ours = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
        assert sorted(x[0] for x in duck.sql(sql).description) == cols
        theirs = sorted(tuple(norm(v) for v in r) for r in duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql})").fetchall())
        assert ours == theirs

    return check
