import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL, row by row in any order."""

    def check(query, sql):
        df, o = query(spark, DATA), duck.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(o.columns)
        ours = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
        at = [o.columns.index(c) for c in names]
        theirs = sorted(tuple(cell(r[i]) for i in at) for r in o.fetchall())
        assert len(ours) == len(theirs) and [x for x in zip(ours, theirs) if x[0] != x[1]] == []

    return check
