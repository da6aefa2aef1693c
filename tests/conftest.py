import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def same_rows(df, relation) -> None:
    """Equal columns and equal rows, in any order; doubles to nine digits."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    rounded = lambda x: round(x, 9) if isinstance(x, float) else x
    at = [relation.columns.index(c) for c in columns]
    got = sorted(repr(tuple(rounded(r[c]) for c in columns)) for r in df.collect())
    want = sorted(repr(tuple(rounded(r[i]) for i in at)) for r in relation.fetchall())
    assert got == want
