import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from campanile.session import local_session

    session = local_session(8, shuffle_partitions=4, app="campanile-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=[150, 1_000_000], ids=["many-blocks", "one-block"])
def blocks(request, spark):
    """Rows per block: small enough to cut every table, and large enough to cut none."""
    spark.conf.set("spark.campanile.rowsPerBlock", str(request.param))
    yield request.param
    spark.conf.unset("spark.campanile.rowsPerBlock")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from tools.check import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{TESTDATA}/{name}.parquet')")
    return con


@pytest.fixture(scope="session")
def folder():
    return TESTDATA
