"""Every query with an SQL twin gives the twin's rows, with the data cut into many blocks."""

import pytest

import __spark_entry__ as entry
from tools.check import canon

QUERIES, TWINS = entry.queries(), entry.oracle_sql()


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)
    assert len(TWINS) > 200


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(name, spark, duck, folder):
    spark.conf.set("spark.campanile.rowsPerBlock", "150")
    try:
        ours = QUERIES[name](spark, folder).toPandas()
    finally:
        spark.conf.unset("spark.campanile.rowsPerBlock")
    theirs = duck.execute(TWINS[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
