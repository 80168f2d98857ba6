"""All catalogue queries against their SQL, in one session."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from meterload.plans.oracles import ORACLES
from meterload.plans.queries import QUERIES
from tools.compare import normalise, oracle_frame

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    got = entry(spark)
    assert got.columns == ["city", "index", "total"] and got.count() == 3600


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = oracle_frame(FOLDER, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normalise(got) == normalise(want)
