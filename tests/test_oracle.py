"""Every registered query against its SQL."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from oracle import connect, differences

import __spark_entry__ as driver
from checks.registry import ORACLES as SQL
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, request):
    """The selected queries, several at a time: on small data planning takes most of the time."""
    params = (i.callspec.params for i in request.session.items if hasattr(i, "callspec"))
    names = [p["query_name"] for p in params if "query_name" in p]
    con = connect(SF)
    with ThreadPoolExecutor(4) as pool:
        running = {
            n: pool.submit(differences, spark, con.cursor(), QUERIES[n], SQL[n], SF) for n in names if n in SQL
        }
    con.close()
    return running


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).columns == ["o_orderkey", "change", "source_rows", "target_rows"]


@pytest.mark.parametrize("query_name", sorted(QUERIES))
def test_query(results, query_name):
    assert results[query_name].result() == []
