"""Every registered query against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from offerlens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    rows = catalogue.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    found = Counter(tuple(r) for r in rows.select(*[f"`{c}`" for c in columns]).collect())
    answer = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert found == Counter(tuple(r[names.index(c)] for c in columns) for r in answer.fetchall())


def test_every_query_has_its_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = catalogue.queries()["review_queue"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "value" not in plan.split("ReadSchema")[-1]
