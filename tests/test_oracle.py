"""Every query with SQL gives the same rows as the SQL; the others give rows."""

import compare
import pytest

from vigilog.plans import load_queries

QUERIES, ORACLE = load_queries()


@pytest.fixture(scope="module")
def sql(sf_dir):
    return compare.connection(sf_dir)


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_same_rows_as_sql(spark, sql, sf_dir, name):
    assert compare.difference(spark, sql, name, QUERIES[name], ORACLE[name], sf_dir) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
