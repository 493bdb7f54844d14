import inspect

import pytest
from oracle import DATA, compare, duck

import __spark_entry__ as entry
from tidemark.plans import MODULES

SF = f"{DATA}/sf0.001"
NAMES = sorted(n for m in MODULES for n in m.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, con, name):
    ok, say = compare(spark, name, SF, con)
    assert ok, say


def test_entry_contract(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.queries())
    for q in entry.queries().values():
        assert list(inspect.signature(q).parameters) == ["spark", "sf_dir"]


def test_names_are_unique():
    assert len(NAMES) == sum(len(m.QUERIES) for m in MODULES)
