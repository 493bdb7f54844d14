import datetime as dt

import pytest

import tidemark.operators.orphans as o
from tidemark.operators.orphans import filter_shape, orphan_references, orphan_report, probed

T = [dt.datetime(2024, m, 3) for m in range(1, 13)]
CHILD, PARENT = "child_key string, ref string, at timestamp_ntz, kind string", "parent_key string, is_deleted boolean, first_at timestamp_ntz, ref string"

CHILDREN = [
    ("ok", "p", T[5], ""), ("gone", "nowhere", T[5], ""), ("deleted", "q", T[5], ""), ("late", "r", T[2], ""), ("none", None, T[1], ""),
    ("first counts", "q", T[6], ""), ("first counts", "nowhere", T[7], ""), ("first counts", None, T[3], ""), ("ok", "p", T[9], ""), ("same time", "r", T[3], ""), (None, "nowhere", T[1], ""),
    ("no time", "nowhere", None, ""),
]
PARENTS = [("p", False, T[0], ""), ("q", True, T[11], ""), ("r", None, T[3], ""), (None, False, T[0], ""), ("never late", False, None, "")]
WANT = {("gone", "missing", "2024-06"), ("deleted", "deleted", "2024-06"), ("late", "late", "2024-03"), ("first counts", "missing", "2024-04"), ("no time", "missing", None)}


@pytest.mark.parametrize("most", [o.MOST_WORDS, 1])
def test_kinds_and_periods(spark, monkeypatch, most):
    """The same with one filter and with several."""
    monkeypatch.setattr(o, "MOST_WORDS", most)
    got = orphan_references(spark.createDataFrame(CHILDREN, CHILD), spark.createDataFrame(PARENTS, PARENT), "t", "f").collect()
    assert {(r.child_key, r.kind, r.period) for r in got} == WANT and len(got) == len(WANT)
    assert {(r.child_table, r.child_field) for r in got} == {("t", "f")}


def test_empty_tables(spark):
    children, parents = spark.createDataFrame(CHILDREN, CHILD), spark.createDataFrame(PARENTS, PARENT)
    assert orphan_references(children.limit(0), parents, "t", "f").count() == 0
    alone = orphan_references(children, parents.limit(0), "t", "f")
    assert {r.kind for r in alone.collect()} == {"missing"} and alone.count() == 7
    assert sum(r.refs for r in orphan_report(alone).collect()) == 7


@pytest.mark.parametrize("most", [o.MOST_WORDS, 400])
def test_filters_never_lose_a_parent_and_prove_most_orphans(spark, monkeypatch, most):
    monkeypatch.setattr(o, "MOST_WORDS", most)
    assert (filter_shape(5000)[0] > 1) == (most == 400)
    parents = spark.range(0, 5000).selectExpr("concat('k', id) as parent_key")
    children = spark.range(0, 20000).selectExpr("concat('k', id) as ref", "id as _row_")
    rows = probed(children, "ref", parents, "parent_key", 5000).collect()
    sure = {r._row_ for r in rows if not r.maybe}
    assert len(rows) == 20000 and min(sure) >= 5000 and len(sure) > 0.93 * 15000


def test_one_filter_has_a_bound():
    for n in (0, 1, 10**6, 10**9, 10**12):
        filters, rows = filter_shape(n)
        assert filters >= 1 and rows * o.ROW_WORDS <= o.MOST_WORDS + o.ROW_WORDS and filters * rows * o.ROW_WORDS * 64 >= n * o.BITS_PER_KEY
