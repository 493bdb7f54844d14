import datetime as dt
import random

import pytest

from tidemark.operators.history import attribute_history

START = dt.datetime(2024, 1, 1)
SCHEMA = "entity string, at timestamp_ntz, rank bigint, value string, span string"


def model(rows):
    last = {}
    for e, at, rank, value, _ in rows:
        if e is None or at is None:
            continue
        key = (rank is not None, rank or 0, value is not None, value or "")
        if (e, at) not in last or key > last[e, at][0]:
            last[e, at] = (key, value)
    out, per = [], {}
    for (e, at), (_, v) in sorted(last.items()):
        per.setdefault(e, []).append((at, v))
    for e, own in per.items():
        runs = [own[0]]
        for at, v in own[1:]:
            if v != runs[-1][1]:
                runs.append((at, v))
        out += [(e, v, at, runs[i + 1][0] if i + 1 < len(runs) else None) for i, (at, v) in enumerate(runs) if v is not None]
    return sorted(out, key=str)


def run(spark, rows, **how):
    return sorted((tuple(r) for r in attribute_history(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


@pytest.mark.parametrize("common", [False, True])
@pytest.mark.parametrize("span", ["day", "month", "year"])
def test_matches_a_plain_walk(spark, common, span):
    rng = random.Random(hash(span) % 100)
    rows = []
    for _ in range(900):
        e = "hot" if rng.random() < 0.33 else f"e{rng.randrange(20)}"
        at = START + dt.timedelta(hours=rng.randrange(0, 24 * 150, 5))
        rows.append((e, at, rng.randrange(3), rng.choice(["x", "x", "y", "z", None]), "clash"))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    rows += [(None, START, 1, "x", ""), ("e1", None, 1, "x", ""), ("alone", START, None, "x", ""), ("never", START, 1, None, "")]
    assert run(spark, rows, common_snapshots=common, span=span) == model(rows)
    if not common:  # full spans are parted, of the hot entity as far as hours
        assert run(spark, rows, span=span, span_rows=3) == model(rows)


def test_many_snapshots_in_one_span(spark):
    """More than one bitmap word, with every kind of gap."""
    rng = random.Random(9)
    rows = [(f"e{k}", START + dt.timedelta(minutes=m), 1, "x" if (m // 50) % 2 else "y", "") for k in range(4) for m in range(400) if rng.random() < 0.25 * (k + 1)]
    for common in (False, True):
        assert run(spark, rows, common_snapshots=common) == model(rows)


def test_overruled_values_and_empty_tables(spark):
    day = lambda n: START + dt.timedelta(days=n)
    rows = [("a", day(1), 1, "x", ""), ("a", day(2), 2, "y", ""), ("a", day(2), 3, "x", ""), ("a", day(4), 4, None, ""), ("a", day(6), 5, "x", "")]
    assert run(spark, rows) == [("a", "x", day(1), day(4)), ("a", "x", day(6), None)]
    assert attribute_history(spark.createDataFrame([], SCHEMA)).count() == 0
