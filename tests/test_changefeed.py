import random

from tidemark.operators.changefeed import apply_feed

EVENTS = "event_id bigint, engine string, chunk_id string, op string, expected_present int, loaded_at timestamp_ntz, decided_id string"


def model(rows, base=()):
    """The feed applied one event at a time."""
    counted = {}
    for r in rows:
        if r[0] is not None:
            # of equal times the greatest other fields, nulls first
            key = (str(r[5] or ""), r[1] or "", r[2] or "", r[3] is not None, r[3] or "", r[4] is not None, r[4] or 0)
            if r[0] not in counted or key > counted[r[0]][0]:
                counted[r[0]] = (key, r)
    held, expected = {k: True for k, _ in base}, dict(base)
    for i in sorted(counted):
        _, engine, chunk, op, present, _, _ = counted[i][1]
        op = (op or "").strip().lower()
        if engine is None or chunk is None or op not in ("upsert", "delete", "skip"):
            continue
        k = (engine, chunk)
        if op != "skip":
            held[k] = op == "upsert"
        expected[k] = present if present is not None else int(op == "upsert")
    return {(*k, expected[k]) for k, h in held.items() if h}


def random_feed(seed, n=600):
    import datetime as dt

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        chunk = "hot" if rng.random() < 0.33 else f"c{rng.randrange(40)}"
        op = rng.choice(["upsert", "UPSERT", " upsert ", "delete", "Delete", "skip", None, "", "purge"])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(1000))
        row = (i * 1000, rng.choice(["a", "b"]), chunk, op, rng.choice([0, 1, None]), at, "clash")
        rows.append(row)
        if rng.random() < 0.2:
            rows.append((*row[:3], rng.choice(["upsert", "delete", None]), *row[4:5], at + dt.timedelta(seconds=rng.choice([-5, 5])), "x"))
        if rng.random() < 0.05:
            rows.append(row)
    rows += [(None, "a", "c1", "delete", 0, None, ""), (5, None, "c1", "upsert", 1, None, ""), (6, "a", None, "upsert", 1, None, ""), (7, "a", "late", "upsert", None, None, "")]
    rng.shuffle(rows)
    return rows


def test_matches_one_event_at_a_time(spark):
    for seed, size in ((1, 65536), (2, 1000), (3, 10**9)):
        rows = random_feed(seed)
        got = apply_feed(spark.createDataFrame(rows, EVENTS), range_size=size).collect()
        assert {tuple(r) for r in got} == model(rows) and len(got) == len(model(rows))


def test_base_comes_before_all_events(spark):
    rows = random_feed(4)
    base = [(("a", f"c{i}"), i % 2) for i in range(0, 80)]
    df = spark.createDataFrame([(*k, v, "x") for k, v in base] + [(None, "c1", 1, "x")], "engine string, chunk_id string, expected_present int, op string")
    got = apply_feed(spark.createDataFrame(rows, EVENTS), base=df).collect()
    assert {tuple(r) for r in got} == model(rows, base)
    nothing = apply_feed(spark.createDataFrame([], EVENTS), base=df).count()
    assert nothing == 80 and apply_feed(spark.createDataFrame([], EVENTS)).count() == 0
