import random

import numpy as np

from tidemark.llm.packing import non_negative_least_squares, pack, plan_containers, shallow_combinations


def run(spark, sizes, capacity=2048, **more):
    df = spark.createDataFrame([(f"i{k}", n, "x") for k, n in enumerate(sizes)], "item string, tokens bigint, container string")
    rows = pack(df, capacity, **more).collect()
    pieces, load = {}, {}
    for r in rows:
        pieces.setdefault(r.item, {})[r.piece] = r.tokens
        load[r.container] = load.get(r.container, 0) + r.tokens
    assert len(rows) == sum(map(len, pieces.values()))
    assert max(load.values(), default=0) <= capacity
    for k, n in enumerate(sizes):
        got, n = pieces[f"i{k}"], max(0, n or 0)
        assert sum(got.values()) == n and len(got) == max(1, -(-n // capacity)) and sorted(got) == list(range(len(got)))
    return load


def test_every_item_once_and_little_room_left(spark):
    rng = random.Random(1)
    sizes = [min(9000, int(rng.lognormvariate(5.6, 1.0))) for _ in range(4000)]
    load = run(spark, sizes)
    assert sum(sizes) / (len(load) * 2048) > 0.98


def test_odd_sizes(spark):
    run(spark, [None, 0, -3, 1, 2047, 2048, 2049, 4096, 4097, 100_000])
    run(spark, [])
    run(spark, [1500] * 50)


def test_capacities_that_are_no_multiple_of_a_bin(spark):
    rng = random.Random(4)
    for capacity in (1, 2, 3, 10, 513, 1001, 2050, 5000):
        sizes = [capacity, capacity + 1, 3 * capacity, *(rng.randint(0, capacity) for _ in range(150))]
        load = run(spark, sizes, capacity)
        assert len(load) <= 1.25 * sum(max(1, n) for n in sizes) / capacity + 12


def test_salts_grow_with_a_bin(spark):
    sizes = [700] * 900 + [640] * 50
    few, many = run(spark, sizes), run(spark, sizes, ranked_together=10)
    assert sorted(few.values()) == sorted(many.values())


def test_one_length_holds_most_items(spark):
    load = run(spark, [700] * 3000 + [640] * 1500 + [3] * 10)
    assert len(load) <= (3000 * 704 + 1500 * 640 + 80) / 2048 * 1.03 + 2


def test_plan_uses_up_the_histogram():
    rng = random.Random(2)
    for _ in range(5):
        h = {b: rng.randint(0, 3000) for b in rng.sample(range(1, 257), 120)}
        plan, used = plan_containers(h, 256), dict.fromkeys(h, 0)
        for bins, n in plan:
            assert sum(b * k for b, k in bins.items()) <= 256 and n > 0
            for b, k in bins.items():
                used[b] += n * k
        assert used == h


def test_combinations_fill_a_container():
    m = shallow_combinations(64)
    assert ((np.arange(1, 65) @ m) == 64).all() and len({tuple(c) for c in m.T}) == m.shape[1]


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(3)
    a, b = rng.random((20, 60)), rng.random(20)
    x = non_negative_least_squares(a, b, 1e-8)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and gradient.min() > -1e-5 and np.abs(gradient[x > 1e-9]).max() < 1e-5
