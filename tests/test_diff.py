from pyspark.sql import functions as F

from tidemark.functions.times import iso_micros, ntz_micros
from tidemark.operators.diff import Field, arrays_close, diff_copies

SCHEMA = "key string, v bigint, a string, n int, e array<float>, field string, value string"
FIELDS = [Field("a"), Field("n"), Field("e", tolerance=0.001)]


def run(spark, left, right):
    df = lambda rows: spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in diff_copies(df(left), df(right), "key", FIELDS, "v").collect())


def test_cells_and_keys(spark):
    same = ("same", 1, "x", 1, [0.1, 0.2])
    left = [same, ("null", 1, None, None, None), ("nulls", 1, None, 2, None), ("left", 1, "x", 1, [0.0]), ("old", 1, "x", 1, []), ("old", 2, "y", 1, []), ("rep", 3, "x", 1, None), ("rep", 3, "x", 1, None), (None, 1, "x", 1, None)]
    right = [same, ("null", 1, None, None, None), ("nulls", 1, "x", None, [0.0]), ("right", 1, "x", 1, [0.0]), ("old", 9, "y", 1, []), ("old", 3, "z", 1, []), ("rep", 1, "x", 2, None)]
    assert run(spark, left, right) == [
        ("left", "not_in_right"), ("nulls", "a"), ("nulls", "e"), ("nulls", "n"), ("rep", "n"), ("right", "not_in_left"),
    ]


def test_numbers_within_the_tolerance_are_equal(spark):
    pairs = {"close": ([0.1, 0.2], [0.1005, 0.1995]), "far": ([0.1, 0.2], [0.1, 0.2015]), "longer": ([0.1], [0.1, 0.0]), "empty": ([], []), "null number": ([None, 1.0], [None, 1.0]), "one null number": ([None], [0.0]), "both ways": ([1.0, 2.0], [2.0, 1.0])}
    left = [(k, 1, "", 1, a) for k, (a, _) in pairs.items()]
    right = [(k, 1, "", 1, b) for k, (_, b) in pairs.items()]
    assert [k for k, _ in run(spark, left, right)] == ["both ways", "far", "longer", "one null number"]


def test_a_hot_key_and_empty_sides(spark):
    hot = [("hot", i, "x", i, None) for i in range(5000)]
    assert run(spark, hot, [("hot", 1, "x", 4999, None)]) == []
    assert run(spark, hot[:3], []) == [("hot", "not_in_right")]
    assert run(spark, [], hot[:3]) == [("hot", "not_in_left")]
    assert run(spark, [], []) == []


def test_instants(spark):
    texts = ["2024-03-01T10:00:00Z", "2024-03-01T15:30:00+05:30", "2024-03-01T05:00:00.000-05:00", "2024-03-01T10:00:00", "x", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", F.expr("timestamp_ntz'2024-03-01 10:00:00'"))
    rows = df.select(iso_micros("t").alias("a"), ntz_micros("n").alias("b")).collect()
    assert [r.a == r.b for r in rows[:4]] == [True] * 4 and [r.a for r in rows[4:]] == [None] * 3


def test_arrays_close_is_symmetric(spark):
    df = spark.createDataFrame([([1.0], [1.0005]), (None, None), ([1.0], None), ([], [])], "a array<float>, b array<float>")
    rows = df.select(arrays_close(F.col("a"), F.col("b"), 0.001).alias("x"), arrays_close(F.col("b"), F.col("a"), 0.001).alias("y")).collect()
    assert [(r.x, r.y) for r in rows] == [(True, True), (True, True), (False, False), (True, True)]
