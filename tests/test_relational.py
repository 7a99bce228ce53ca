import pytest

from spindrift.functions.expressions import call, col, lit
from spindrift.operators import relational as R


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(10, "a"), (10, "b"), (12, "c"), (None, "n")], "k long, x string")
    right = spark.createDataFrame([(10, "p"), (10, "q"), (11, "r"), (None, "m")], "k long, y string")
    return left, right


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ("inner", [(10, "a", 10, "p"), (10, "a", 10, "q"), (10, "b", 10, "p"), (10, "b", 10, "q")]),
        ("left", [(10, "a", 10, "p"), (10, "a", 10, "q"), (10, "b", 10, "p"), (10, "b", 10, "q"), (12, "c", None, None), (None, "n", None, None)]),
        ("right", [(10, "a", 10, "p"), (10, "a", 10, "q"), (10, "b", 10, "p"), (10, "b", 10, "q"), (None, None, 11, "r"), (None, None, None, "m")]),
        ("left_semi", [(10, "a"), (10, "b")]),
        ("right_semi", [(10, "p"), (10, "q")]),
        ("left_anti", [(12, "c"), (None, "n")]),
    ],
)
def test_joins(sides, how, want):
    assert rows(R.hash_join(*sides, how, ["K"], ["k"])) == sorted(want, key=repr)


def test_full_join_and_clashing_names(sides):
    joined = R.hash_join(*sides, "full", ["k"], ["k"])
    assert joined.columns == ["k", "x", "k_right", "y"] and joined.count() == 8


def test_nested_loop(sides):
    left, right = sides
    assert R.nested_loop_join(left, right).count() == 16
    assert rows(R.nested_loop_join(left, right, "left", call("lt", col("k"), col("k_right")))) == [(10, "a", 11, "r"), (10, "b", 11, "r"), (12, "c", None, None), (None, "n", None, None)]
    assert R.nested_loop_join(left.limit(0), right, "full").count() == 4


def test_errors(sides):
    with pytest.raises(ValueError, match="no column z"):
        R.hash_join(*sides, "inner", ["z"], ["k"])
    with pytest.raises(ValueError, match="unknown join"):
        R.hash_join(*sides, "asof", ["k"], ["k"])
    with pytest.raises(ValueError, match="unknown aggregate"):
        R.aggregate(sides[0], {"m": ("median", col("k"))})
    with pytest.raises(ValueError, match="no column"):
        R.filter_(sides[0], call("eq", col("nope"), lit(1)))


def test_aggregates(sides, spark):
    left, _ = sides
    functions = {"s": ("sum", col("k")), "s0": ("sum0", col("k")), "n": ("count", None), "nk": ("count", col("k")), "d": ("count_distinct", col("k")), "lo": ("min", col("x")), "hi": ("max", col("x")), "a": ("avg", col("k"))}
    assert rows(R.aggregate(left, functions)) == [(32, 32, 4, 3, 2, "a", "n", 32 / 3)]
    assert rows(R.aggregate(left.limit(0), functions)) == [(None, 0, 0, 0, 0, None, None, None)]
    assert rows(R.group(left, ["k"], {"n": ("count", None)})) == [(10, 2), (12, 1), (None, 1)]
    assert rows(R.group(left, ["k"])) == [(10,), (12,), (None,)]
    assert R.group(left.limit(0), ["k"], {"n": ("count", None)}).count() == 0


def test_sort_project(sides):
    left, _ = sides
    assert [r.k for r in R.sort(left, [("k", "DESC"), ("x", "ASC")]).collect()] == [12, 10, 10, None]
    assert [r.k for r in R.sort(left, [("k", "ASC"), ("x", "ASC")]).collect()] == [10, 10, 12, None]
    assert [r.x for r in R.limit_sort(left, 2, [("k", "ASC"), ("x", "DESC")]).collect()] == ["b", "a"]
    assert R.project(left, [("k", "key")], {"two": call("multiply", col("k"), lit(2))}).columns == ["key", "two"]
    assert rows(R.scan(left, call("eq", col("k"), lit(12)), ["x"])) == [("c",)]
