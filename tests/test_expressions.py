import datetime

import pytest

from spindrift.functions.expressions import call, canonical, col, columns_of, leaves, lit, to_column
from spindrift.functions.types import schema_of, spark_type

A = [(1, 2.5, "PROMO X", True, datetime.date(2020, 2, 29)), (None, None, None, None, None), (-7, 0.0, "a_b%", False, datetime.date(1999, 12, 31))]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(A, "i long, d double, s string, b boolean, t date")


@pytest.mark.parametrize(
    ("node", "want"),
    [
        (call("add", col("i"), lit(1)), [2, None, -6]),
        (call("subtract", col("d"), lit(0.5)), [2.0, None, -0.5]),
        (call("multiply", col("i"), col("d")), [2.5, None, 0.0]),
        (call("divide", lit(7), lit(2)), [3, 3, 3]),
        (call("divide", col("i"), col("d")), [0.4, None, None]),
        (call("date_add", lit("2020-01-31", "date"), lit(1, "interval_month")), [datetime.date(2020, 2, 29)] * 3),
        (call("subtract", lit("2020-01-31", "date"), lit(31, "interval_day")), [datetime.date(2019, 12, 31)] * 3),
        (call("extract", col("t"), unit="month"), [2, None, 12]),
        (call("and", col("b"), call("gt", col("i"), lit(0))), [True, None, False]),
        (call("or", col("b"), call("is_null", col("i"))), [True, True, False]),
        (call("not", col("b")), [False, None, True]),
        (call("ne", col("i"), lit(1)), [False, None, True]),
        (call("ge", col("d"), lit(2.5)), [True, None, False]),
        (call("between", col("i"), lit(-7), lit(0)), [False, None, True]),
        (call("like", col("s"), lit("PROMO%")), [True, None, False]),
        (call("in", col("i"), values=[1, 5]), [True, None, False]),
        (call("if", col("b"), lit("y"), call("is_null", col("b")), lit("n"), lit("z")), ["y", "n", "z"]),
        (call("is_true", col("b")), [True, False, False]),
        (call("is_not_false", col("b")), [True, True, False]),
        (call("substr", col("s"), lit(1), lit(3)), ["PRO", None, "a_b"]),
        (call("cast", col("d"), to="int64"), [2, None, 0]),
        (call("cast", lit("12"), to="int32"), [12, 12, 12]),
    ],
)
def test_nodes(df, node, want):
    got = [r[0] for r in df.select(to_column(node)).collect()]
    assert [v.date() if isinstance(v, datetime.datetime) else v for v in got] == want


def test_trees():
    tree = call("and", call("lt", lit(5), col("X")), call("between", col("y"), lit(1), lit(2)))
    assert columns_of(tree) == {"x", "y"} and leaves(tree) == 2
    assert canonical(tree)["args"][0] == call("gt", col("x"), lit(5))
    with pytest.raises(ValueError, match="unknown expression"):
        to_column({"op": "modulo", "args": []})


def test_types():
    assert spark_type("UTF8").simpleString() == "string" and spark_type("int").simpleString() == "int"
    assert schema_of([{"name": "A", "type": "date"}]).simpleString() == "struct<a:date>"
    with pytest.raises(ValueError, match="unknown column type"):
        spark_type("decimal")
