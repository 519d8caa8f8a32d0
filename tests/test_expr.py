import math

import pytest
from pyspark.sql import functions as F

from plumbline.plans import expr as E
from plumbline.plans.expr import CmpOp, col, lit
from plumbline.types import DataType

SCHEMA = {"age": DataType.Int64, "score": DataType.Float64, "name": DataType.String, "ts": DataType.DateTime, "small": DataType.Int32, "single": DataType.Float32}


def shape(e):
    return [[(f.column, f.op, f.value) for f in c] for c in e.compile(SCHEMA).clauses]


def test_leaves():
    assert shape(col("age").gt(25)) == [[("age", CmpOp.Gt, 25)]]
    assert shape(col("score").gte(80)) == [[("score", CmpOp.Gte, 80.0)]]
    assert shape(col("ts").gte("2023-01-02T03:04:05Z")) == [[("ts", CmpOp.Gte, 1672628645000)]]
    assert len(shape(col("name").eq("Alice") | col("name").eq("Bob"))[0]) == 2


def test_clauses():
    a, b, c, d = (col("age").gt(i) for i in range(4))
    assert sorted(map(len, shape(a & (b | c)))) == [1, 2]
    assert [len(x) for x in shape((a & b) | (c & d))] == [2, 2, 2, 2]


@pytest.mark.parametrize(
    ("e", "error", "text"),
    [
        (lit(25).lt(col("age")), E.InvalidComparison, "column vs literal"),
        (col("age").gt(col("score")), E.InvalidComparison, "column vs literal"),
        (col("name").gt("bob"), E.UnsupportedStringOp, "'name'"),
        (col("name").gt(5), E.UnsupportedStringOp, "'name'"),
        (col("name").eq(5), E.TypeMismatch, "expected String, got literal string"),
        (col("age").eq("x"), E.TypeMismatch, "expected Int64, got literal string"),
        (col("age").gt(25.5), E.TypeMismatch, "got literal float"),
        (col("ts").eq(1700000000000), E.TypeMismatch, "datetime string"),
        (col("ts").eq("noon"), E.TypeMismatch, "datetime string"),
        (col("missing").eq(1), E.UnknownColumn, "Unknown column 'missing'"),
        (col("Age").eq(1), E.UnknownColumn, "Age"),
        (col("age"), E.InvalidExpression, ""),
        (lit(1) & col("age").eq(1), E.InvalidExpression, ""),
        (col("missing").eq(1) | col("age").eq("x"), E.UnknownColumn, "missing"),
    ],
)
def test_errors(e, error, text):
    with pytest.raises(error, match=text):
        e.compile(SCHEMA)


@pytest.mark.parametrize("value", [True, None, 2**63, [1]])
def test_literals_that_are_none(value):
    with pytest.raises(TypeError):
        lit(value)


def test_tautologies():
    bob = col("name").eq("bob") | col("name").neq("bob")
    assert shape(bob & col("age").gt(5)) == [[("age", CmpOp.Gt, 5)]]
    assert shape(bob) == []
    assert len(shape(col("score").eq(math.nan) | col("score").neq(math.nan))) == 1
    assert shape((col("age").eq(1) & col("score").gt(0.0)) | col("age").neq(1)) == [[("score", CmpOp.Gt, 0.0), ("age", CmpOp.Neq, 1)]]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, 5, 1.0, "a", 1, 0.1), (1, None, None, None, None, None), (2, 7, math.nan, "b", -5, math.nan), (3, 9, -2.0, "", 2**31 - 1, 0.25)]
    return spark.createDataFrame(data, "id long, age long, score double, name string, small int, single float").withColumn("ts", F.expr("timestamp_ntz'2024-01-01'"))


@pytest.mark.parametrize(
    ("e", "ids"),
    [
        (col("age").neq(5), [2, 3]),
        (col("score").gt(0.0), [0]),
        (col("score").gte(-2), [0, 3]),
        (col("score").lt(5.0), [0, 3]),
        (col("score").neq(1.0), [2, 3]),
        (col("score").eq(math.nan), []),
        (col("score").neq(math.nan), [0, 2, 3]),
        (col("score").lte(math.inf), [0, 3]),
        (col("single").eq(0.1), [0]),
        (col("single").gt(0.1), [3]),
        (col("small").lt(3_000_000_000), [0, 2, 3]),
        (col("small").gt(-3_000_000_000), [0, 2, 3]),
        (col("name").neq("a"), [2, 3]),
        (col("name").eq(""), [3]),
        (col("ts").lt("2024-01-01 00:00:01"), [0, 1, 2, 3]),
        (col("age").eq(5) | col("age").neq(5), [0, 1, 2, 3]),
    ],
)
def test_rows(rows, e, ids):
    assert sorted(r.id for r in rows.where(e.compile(SCHEMA).to_spark()).collect()) == ids


def test_pushed_down(rows, tmp_path, capsys, spark):
    rows.write.parquet(str(tmp_path / "r"))
    for e, part in (
        (col("single").eq(0.1), "EqualTo(single,0.1)"),
        (col("score").gt(0.0) | col("age").lt(8), "Or(And(GreaterThan(score,0.0)"),
        (col("small").lt(3), "LessThan(small,3)"),
        (col("ts").gte("2024-01-01"), "GreaterThanOrEqual(ts,"),
    ):
        spark.read.parquet(str(tmp_path / "r")).where(e.compile(SCHEMA).to_spark()).explain()
        assert part in capsys.readouterr().out.split("PushedFilters: [")[1].split("]")[0]
