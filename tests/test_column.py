import pytest

from plumbline.functions import datetimes
from plumbline.sources.column import Column, ColumnValue
from plumbline.types import ColumnParseError, ColumnTypeMismatch, DataType


def made(kind, *values, name="c"):
    return Column(name, kind).from_values(values)


def test_nulls_and_readers():
    c = made(DataType.Int32, 42, 100, None)
    assert (len(c), c.null_mask(), c.i32_values(), c.i64_values(), c.is_empty()) == (3, [False, False, True], [42, 100, None], None, False)
    assert made(DataType.String, "a", None).string_values() == ["a", None]
    assert made(DataType.Float64, 1.5).f64_values() == [1.5]
    assert made(DataType.Float32, 0.1).f32_values() != [0.1]  # single precision
    assert Column("e", DataType.Int64).is_empty()


@pytest.mark.parametrize(
    ("kind", "value"),
    [(DataType.Int32, "x"), (DataType.Int32, 1.0), (DataType.Int32, 2**31), (DataType.Int64, True), (DataType.Float64, 1), (DataType.Float32, 1e300), (DataType.String, 5), (DataType.DateTime, 1700000000000)],
)
def test_nothing_is_widened(kind, value):
    with pytest.raises(ColumnTypeMismatch):
        Column("c", kind).push(value)


def test_bulk_append_is_atomic():
    c = made(DataType.Int32, 1)
    with pytest.raises(ColumnTypeMismatch):
        c.from_values([2, "x"])
    assert c.values() == [1]


def test_datetimes():
    c = made(DataType.DateTime, "2024-01-15T10:30:00Z", "2024-02-20 15:45:30", "2024-03-10", None, ColumnValue.datetime(5), ColumnValue.datetime_str("2024-03-10"))
    assert c.datetime_values()[:3] == [1705314600000, 1708443930000, 1710028800000]
    assert c.datetime_values()[3:] == [None, 5, 1710028800000]
    us = Column("d", DataType.DateTime).with_datetime_fmt("%m/%d/%Y").from_values(["01/15/2024", None])
    assert us.values() == [1705276800000, None]
    for column, text in ((Column("b", DataType.DateTime), "invalid-date-format"), (Column("b", DataType.DateTime).with_datetime_fmt("%Y-%m-%d"), "01/15/2024")):
        with pytest.raises(ColumnParseError):
            column.push(text)


@pytest.mark.parametrize("text", ["2024-01-01T00:00:00", "2024", "12:00", "2024-1-5", "2024-02-30", "", "2024-01-01T00:00:00+0200"])
def test_formats_are_strict(text):
    assert datetimes.parse(text) is None


def test_offsets_and_fractions():
    assert datetimes.parse("2024-01-01T01:00:00.123987+01:00") == datetimes.parse("2024-01-01T00:00:00Z") + 123


def test_parse_column_agrees(spark):
    from pyspark.sql import functions as F

    texts = ["2024-01-15T10:30:00Z", "2024-02-20 15:45:30", "2024-03-10", "2024-03-10T10:00:00", "2024", "2024-01-15T10:30:00.123456+02:30", "2024-01-15t10:30:00-00:30", "2024-02-30", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", datetimes.parse_column(F.col("t")).alias("p")).collect()
    for r in rows:
        millis = None if r.t is None else datetimes.parse(r.t)
        assert r.p == (None if millis is None else datetimes.from_millis(millis)), r.t


def test_head():
    text = made(DataType.DateTime, "2024-01-01", None, "2024-01-03", name="d").head_text(2)
    assert text.split("\n") == ["Column: d (DateTime)", "  [0]: 2024-01-01 00:00:00 UTC (1704067200000)", "  [1]: NULL", "  ... (1 more rows)"]
