import math
import random

import pytest

from plumbline.operators.zonemaps import BloomConfig
from plumbline.plans.expr import UnknownColumn, col
from plumbline.sources.column import Column
from plumbline.sources.store import MetaStore
from plumbline.types import BuildError, Cmp, DataType, Metric, QueryError, SchemaError


def column(name, kind, values):
    return Column(name, kind).from_values(values)


@pytest.fixture(scope="module")
def zoned(spark):
    val = column("val", DataType.Int32, [1, 2, None, 10, 11, 12, None, None, None])
    ts = column("ts", DataType.DateTime, ["2024-01-01", None, "2024-06-01", "2026-01-01", "2026-06-01", "2024-12-31 23:59:59", None, None, None])
    grade = column("grade", DataType.String, ["A", "B", None, "C", "A", "A", None, None, None])
    return MetaStore.from_columns(spark, [val, ts, grade]).with_vectors([[1, 0]] * 9).with_chunk_size(3).build()


@pytest.mark.parametrize(
    ("e", "rows", "evaluated"),
    [
        (col("val").gt(5), [3, 4, 5], 1),
        (col("val").gte(2), [1, 3, 4, 5], 2),
        (col("val").gt(2), [3, 4, 5], 1),
        (col("val").gt(5) & col("ts").lt("2025-01-01"), [5], 1),
        (col("val").neq(1), [1, 3, 4, 5], 2),
        (col("val").eq(12) | col("val").eq(1), [0, 5], 2),
        (col("val").lte(1), [0], 1),
        (col("val").lt(1), [], 0),
        (col("val").eq(1) | col("val").neq(1), list(range(9)), 3),
    ],
)
def test_pruning(zoned, e, rows, evaluated):
    found = zoned.query([1.0, 0.0], Metric.Cosine).meta_filter(e).take(9).collect()
    stats = zoned.last_query_stats()
    assert sorted(found.indices) == rows
    assert (stats.total_chunks, stats.evaluated_chunks, stats.pruned_chunks, stats.vectors_compared) == (3, evaluated, 3 - evaluated, 3 * evaluated)


def test_string_pruning(zoned):
    assert sorted(zoned.query([1.0, 0.0], Metric.Cosine).meta_filter(col("grade").eq("A")).collect().indices) == [0, 4, 5]
    assert zoned.last_query_stats().pruned_chunks >= 1


def test_results(zoned):
    found = zoned.query([1.0, 0.0], Metric.Cosine).take(3).collect()
    assert found.columns == ["grade", "ts", "val"]
    assert (found.column("val"), found.column("grade"), found.column("nothing"), len(found)) == ([1, 2, None], ["A", "B", None], None, 3)
    assert str(found).split("\n")[3] == "| 0     | 1.000000 | A     | 2024-01-01 00:00:00 UTC | 1    |"


def test_errors_wait_for_collect(zoned):
    q = zoned.query([1.0, 0.0], Metric.Cosine).meta_filter(col("nothing").eq(1))
    with pytest.raises(UnknownColumn):
        q.collect()
    assert len(q.meta_filter(col("val").gt(11)).collect()) == 1
    with pytest.raises(QueryError, match="length 3"):
        zoned.query([1.0, 0.0, 0.0], Metric.Cosine).collect()
    with pytest.raises(QueryError, match="No queries"):
        zoned.query_batch([], Metric.Cosine).collect()


def test_build_errors(spark):
    a = column("a", DataType.Int32, [1])
    with pytest.raises(BuildError, match="vectors must be provided to build MetaStore"):
        MetaStore.from_columns(spark, [a]).build()
    with pytest.raises(BuildError, match="column 'a' length 1 does not match vectors length 2"):
        MetaStore.from_columns(spark, [a]).with_vectors([[1], [2]]).build()
    with pytest.raises(BuildError, match="vector dimension cannot be zero"):
        MetaStore.from_columns(spark, [a]).with_vectors([[]]).build()
    with pytest.raises(BuildError, match="vector at index 1 has dim 1, expected 2"):
        MetaStore.from_columns(spark, []).with_vectors([[1, 2], [1]]).build()
    builder = MetaStore.from_schema(spark, [("a", DataType.Int32)])
    with pytest.raises(BuildError, match="unknown column 'b'"):
        builder.with_column("b", a)
    with pytest.raises(BuildError, match="Float32"):
        builder.with_column("a", column("a", DataType.Float32, [1.0]))
    with pytest.raises(SchemaError):
        MetaStore.from_dataframe(spark.sql("select 0L id, array(1f) v, true flag"), "v", "id")
    named = builder.with_columns([("a", column("other", DataType.Int32, [7]))]).with_vectors([[1.0]]).build()
    assert named.query([1.0], Metric.Cosine).collect().column("a") == [7]


def test_empty_and_bare_stores(spark, capsys):
    empty = MetaStore.new(spark, {"a": DataType.Int32})
    assert (empty.n_chunks(), empty.build_stats(), empty.last_query_stats()) == (0, None, None)
    assert empty.query([1.0], Metric.Cosine).collect().is_empty()
    empty2 = MetaStore.new(spark, {})
    empty2.print_last_stats()
    assert capsys.readouterr().out == "(no build stats)\n(no query stats)\n"
    assert MetaStore.from_columns(spark, []).with_vectors([]).build().n_chunks() == 0
    bare = MetaStore.from_columns(spark, []).with_vectors([[1], [2], [3]]).with_chunk_size(2).build()
    assert len(bare.query([1.0], Metric.DotProduct).collect()) == 3
    assert bare.last_query_stats().vectors_compared == 3


def test_batches_and_thresholds(spark):
    m = MetaStore.from_columns(spark, []).with_vectors([[1, 0], [0, 1], [-1, 0]]).with_chunk_size(2).build()
    found = m.query_batch([[1, 0], [0, 1]], Metric.Cosine).vec_filter(0.5, Cmp.Gt).take(5).collect()
    assert (found.indices, found.scores) == ([0, 1], [1.0, 1.0])
    assert m.last_query_stats().vectors_compared == 6
    assert m.query([1.0, 0.0], Metric.Euclidean).collect().scores == [0.0, 2.0, 4.0]


def test_results_do_not_depend_on_chunks_and_blooms(spark):
    r = random.Random(5)
    n = 40
    cols = [
        column("i", DataType.Int64, [r.choice([None, *range(9)]) for _ in range(n)]),
        column("f", DataType.Float64, [r.choice([None, math.nan, 0.5, 1.5, -3.0]) for _ in range(n)]),
        column("s", DataType.String, [r.choice([None, "", "a", "b"]) for _ in range(n)]),
    ]
    vectors = [[r.random(), r.random()] for _ in range(n)]
    e = (col("i").gte(4) & col("f").lt(1.0)) | col("s").eq("a") | col("f").gt(1.0)
    found = []
    for size, config in ((1, lambda b: b.with_bloom_bits(1)), (7, lambda b: b.with_bloom_fpr(0.9)), (1000, lambda b: b)):
        m = config(MetaStore.from_columns(spark, cols).with_vectors(vectors).with_chunk_size(size)).build()
        found.append(m.query([1.0, 0.3], Metric.DotProduct).meta_filter(e).take(30).collect())
    assert str(found[0]) == str(found[1]) == str(found[2])


def test_bloom_config():
    assert (BloomConfig.of_fpr(5).fpr, BloomConfig.of_fpr(0).fpr, BloomConfig.of_fpr(math.nan).fpr, BloomConfig.of_bits(3).bits) == (0.5, 0.01, 0.01, 64)


def test_dataframe_and_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "array(cast(id as float), 1f) as v", "timestamp'2024-01-01 10:00:00' as t", "id % 7 as k")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    m = MetaStore.from_dataframe(spark.read.parquet(str(tmp_path / "d")), "v", "id", chunk_size=100)
    found = m.query([1.0, 0.0], Metric.DotProduct).meta_filter(col("k").eq(3) & col("t").eq("2024-01-01 10:00:00")).take(2).collect()
    assert found.indices == [997, 990]
    assert m.head_text(1).startswith("MetaStore • rows=1000 • chunks=10 • chunk_size=100\n")


def test_streaming(spark, tmp_path):
    from plumbline.streaming.search import standing_query

    df = spark.createDataFrame([(0, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [1.0, 0.0], 1)], "id long, v array<float>, k int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = standing_query(stream, "v", "id", [[1.0, 0.0]], Metric.Cosine, 0.5, Cmp.Gt, col("k").gt(2))
    q = found.writeStream.format("memory").queryName("standing").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [tuple(r) for r in spark.sql("select row_id, k, score from standing").collect()] == [(0, 5, 1.0)]


def test_wide_characters():
    from plumbline.display import table

    assert len({len(x) for x in table(["a"], [["é"], ["é"]]).split("\n")[:3]}) == 1
    assert table(["a"], [["日本"]]).split("\n")[0] == "+------+"


def test_columns_by_name(spark):
    schema = [("a", DataType.Int32)]
    store = MetaStore.from_schema(spark, schema).with_column("a", Column("a", DataType.Int32).from_values([5, None])).with_vectors([[1.0], [2.0]]).build()
    assert list(store.columns) == ["a"]
    assert sorted(map(tuple, store.columns["a"].collect())) == [(0, 5), (1, None)]
    store.close()
    assert store.query([1.0], Metric.DotProduct).collect().indices == [1, 0]


def test_a_row_of_another_dimension_fails(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "id long, v array<float>").coalesce(1)
    for store in (MetaStore.from_dataframe(df, "v", "id"),):
        with pytest.raises(Exception, match="does not match expected dimension"):
            store.query([1.0, 2.0], Metric.Cosine).collect()


def test_no_take_sorts_by_ranges(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, v array<float>")
    plan = MetaStore.from_dataframe(df, "v", "id").query([1.0, 2.0], Metric.Euclidean).dataframe()._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "TakeOrdered" not in plan


def test_stored_norms(spark, zoned, tmp_path):
    path = str(tmp_path / "zoned")
    zoned.save(path)
    kept = MetaStore.from_dataframe(spark.read.parquet(path), "vec", "row_id", inv_norm="inv_norm", chunk_size=zoned.chunk_size)
    assert kept.schema == zoned.schema
    both = [s.query([0.3, 0.7], Metric.Cosine).meta_filter(col("grade").eq("A")).take(9).collect() for s in (zoned, kept)]
    assert both[0].indices == both[1].indices and len(both[0].indices) > 0
    with pytest.raises(SchemaError):
        MetaStore.from_dataframe(spark.read.parquet(path), "vec", "row_id")
