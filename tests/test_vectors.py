import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.plans.query import SearchResult, VectorQuery
from plumbline.sources.vectors import VectorStore
from plumbline.types import Cmp, EngineError, Metric, QueryError

PLANE = [[1, 0], [0.8, 0.6], [0.6, 0.8], [0, 1], [-0.6, 0.8]]


def made(spark, vectors):
    s = VectorStore(spark, len(vectors[0]))
    s.add_vectors(vectors)
    return s


def scores(results):
    return [round(r.score, 5) for r in results]


@pytest.fixture(scope="module")
def plane(spark):
    return made(spark, PLANE)


@pytest.mark.parametrize("arrow", [False, True])
def test_ranking(plane, arrow):
    q = lambda m: plane.query([1.0, 0.0], m).with_arrow_scorer(arrow)
    assert scores(q(Metric.Cosine).take(4).collect()) == [1.0, 0.8, 0.6, 0.0]
    assert scores(q(Metric.DotProduct).take_min(2).collect()) == [-0.6, 0.0]
    assert scores(q(Metric.Euclidean).take(3).collect()) == [0.0, 0.4, 0.8]
    assert [r.index for r in q(Metric.Euclidean).take_max(2).collect()] == [4, 3]


@pytest.mark.parametrize(("cmp", "t", "n"), [(Cmp.Gt, 0.7, 2), (Cmp.Gte, 0.6, 3), (Cmp.Lt, 0.5, 2), (Cmp.Lte, 0.0, 2), (Cmp.Eq, 1.0, 1), (Cmp.Gt, 1.5, 0)])
def test_score_filters(plane, cmp, t, n):
    assert len(plane.query([1.0, 0.0], Metric.Cosine).filter(t, cmp).collect()) == n


def test_counts_and_order(plane):
    q = lambda: plane.query([1.0, 0.0], Metric.Euclidean)
    assert len(q().take(0).collect()) == 0
    assert len(q().take(10).collect()) == 5
    assert scores(q().collect())[0] == max(scores(q().collect()))  # without take the farthest come first
    assert scores(q().take_max(2).take(1).collect()) == scores(q().take_max(1).collect())
    assert scores(q().take(2).take_min(1).collect()) == [0.0]
    before = VectorQuery().take(1).with_metric(Metric.Euclidean).with_vector_store(plane).with_query_vectors([1.0, 0.0])
    assert scores(before.collect()) == scores(q().take_max(1).collect())


def test_ties_by_row(spark):
    s = made(spark, [[0, 1], [1, 0], [0, -1], [1, 0]])
    assert [r.index for r in s.query([0.0, 0.0], Metric.Euclidean).take(4).collect()] == [0, 1, 2, 3]


def test_batch_is_one_list(spark):
    s = made(spark, [[1, 0], [0, 1], [-1, 0]])
    found = s.query([[1.0, 0.0], [0.0, 1.0]], Metric.Cosine).take(2).collect()
    assert [(r.index, r.score) for r in found] == [(0, 1.0), (1, 1.0)]
    assert len(s.query([[1.0, 0.0], [0.0, 1.0]], Metric.Cosine).collect()) == 3  # as many as rows


def test_row_masks(plane, spark):
    q = lambda m: sorted(r.index for r in plane.query([1.0, 0.0], Metric.Cosine).with_row_mask(m).collect())
    assert q([False, True, False]) == [1, 3, 4]
    assert q(spark.createDataFrame([(0, False), (4, False), (2, True)], "row_id long, keep boolean")) == [1, 2, 3]


def test_errors(spark, plane):
    for q, text in (
        (VectorQuery(), "Query vectors or their norms are not set"),
        (VectorQuery().with_query_vectors([1.0]), "Search metric is not set"),
        (VectorQuery().with_query_vectors([1.0]).with_metric(Metric.Cosine), "Vector store is not set"),
        (plane.query([], Metric.Cosine), "No queries provided"),
        (plane.query([1.0, 2.0, 3.0], Metric.Cosine), "Query vector length 3 does not match expected dimension 2"),
        (plane.query([[1.0, 2.0], [1.0]], Metric.Cosine), "Query vector length 1"),
        (plane.query([1.0, 0.0], Metric.Cosine).filter(math.nan, Cmp.Gt), "NaN"),
    ):
        with pytest.raises(QueryError, match=text):
            q.collect()
    s = made(spark, [[1.0, 2.0]])
    with pytest.raises(EngineError, match="Input vector length 1 does not match expected dimension 2"):
        s.add_vectors([[1, 2], [1]])
    assert len(s) == 1


def test_zero_and_nan_vectors(spark):
    s = made(spark, [[0, 0], [1, 1], [math.nan, 1]])
    assert scores(s.query([0.0, 0.0], Metric.Cosine).collect()) == [0.0, 0.0]
    assert [r.index for r in s.query([1.0, 1.0], Metric.DotProduct).collect()] == [1, 0]


def test_empty_store(spark):
    s = VectorStore(spark, 3)
    assert s.is_empty() and s.query([1.0, 0.0, 0.0], Metric.Cosine).take(5).collect() == []


def test_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(V.dot_product(a, b), V.euclidean_distance_squared(a, b), V.inverse_norm(b), V.cosine_similarity(a, b, F.lit(1.0), F.lit(0.5))).first()
    assert tuple(row) == (11.0, 8.0, 0.2, 5.5)
    with pytest.raises(Exception, match="different length"):
        df.select(V.dot_product(a, F.array(F.lit(1.0)))).collect()


def test_shown():
    assert str(SearchResult(3, 0.5)) == "#3 score=0.500000"


def test_plan(plane, capsys):
    plane.query([1.0, 0.0], Metric.Cosine).take(2).dataframe().explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_stored_norms(spark, plane, tmp_path):
    path = str(tmp_path / "plane")
    plane.save(path)
    kept = VectorStore.from_dataframe(spark.read.parquet(path), "vec", "row_id", inv_norm="inv_norm")
    both = [s.query([1.0, 0.5], Metric.Cosine).take(4).collect() for s in (plane, kept)]
    assert [(r.index, r.score) for r in both[0]] == [(r.index, r.score) for r in both[1]]
    plans = [s.rows().select("inv_norm")._jdf.queryExecution().optimizedPlan().toString().lower() for s in (plane, kept)]
    assert ["sqrt" in p for p in plans] == [True, False]
