"""Scoring and ranking: filter, score, drop NaN, filter by score, order, limit.

Spark plans the order and limit as one TakeOrderedAndProject: each task keeps its best k rows and only those are merged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.plans.expr import compare
from plumbline.types import Cmp, Metric, QueryError, TakeType


def scored(rows: DataFrame, queries: Sequence[Sequence[float]], metric: Metric, arrow: bool = False) -> DataFrame:
    """rows (with row_id, vec, inv_norm) once for each query, with query_idx and score (float). Scores that are NaN are left out.

    A row's scores for all queries are made together, so that its vector isn't copied for each.
    """
    if arrow:
        scores = V.arrow_scorer(metric, queries)(F.col("vec"), F.col("inv_norm"))
        rows = rows.select("*", F.posexplode(scores).alias("query_idx", "score"))
    elif len(queries) == 1:
        q = V.vector(queries[0])
        rows = rows.withColumns({"query_idx": F.lit(0), "score": V.score(metric, F.col("vec"), q, F.col("inv_norm"), F.lit(_inverse(queries[0])))})
    else:
        qs = F.array(*[F.struct(V.vector(q).alias("q"), F.lit(_inverse(q)).alias("inverse")) for q in queries])
        each = F.transform(qs, lambda x: V.score(metric, F.col("vec"), x["q"], F.col("inv_norm"), x["inverse"]))
        rows = rows.select("*", F.posexplode(each).alias("query_idx", "score"))
    return rows.withColumn("score", F.col("score").cast("float")).where(~F.isnan("score"))


def _inverse(q: Sequence[float]) -> float:
    norm = math.sqrt(sum(float(x) * float(x) for x in q))
    return 1 / norm if norm else 0.0


def score_filter(rows: DataFrame, threshold: float, cmp: Cmp) -> DataFrame:
    """Rows whose score compares so with the threshold, both single precision."""
    if math.isnan(threshold):
        raise QueryError("a score threshold can't be NaN")
    return rows.where(compare(F.col("score"), cmp.value, F.lit(float(threshold)).cast("float")))


#: Spark's limits are 32-bit numbers.
MOST = 2**31 - 1


def top(rows: DataFrame, k: int | None, take: TakeType) -> DataFrame:
    """The k best rows in order, or all of them without k: ties by row_id, then query. All rows are sorted by ranges, over all tasks."""
    score = F.col("score").asc() if take is TakeType.Min else F.col("score").desc()
    ordered = rows.orderBy(score, F.col("row_id").asc(), F.col("query_idx").asc())
    return ordered if k is None else ordered.limit(min(k, MOST))
