"""An extension: a standing query over a stream of vectors. The reference semantics of filters and scores apply to each row as it comes; there is
no ranking, which has no end on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from plumbline.operators import ranking
from plumbline.plans.expr import Expr
from plumbline.sources.vectors import prepared
from plumbline.types import Cmp, DataType, Metric


def standing_query(stream: DataFrame, vec: str, row_id: str, queries: Sequence[Sequence[float]], metric: Metric, threshold: float, cmp: Cmp, where: Expr | None = None) -> DataFrame:
    """Rows of a (streaming) DataFrame that satisfy `where` and whose score with some query compares so with the threshold: row_id, the columns, query_idx, score."""
    names = [c for c in stream.columns if c not in (vec, row_id)]
    rows = prepared(stream, row_id, vec, names)
    if where is not None:
        schema = {c: DataType.of(stream.schema[c].dataType, c) for c in names}
        rows = rows.where(where.compile(schema).to_spark())
    return ranking.score_filter(ranking.scored(rows, queries, metric), threshold, cmp).drop("vec", "inv_norm")
