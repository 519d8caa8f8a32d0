"""Vector metrics as column expressions, and as an Arrow function for large scans.

All arithmetic is in double precision. Vectors of unequal length raise an error instead of giving null.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.types import Metric


def vector(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def _fold(a: Column, b: Column, term) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).when(a.isNull() | b.isNull(), None).otherwise(F.raise_error(F.lit("vectors of different length")).cast("double"))


def dot_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def euclidean_distance_squared(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def inverse_norm(a: Column) -> Column:
    """One over the Euclidean norm; 0 for a zero vector, whose cosine with anything is then 0."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, 0.0).otherwise(1 / norm)


def cosine_similarity(a: Column, b: Column, inverse_a: Column, inverse_b: Column) -> Column:
    """inverse_a, inverse_b: what inverse_norm gives."""
    return dot_product(a, b) * inverse_a * inverse_b


def score(metric: Metric, a: Column, b: Column, inverse_a: Column, inverse_b: Column) -> Column:
    if metric is Metric.Cosine:
        return cosine_similarity(a, b, inverse_a, inverse_b)
    return dot_product(a, b) if metric is Metric.DotProduct else euclidean_distance_squared(a, b)


def arrow_scorer(metric: Metric, queries: Sequence[Sequence[float]]):
    """A pandas function (vector, inverse norm) -> array of scores, one for each query: a matrix product for each Arrow batch."""
    q = np.array(queries, np.float64)
    lengths = np.sqrt((q * q).sum(axis=1))
    inverse_q = np.divide(1.0, lengths, out=np.zeros_like(lengths), where=lengths != 0)
    name = metric.value

    @F.pandas_udf("array<double>")
    def scores(vectors: pd.Series, inverse: pd.Series) -> pd.Series:
        m = np.array(vectors.tolist(), np.float64).reshape(len(vectors), q.shape[1])
        if name == "euclidean":
            out = np.stack([((m - one) ** 2).sum(axis=1) for one in q], axis=1)
        else:
            out = m @ q.T
            if name == "cosine":
                out = out * inverse.to_numpy()[:, None] * inverse_q
        return pd.Series(list(out))

    return scores
