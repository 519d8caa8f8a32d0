"""A store of vectors alone. Rows are numbered in the order in which they came."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vectors as V
from plumbline.plans.query import VectorQuery
from plumbline.types import EngineError, Metric, SchemaError

ROWS = T.StructType([T.StructField("row_id", T.LongType(), False), T.StructField("vec", T.ArrayType(T.FloatType(), False), False)])


def prepared(df: DataFrame, row_id: str, vec: str, extra: Sequence[str] = (), dim: int | None = None, inv_norm: str | None = None) -> DataFrame:
    """row_id, vec (single precision), inv_norm and extra columns of df. With dim, a row of another dimension fails the query that reads it. inv_norm names a column
    that has the inverse norms already; else each query that needs them works them out."""
    kind = df.schema[vec].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        raise SchemaError(f"column '{vec}' is not an array of floats")
    v = F.col(f"`{vec}`").cast("array<float>")
    if dim is not None:
        wrong = F.concat(F.lit("Input vector length "), F.size(v).cast("string"), F.lit(f" does not match expected dimension {dim}"))
        v = F.when(v.isNull() | (F.size(v) == dim), v).otherwise(F.raise_error(wrong).cast("array<float>"))
    norm = V.inverse_norm(v) if inv_norm is None else F.col(f"`{inv_norm}`").cast("double")
    return df.select(F.col(f"`{row_id}`").cast("long").alias("row_id"), v.alias("vec"), norm.alias("inv_norm"), *(F.col(f"`{c}`") for c in extra))


class VectorStore:
    def __init__(self, spark: SparkSession, dim: int) -> None:
        self.spark, self.dim = spark, dim
        self._table: DataFrame | None = None
        self._norm: str | None = None
        self._added: list[list[float]] = []

    @classmethod
    def from_dataframe(cls, df: DataFrame, vec: str, row_id: str, dim: int | None = None, inv_norm: str | None = None) -> VectorStore:
        """A store over a DataFrame whose column row_id numbers the rows; dim is taken from its first row by default. inv_norm names a column of stored inverse
        norms, such as `save` writes."""
        if dim is None:
            first = df.select(F.size(vec).alias("n")).first()
            dim = first["n"] if first else 0
        store = cls(df.sparkSession, dim)
        store._norm = inv_norm and "inv_norm"
        store._table = df.select(F.col(row_id).alias("row_id"), F.col(vec).alias("vec"), *([F.col(inv_norm).alias("inv_norm")] if inv_norm else []))
        return store

    def add_vector(self, vector: Sequence[float]) -> None:
        self.add_vectors([vector])

    def add_vectors(self, vectors: Iterable[Sequence[float]]) -> None:
        """Append all vectors, or none if one has another dimension."""
        if self._table is not None:
            raise EngineError("a store over a DataFrame can't be appended to")
        new = [list(map(float, v)) for v in vectors]
        for v in new:
            if len(v) != self.dim:
                raise EngineError(f"Input vector length {len(v)} does not match expected dimension {self.dim}")
        self._added += new

    def __len__(self) -> int:
        return len(self._added) if self._table is None else self._table.count()

    def is_empty(self) -> bool:
        return not self._added if self._table is None else self._table.isEmpty()

    def rows(self) -> DataFrame:
        """row_id, vec, inv_norm."""
        table = self._table if self._table is not None else self.spark.createDataFrame(list(enumerate(self._added)), ROWS)
        return prepared(table, "row_id", "vec", dim=self.dim if self._table is not None else None, inv_norm=self._norm)

    def save(self, path: str) -> None:
        """Write row_id, vec and inv_norm as Parquet, sorted by row_id; read with inv_norm="inv_norm", norms aren't worked out again."""
        self.rows().orderBy("row_id").write.parquet(path)

    def query(self, queries: Sequence, metric: Metric) -> VectorQuery:
        return VectorQuery().with_vector_store(self).with_query_vectors(queries).with_metric(metric)
