"""Column types, metrics, comparisons and errors."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class DataType(Enum):
    Int32 = T.IntegerType()
    Int64 = T.LongType()
    Float32 = T.FloatType()
    Float64 = T.DoubleType()
    String = T.StringType()
    DateTime = T.TimestampNTZType()

    @classmethod
    def of(cls, spark_type: T.DataType, name: str) -> DataType:
        """The type of a DataFrame's column; a zoned timestamp counts as DateTime, and other types are refused."""
        if isinstance(spark_type, T.TimestampType):
            return cls.DateTime
        for member in cls:
            if member.value == spark_type:
                return member
        raise SchemaError(f"column '{name}' has the unsupported type {spark_type.simpleString()}")

    @property
    def is_integer(self) -> bool:
        return self in (DataType.Int32, DataType.Int64)

    @property
    def is_float(self) -> bool:
        return self in (DataType.Float32, DataType.Float64)


class Metric(Enum):
    Cosine = "cosine"
    Euclidean = "euclidean"  # squared
    DotProduct = "dot"


class Cmp(Enum):
    """Comparisons of scores."""

    Lt = "<"
    Gt = ">"
    Lte = "<="
    Gte = ">="
    Eq = "="


class TakeType(Enum):
    Min = "min"
    Max = "max"

    @classmethod
    def default(cls, metric: Metric) -> TakeType:
        return cls.Min if metric is Metric.Euclidean else cls.Max


class EngineError(Exception):
    """Any error that this package raises on purpose."""


class SchemaError(EngineError):
    pass


class BuildError(EngineError):
    pass


class QueryError(EngineError):
    pass


class ColumnError(EngineError):
    pass


class ColumnTypeMismatch(ColumnError):
    pass


class ColumnParseError(ColumnError):
    pass
