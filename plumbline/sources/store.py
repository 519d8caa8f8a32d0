"""Metadata stores: vectors with typed columns, cut into chunks with zone maps.

A store is a DataFrame of row_id, vec, inv_norm and the columns; a row's chunk is row_id div chunk_size. The zone map is made by one aggregation when the
store is built and kept in memory; it has a row for each chunk.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import display
from plumbline.operators import zonemaps
from plumbline.operators.zonemaps import BloomConfig
from plumbline.plans.query import QueryStats, StoreQuery
from plumbline.sources.column import Column
from plumbline.sources.vectors import prepared
from plumbline.types import BuildError, DataType, Metric, SchemaError

CHUNK_SIZE = 1024
RESERVED = ("row_id", "vec", "inv_norm", "chunk_id", "query_idx", "score", "index")


@dataclass(frozen=True)
class BuildStats:
    n_rows: int
    dim: int
    n_chunks: int
    vectors_ingest_ms: float
    zonemap_build_ms: float
    build_total_ms: float


class StoreBuilder:
    def __init__(self, spark: SparkSession, schema: dict[str, DataType], columns: dict[str, Column] | None = None) -> None:
        self.spark, self.schema, self._columns = spark, dict(schema), dict(columns or {})
        self._vectors: list[list[float]] | None = None
        self._chunk_size, self._bloom = CHUNK_SIZE, BloomConfig()

    def with_column(self, name: str, column: Column) -> StoreBuilder:
        """Set the values of a column of the schema; name counts, not the column's own."""
        if name not in self.schema:
            raise BuildError(f"unknown column '{name}' not present in schema")
        if column.dtype is not self.schema[name]:
            raise BuildError(f"dtype mismatch for column '{name}': schema {self.schema[name].name}, got {column.dtype.name}")
        self._columns[name] = column
        return self

    def with_columns(self, columns: Sequence[tuple[str, Column]]) -> StoreBuilder:
        for name, column in columns:
            self.with_column(name, column)
        return self

    def with_vectors(self, vectors: Sequence[Sequence[float]]) -> StoreBuilder:
        self._vectors = [list(map(float, v)) for v in vectors]
        return self

    def with_chunk_size(self, n: int) -> StoreBuilder:
        self._chunk_size = max(1, n)
        return self

    def with_bloom_fpr(self, fpr: float) -> StoreBuilder:
        self._bloom = BloomConfig.of_fpr(fpr)
        return self

    def with_bloom_bits(self, bits: int) -> StoreBuilder:
        self._bloom = BloomConfig.of_bits(bits)
        return self

    def build(self) -> MetaStore:
        if self._vectors is None:
            raise BuildError("vectors must be provided to build MetaStore")
        n = len(self._vectors)
        for name in self.schema:
            if name not in self._columns:
                raise BuildError(f"missing column '{name}' in builder columns")
            if len(self._columns[name]) != n:
                raise BuildError(f"column '{name}' length {len(self._columns[name])} does not match vectors length {n}")
        dim = len(self._vectors[0]) if n else 0
        if n and not dim:
            raise BuildError("vector dimension cannot be zero")
        for i, v in enumerate(self._vectors):
            if len(v) != dim:
                raise BuildError(f"vector at index {i} has dim {len(v)}, expected {dim}")
        fields = [T.StructField("row_id", T.LongType(), False), T.StructField("vec", T.ArrayType(T.FloatType(), False), False)]
        fields += [T.StructField(c, k.value, True) for c, k in self.schema.items()]
        values = zip(range(n), self._vectors, *(self._columns[c].spark_values() for c in self.schema), strict=True)
        table = self.spark.createDataFrame(list(values), T.StructType(fields))
        return MetaStore(table, self.schema, dim, self._chunk_size, self._bloom, stats=True)


class MetaStore:
    def __init__(self, table: DataFrame, schema: dict[str, DataType], dim: int, chunk_size: int, bloom: BloomConfig, *, row_id: str = "row_id", vec: str = "vec", inv_norm: str | None = None, stats: bool) -> None:
        for name in schema:
            if name in RESERVED or "`" in name:
                raise SchemaError(f"a column can't be named '{name}'")
        began = time.perf_counter()
        self.spark, self.schema, self.dim, self.chunk_size, self.bloom = table.sparkSession, dict(schema), dim, chunk_size, bloom
        rows = prepared(table, row_id, vec, list(schema), dim, inv_norm)
        self.rows = rows.withColumn("chunk_id", F.floor(F.col("row_id") / chunk_size).cast("long"))
        ingested = time.perf_counter()
        self.zones = zonemaps.build(self.rows, self.schema, bloom, chunk_size).persist()
        self._n_chunks, self._n_rows = self.zones.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        done = time.perf_counter()
        self._build_stats = BuildStats(self._n_rows, dim, self._n_chunks, (ingested - began) * 1e3, (done - ingested) * 1e3, (done - began) * 1e3) if stats else None
        self._last: QueryStats | None = None

    @classmethod
    def new(cls, spark: SparkSession, schema: dict[str, DataType]) -> MetaStore:
        """A store that stays empty."""
        fields = [T.StructField("row_id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType())), *(T.StructField(c, k.value) for c, k in schema.items())]
        return cls(spark.createDataFrame([], T.StructType(fields)), schema, 0, CHUNK_SIZE, BloomConfig(), stats=False)

    @staticmethod
    def from_columns(spark: SparkSession, columns: Sequence[Column]) -> StoreBuilder:
        """A builder whose schema is that of columns; of two with the same name the last counts."""
        named = {c.name: c for c in columns}
        return StoreBuilder(spark, {c.name: c.dtype for c in named.values()}, named)

    @staticmethod
    def from_schema(spark: SparkSession, schema: Sequence[tuple[str, DataType]]) -> StoreBuilder:
        return StoreBuilder(spark, dict(schema), {name: Column(name, kind) for name, kind in schema})

    @classmethod
    def from_dataframe(cls, df: DataFrame, vec: str, row_id: str, columns: Sequence[str] | None = None, *, chunk_size: int = CHUNK_SIZE, bloom: BloomConfig | None = None, inv_norm: str | None = None) -> MetaStore:
        """A store over a DataFrame, for instance of Parquet files: row_id numbers its rows from 0, vec has the vectors, other columns (all, or those named) are
        metadata. Files that are sorted by row_id are read only where chunks stay. inv_norm names a column of stored inverse norms; `save` writes
        files of both kinds."""
        names = [c for c in df.columns if c not in (vec, row_id, inv_norm)] if columns is None else list(columns)
        schema = {c: DataType.of(df.schema[c].dataType, c) for c in names}
        zoned = {c: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz")) for c in names if isinstance(df.schema[c].dataType, T.TimestampType)}
        df = df.withColumns(zoned) if zoned else df
        first = df.select(F.size(vec).alias("n")).first()
        return cls(df, schema, first["n"] if first else 0, max(1, chunk_size), bloom or BloomConfig(), row_id=row_id, vec=vec, inv_norm=inv_norm, stats=True)

    @property
    def columns(self) -> dict[str, DataFrame]:
        """For each metadata column its values by row_id."""
        return {name: self.rows.select("row_id", F.col(f"`{name}`")) for name in self.schema}

    def save(self, path: str) -> None:
        """Write row_id, vec, inv_norm and the columns as Parquet, sorted by row_id, to be read with inv_norm="inv_norm"."""
        self.rows.drop("chunk_id").orderBy("row_id").write.parquet(path)

    def close(self) -> None:
        """Let the zone map go from memory; a later query makes it again."""
        self.zones.unpersist()

    def n_chunks(self) -> int:
        return self._n_chunks

    def n_rows(self) -> int:
        return self._n_rows

    def query(self, vector: Sequence[float], metric: Metric) -> StoreQuery:
        return StoreQuery(self, [list(vector)], metric)

    def query_batch(self, vectors: Sequence[Sequence[float]], metric: Metric) -> StoreQuery:
        return StoreQuery(self, [list(v) for v in vectors], metric)

    def build_stats(self) -> BuildStats | None:
        return self._build_stats

    def last_query_stats(self) -> QueryStats | None:
        return self._last

    def head_text(self, n: int = 5) -> str:
        names = sorted(self.schema)
        rows = self.rows.orderBy("row_id").limit(n).select("row_id", *(F.col(f"`{c}`") for c in names)).collect()
        body = [[str(r[0]), *(display.cell(v, self.schema[c]) for c, v in zip(names, r[1:], strict=True))] for r in rows]
        return display.table(["index", *names], body, f"MetaStore • rows={self._n_rows} • chunks={self._n_chunks} • chunk_size={self.chunk_size}")

    def head(self, n: int = 5) -> None:
        print(self.head_text(n))

    def build_stats_text(self) -> str:
        b = self._build_stats
        if b is None:
            return "(no build stats)"
        return display.facts("MetaStore Build Stats", {"rows": b.n_rows, "dimensions": b.dim, "chunks": b.n_chunks, "vector_ingest_ms": b.vectors_ingest_ms, "zonemap_build_ms": b.zonemap_build_ms, "build_total_ms": b.build_total_ms})

    def query_stats_text(self) -> str:
        s = self._last
        if s is None:
            return "(no query stats)"
        return display.facts("Last Meta Query Stats", {"total_chunks": s.total_chunks, "pruned_chunks": s.pruned_chunks, "evaluated_chunks": s.evaluated_chunks, "vectors_compared": s.vectors_compared, "prune_ms": s.prune_ms, "score_ms": s.score_ms, "merge_ms": s.merge_ms, "total_ms": s.total_ms})

    def print_build_stats(self) -> None:
        print(self.build_stats_text())

    def print_last_query_stats(self) -> None:
        print(self.query_stats_text())

    def print_last_stats(self) -> None:
        self.print_build_stats()
        self.print_last_query_stats()
