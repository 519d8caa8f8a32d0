"""Lazy queries over stores. Nothing runs, and no error is raised, before collect() or dataframe()."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import display
from plumbline.operators import ranking, zonemaps
from plumbline.plans.expr import CompiledFilter, Expr, ExprError
from plumbline.types import Cmp, DataType, Metric, QueryError, TakeType

if TYPE_CHECKING:
    from plumbline.sources.store import MetaStore
    from plumbline.sources.vectors import VectorStore

#: Runs of neighbouring chunks up to which a pruned scan is told by ranges of row_id, which files' statistics can use; beyond, by a semi join.
MAX_RUNS = 256


def batch(queries: Sequence) -> list[list[float]]:
    """One vector or many, as many."""
    queries = list(queries)
    return [list(map(float, q)) for q in queries] if queries and not isinstance(queries[0], (int, float)) and hasattr(queries[0], "__len__") else [list(map(float, queries))] if queries else []


@dataclass(frozen=True)
class SearchResult:
    index: int
    score: float

    def __str__(self) -> str:
        return f"#{self.index} score={self.score:.6f}"


def check_dimension(queries: list[list[float]], dim: int) -> None:
    if not queries:
        raise QueryError("No queries provided")
    for q in queries:
        if len(q) != dim:
            raise QueryError(f"Query vector length {len(q)} does not match expected dimension {dim}")


class VectorQuery:
    """A query over a VectorStore; parts may be given in any order."""

    def __init__(self) -> None:
        self._store: VectorStore | None = None
        self._queries: list[list[float]] | None = None
        self._metric: Metric | None = None
        self._filter: tuple[float, Cmp] | None = None
        self._mask: DataFrame | Sequence[bool] | None = None
        self._count: int | None = None
        self._take: TakeType | None = None
        self._arrow = False

    def with_vector_store(self, store: VectorStore) -> VectorQuery:
        self._store = store
        return self

    def with_query_vectors(self, queries: Sequence) -> VectorQuery:
        self._queries = batch(queries)
        return self

    def with_metric(self, metric: Metric) -> VectorQuery:
        self._metric = metric
        return self

    def with_row_mask(self, mask: DataFrame | Sequence[bool]) -> VectorQuery:
        """Rows to search: a list of booleans by row_id, or a DataFrame (row_id, keep). Rows that it doesn't name are searched."""
        self._mask = mask
        return self

    def with_arrow_scorer(self, on: bool = True) -> VectorQuery:
        """Score by NumPy over Arrow batches instead of by column expressions."""
        self._arrow = on
        return self

    def filter(self, score: float, cmp: Cmp) -> VectorQuery:
        self._filter = (score, cmp)
        return self

    def take(self, count: int) -> VectorQuery:
        """The best `count` by the metric's order, unless an order was chosen before."""
        self._count = count
        if self._take is None and self._metric is not None:
            self._take = TakeType.default(self._metric)
        return self

    def take_min(self, count: int) -> VectorQuery:
        self._count, self._take = count, TakeType.Min
        return self

    def take_max(self, count: int) -> VectorQuery:
        self._count, self._take = count, TakeType.Max
        return self

    def dataframe(self) -> DataFrame:
        """index, score and query_idx, in order of rank. Without a take: as many as the store has rows, the largest scores first."""
        if self._queries is None:
            raise QueryError("Query vectors or their norms are not set")
        if self._metric is None:
            raise QueryError("Search metric is not set")
        if self._store is None:
            raise QueryError("Vector store is not set")
        check_dimension(self._queries, self._store.dim)
        rows = self._store.rows()
        if isinstance(self._mask, DataFrame):
            rows = rows.join(self._mask.select("row_id", F.col("keep").alias("__keep")), "row_id", "left").where(F.coalesce("__keep", F.lit(True))).drop("__keep")
        elif self._mask is not None:
            hidden = [(i,) for i, keep in enumerate(self._mask) if not keep]
            rows = rows.join(rows.sparkSession.createDataFrame(hidden, "row_id long"), "row_id", "left_anti")
        rows = ranking.scored(rows, self._queries, self._metric, self._arrow)
        if self._filter is not None:
            rows = ranking.score_filter(rows, *self._filter)
        # one query has a score for each row at most, so that without a take there is nothing to cut
        count = self._count if self._count is not None or len(self._queries) == 1 else len(self._store)
        return ranking.top(rows, count, self._take or TakeType.Max).select(F.col("row_id").alias("index"), "score", "query_idx")

    def collect(self) -> list[SearchResult]:
        return [SearchResult(r["index"], r["score"]) for r in self.dataframe().collect()]


@dataclass(frozen=True)
class QueryStats:
    total_chunks: int
    pruned_chunks: int
    evaluated_chunks: int
    vectors_compared: int
    prune_ms: float
    score_ms: float
    merge_ms: float
    total_ms: float


@dataclass(frozen=True)
class QueryResults:
    """Ranked rows; columns are in alphabetical order."""

    columns: list[str]
    data: dict[str, list[Any]]
    indices: list[int]
    scores: list[float]
    kinds: dict[str, DataType] = field(repr=False, default_factory=dict)

    def column(self, name: str) -> list[Any] | None:
        return self.data.get(name)

    def __len__(self) -> int:
        return len(self.indices)

    def is_empty(self) -> bool:
        return not self.indices

    def __str__(self) -> str:
        rows = [[str(i), f"{s:.6f}", *(display.cell(self.data[c][k], self.kinds[c]) for c in self.columns)] for k, (i, s) in enumerate(zip(self.indices, self.scores, strict=True))]
        return display.table(["index", "score", *self.columns], rows)


class StoreQuery:
    """A query over a MetaStore."""

    def __init__(self, store: MetaStore, queries: list[list[float]], metric: Metric) -> None:
        self._store, self._queries, self._metric = store, queries, metric
        self._meta: CompiledFilter | None = None
        self._error: ExprError | None = None
        self._filter: tuple[float, Cmp] | None = None
        self._count: int | None = None
        self._take = TakeType.default(metric)
        self._arrow = False

    def meta_filter(self, expr: Expr) -> StoreQuery:
        """Compile expr now; its error waits for collect(). A second call replaces the first, and its error."""
        try:
            self._meta, self._error = expr.compile(self._store.schema), None
        except ExprError as e:
            self._error = e
        return self

    def vec_filter(self, score: float, cmp: Cmp) -> StoreQuery:
        self._filter = (score, cmp)
        return self

    def take(self, count: int) -> StoreQuery:
        self._count = count
        return self

    def with_arrow_scorer(self, on: bool = True) -> StoreQuery:
        self._arrow = on
        return self

    def _checked(self) -> None:
        if self._error is not None:
            raise self._error
        if self._store.n_rows() or self._store.dim:
            check_dimension(self._queries, self._store.dim)

    def surviving(self) -> DataFrame:
        """The zone map's rows of chunks that the filter can't rule out."""
        zones = self._store.zones
        return zones if self._meta is None else zones.where(zonemaps.keeps(self._meta, self._store.bloom, self._store.chunk_size))

    def _candidates(self) -> DataFrame:
        """Rows of surviving chunks, filtered."""
        rows = self._store.rows
        if self._meta is None:
            return rows
        alive = self.surviving().select("chunk_id")
        ids = sorted(r[0] for r in alive.limit(64 * MAX_RUNS + 1).collect())
        runs: list[list[int]] = []
        for i in ids:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        if len(ids) > 64 * MAX_RUNS or len(runs) > MAX_RUNS:
            rows = rows.join(alive, "chunk_id", "left_semi")
        elif len(ids) < self._store.n_chunks():
            size, within = self._store.chunk_size, F.lit(False)
            for first, last in runs:
                within = within | F.col("row_id").between(first * size, (last + 1) * size - 1)
            rows = rows.where(within)
        return rows.where(self._meta.to_spark())

    def dataframe(self) -> DataFrame:
        """index, score, the columns in alphabetical order, and query_idx, in order of rank."""
        self._checked()
        names = sorted(self._store.schema)
        if not self._queries or not self._store.n_rows():
            empty = self._store.rows.limit(0)
            return empty.select(F.col("row_id").alias("index"), F.lit(0.0).cast("float").alias("score"), *(F.col(f"`{c}`") for c in names), F.lit(0).alias("query_idx"))
        rows = ranking.scored(self._candidates(), self._queries, self._metric, self._arrow)
        if self._filter is not None:
            rows = ranking.score_filter(rows, *self._filter)
        count = self._count if self._count is not None or len(self._queries) == 1 else self._store.n_rows()
        return ranking.top(rows, count, self._take).select(F.col("row_id").alias("index"), "score", *(F.col(f"`{c}`") for c in names), "query_idx")

    def collect(self) -> QueryResults:
        began = time.perf_counter()
        self._checked()
        evaluated, alive = self.surviving().agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        pruned = time.perf_counter()
        rows = self.dataframe().collect()
        ranked = time.perf_counter()
        names, store = sorted(self._store.schema), self._store
        data = {c: [r[i + 2] for r in rows] for i, c in enumerate(names)}
        out = QueryResults(names, data, [r["index"] for r in rows], [r["score"] for r in rows], dict(store.schema))
        done = time.perf_counter()
        total = store.n_chunks()
        store._last = QueryStats(total, total - evaluated, evaluated, alive * len(self._queries), (pruned - began) * 1e3, (ranked - pruned) * 1e3, (done - ranked) * 1e3, (done - began) * 1e3)
        return out
