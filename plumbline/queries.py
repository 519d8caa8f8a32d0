"""The engine's queries over the driver's tables, each with its SQL.

The store of most queries is embeddings joined with events: a row for each vector, with columns of all types. Vectors are scaled by 1 + label where the
metrics would else agree. Scores are single precision; they are shown to four decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import datetimes
from plumbline.functions import vectors as V
from plumbline.operators import zonemaps
from plumbline.plans.expr import Expr, col
from plumbline.plans.query import StoreQuery
from plumbline.sources.store import MetaStore
from plumbline.sources.vectors import VectorStore
from plumbline.streaming.search import standing_query
from plumbline.types import Cmp, Metric

CHUNK = 64
Query = Callable[[SparkSession, str], DataFrame]


def base(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    vec = F.transform("embedding", lambda x: (x * (1 + F.col("label"))).cast("float")) if scaled else F.col("embedding")
    df = read("embeddings").join(read("events"), F.col("event_id") == F.col("vec_id"))
    return df.select("vec_id", vec.alias("embedding"), "label", F.col("vec_id").alias("pos"), "user_id", "event_type", "value", F.col("value").cast("float").alias("value32"), "ts")


def store(spark: SparkSession, sf_dir: str, scaled: bool = False, df: DataFrame | None = None) -> MetaStore:
    return MetaStore.from_dataframe(base(spark, sf_dir, scaled) if df is None else df, "embedding", "vec_id", chunk_size=CHUNK)


def bare(spark: SparkSession, sf_dir: str, scaled: bool = False) -> VectorStore:
    return VectorStore.from_dataframe(base(spark, sf_dir, scaled), "embedding", "vec_id")


def query_vectors(spark: SparkSession, sf_dir: str, n: int = 1) -> list[list[float]]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") < n).orderBy("vec_id").collect()
    return [list(r["embedding"]) for r in rows]


def ranked(df: DataFrame, descending: bool, *names: str) -> DataFrame:
    """rank, idx, score and named columns of a result of at most as many rows as were taken."""
    score = F.col("score").desc() if descending else F.col("score").asc()
    rank = F.row_number().over(Window.orderBy(score, "index", "query_idx")).cast("long")
    return df.select(rank.alias("rank"), F.col("index").alias("idx"), F.round(F.col("score").cast("double"), 4).alias("score"), *names)


#: SQL of the same relation; `{vec}` is the vector.
BASE = """base AS (SELECT vec_id AS row_id, CAST({vec} AS DOUBLE[]) AS v, label, vec_id AS pos, user_id, event_type, value, CAST(value AS FLOAT) AS value32, ts
FROM embeddings JOIN events ON event_id = vec_id)"""
PLAIN, SCALED = "embedding", "list_transform(embedding, lambda x: CAST(x * (1 + label) AS FLOAT))"
SCORE = {Metric.Cosine: "list_cosine_similarity(v, qv)", Metric.DotProduct: "list_dot_product(v, qv)", Metric.Euclidean: "list_distance(v, qv) * list_distance(v, qv)"}


def sql(metric: Metric, where: str = "TRUE", k: int | None = 10, descending: bool | None = None, scaled: bool = False, names: str = "", n_queries: int = 1, base_sql: str = BASE) -> str:
    descending = metric is not Metric.Euclidean if descending is None else descending
    order = f"score {'DESC' if descending else 'ASC'}, row_id, query_idx"
    limit = f"LIMIT {k}" if k is not None else "LIMIT (SELECT count(*) FROM base)" if n_queries > 1 else ""
    return f"""WITH {base_sql.format(vec=SCALED if scaled else PLAIN)},
q AS (SELECT vec_id AS query_idx, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id < {n_queries}),
scored AS (SELECT base.*, query_idx, CAST({SCORE[metric]} AS FLOAT) AS score FROM base, q),
best AS (SELECT * FROM scored WHERE {where} ORDER BY {order} {limit})
SELECT row_number() OVER (ORDER BY {order}) AS rank, row_id AS idx, round(CAST(score AS DOUBLE), 4) AS score{names} FROM best"""


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# --- metrics, order, count ---------------------------------------------------------------------------------------------------------------


def topk(spark: SparkSession, sf_dir: str, metric: Metric, arrow: bool = False) -> DataFrame:
    q = bare(spark, sf_dir, True).query(query_vectors(spark, sf_dir)[0], metric).take(10).with_arrow_scorer(arrow)
    return ranked(q.dataframe(), metric is not Metric.Euclidean)


for _name, _metric in (("cosine", Metric.Cosine), ("dot", Metric.DotProduct), ("l2", Metric.Euclidean)):
    register(f"{_name}_topk", partial(topk, metric=_metric), sql(_metric, scaled=True))
    register(f"{_name}_topk_arrow", partial(topk, metric=_metric, arrow=True), sql(_metric, scaled=True))


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics as functions of columns; a zero vector has cosine 0."""
    q = V.vector(query_vectors(spark, sf_dir)[0])
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("v", F.when(F.col("label") == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    v = F.col("v")
    scores = {"dot": V.dot_product(v, q), "cosine": V.cosine_similarity(v, q, V.inverse_norm(v), V.inverse_norm(q)), "l2": V.euclidean_distance_squared(v, q)}
    return df.select("vec_id", *(F.round(c, 5).alias(n) for n, c in scores.items()))


register("vector_functions", vector_functions, """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, qv FROM embeddings, q)
SELECT vec_id, CASE WHEN label = 0 THEN 0.0 ELSE round(list_dot_product(v, qv), 5) END AS dot, CASE WHEN label = 0 THEN 0.0 ELSE round(list_cosine_similarity(v, qv), 5) END AS cosine,
round(CASE WHEN label = 0 THEN list_dot_product(qv, qv) ELSE list_distance(v, qv) * list_distance(v, qv) END, 5) AS l2 FROM e""")

register("take_min_cosine", lambda s, d: ranked(bare(s, d).query(query_vectors(s, d)[0], Metric.Cosine).take_min(7).dataframe(), False), sql(Metric.Cosine, k=7, descending=False))
register("take_max_l2", lambda s, d: ranked(bare(s, d).query(query_vectors(s, d)[0], Metric.Euclidean).take_max(7).dataframe(), True), sql(Metric.Euclidean, k=7, descending=True))
register("take_min_then_take", lambda s, d: ranked(bare(s, d).query(query_vectors(s, d)[0], Metric.Cosine).take_min(3).take(6).dataframe(), False), sql(Metric.Cosine, k=6, descending=False))
register("l2_no_take_bare", lambda s, d: ranked(bare(s, d).query(query_vectors(s, d)[0], Metric.Euclidean).dataframe(), True), sql(Metric.Euclidean, k=None, descending=True))
register("l2_no_take_store", lambda s, d: ranked(store(s, d).query(query_vectors(s, d)[0], Metric.Euclidean).dataframe(), False), sql(Metric.Euclidean, k=None))
for _cmp, _t in ((Cmp.Gt, 0.1), (Cmp.Gte, 0.2), (Cmp.Lt, 0.0), (Cmp.Lte, -0.1), (Cmp.Eq, 1.0)):
    register(f"score_{_cmp.name.lower()}", lambda s, d, c=_cmp, t=_t: ranked(bare(s, d).query(query_vectors(s, d)[0], Metric.Cosine).filter(t, c).take(20).dataframe(), True), sql(Metric.Cosine, f"score {_cmp.value} CAST({_t} AS FLOAT)", 20))
register("batch_merged_topk", lambda s, d: ranked(bare(s, d).query(query_vectors(s, d, 3), Metric.Cosine).take(12).dataframe(), True), sql(Metric.Cosine, k=12, n_queries=3))
register("batch_no_take", lambda s, d: ranked(store(s, d).query_batch(query_vectors(s, d, 3), Metric.DotProduct).dataframe(), True), sql(Metric.DotProduct, k=None, n_queries=3))


def row_mask_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask names rows under 200; the others are searched."""
    mask = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).alias("keep"))
    return ranked(bare(spark, sf_dir).query(query_vectors(spark, sf_dir)[0], Metric.Cosine).with_row_mask(mask).take(15).dataframe(), True)


register("row_mask_topk", row_mask_topk, sql(Metric.Cosine, "(row_id >= 200 OR row_id % 3 = 0)", 15))

# --- metadata filters --------------------------------------------------------------------------------------------------------------------


def filtered(spark: SparkSession, sf_dir: str, where: Expr, k: int = 25, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    df = base(spark, sf_dir)
    q = store(spark, sf_dir, df=change(df) if change else df).query(query_vectors(spark, sf_dir)[0], Metric.Cosine)
    return ranked(q.meta_filter(where).take(k).dataframe(), True)


VALUES = {"i32": ("label", 4), "i64": ("pos", 123), "f32": ("value32", 20.5), "f64": ("value", 20.5), "ts": ("ts", "2024-01-02 00:00:00")}
OPS = {"eq": "=", "neq": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
for _kind, (_column, _value) in VALUES.items():
    for _op, _sign in OPS.items():
        _literal = f"TIMESTAMP '{_value}'" if _kind == "ts" else f"CAST({_value} AS FLOAT)" if _kind == "f32" else str(_value)
        register(f"meta_{_op}_{_kind}", lambda s, d, e=getattr(col(_column), _op)(_value): filtered(s, d, e), sql(Metric.Cosine, f"{_column} {_sign} {_literal}", 25))


def equal_to_row(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Equality with the value that row 10 has, as a double literal: it holds for the single-precision column as well."""
    value = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id = 10").first()["value"]
    return filtered(spark, sf_dir, col(column).eq(value) | col(column).lt(0.0))


for _column, _cast in (("value", "DOUBLE"), ("value32", "FLOAT")):
    _same = f"({_column} = CAST((SELECT value FROM events WHERE event_id = 10) AS {_cast}) OR {_column} < 0)"
    register(f"meta_equal_{_column}", partial(equal_to_row, column=_column), sql(Metric.Cosine, _same, 25))


def _hourly(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


def equal_to_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality with the hours of three rows."""
    hours = _hourly(base(spark, sf_dir)).where("vec_id in (3, 10, 17)").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).collect()
    return filtered(spark, sf_dir, reduce(or_, (col("ts").eq(h[0]) for h in hours)), change=_hourly)


register("meta_equal_ts", equal_to_times, sql(Metric.Cosine, "ts IN (SELECT ts FROM base WHERE row_id IN (3, 10, 17))", 25, base_sql=BASE.replace(", ts\n", ", date_trunc('hour', ts) AS ts\n")))
register("meta_eq_str", lambda s, d: filtered(s, d, col("event_type").eq("click")), sql(Metric.Cosine, "event_type = 'click'", 25))
register("meta_neq_str", lambda s, d: filtered(s, d, col("event_type").neq("click")), sql(Metric.Cosine, "event_type <> 'click'", 25))
register("meta_i32_wide_literal", lambda s, d: filtered(s, d, col("label").lt(3_000_000_000)), sql(Metric.Cosine, "label < 3000000000", 25))
register("meta_int_on_float", lambda s, d: filtered(s, d, col("value").gte(20)), sql(Metric.Cosine, "value >= 20", 25))
register("meta_and", lambda s, d: filtered(s, d, col("label").gte(3) & col("value").gt(5.0)), sql(Metric.Cosine, "label >= 3 AND value > 5", 25))
register("meta_or", lambda s, d: filtered(s, d, col("label").eq(3) | col("event_type").eq("purchase")), sql(Metric.Cosine, "(label = 3 OR event_type = 'purchase')", 25))
register(
    "meta_cnf",
    lambda s, d: filtered(s, d, (col("label").eq(3) & col("value").gt(1.0)) | (col("event_type").eq("click") & col("pos").lt(400))),
    sql(Metric.Cosine, "((label = 3 AND value > 1) OR (event_type = 'click' AND pos < 400))", 25),
)
NULLED = BASE.replace(" event_type,", " nullif(event_type, 'click') AS event_type,").replace(" label,", " nullif(label, 4) AS label,")
_nulled = lambda df: df.withColumns({"event_type": F.nullif("event_type", F.lit("click")), "label": F.nullif("label", F.lit(4))})
register("meta_null_neq", lambda s, d: filtered(s, d, col("event_type").neq("view") & col("label").neq(2), change=_nulled), sql(Metric.Cosine, "event_type <> 'view' AND label <> 2", 25, base_sql=NULLED))
register("meta_tautology_null", lambda s, d: filtered(s, d, col("label").eq(2) | col("label").neq(2), change=_nulled), sql(Metric.Cosine, k=25, base_sql=NULLED))
register(
    "meta_tautology_distributed",
    lambda s, d: filtered(s, d, (col("label").eq(2) & col("value").gt(5.0)) | col("label").neq(2), change=_nulled),
    sql(Metric.Cosine, "(value > 5 OR label <> 2)", 25, base_sql=NULLED),
)
NAN = BASE.replace(" value,", " CASE WHEN label = 4 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,")
_nan = lambda df: df.withColumn("value", F.when(F.col("label") == 4, F.lit(float("nan"))).otherwise(F.col("value")))
register("meta_nan_gt", lambda s, d: filtered(s, d, col("value").gt(20.5), change=_nan), sql(Metric.Cosine, "value > 20.5 AND NOT isnan(value)", 25, base_sql=NAN))
register("meta_nan_neq", lambda s, d: filtered(s, d, col("value").neq(20.5), change=_nan), sql(Metric.Cosine, "value <> 20.5", 25, base_sql=NAN))

# --- zone maps, statistics, display ------------------------------------------------------------------------------------------------------


def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = store(spark, sf_dir, df=_nan(_nulled(base(spark, sf_dir)))).zones
    names = {"label": ("n", "min", "max"), "pos": ("n", "min", "max"), "value": ("n", "min", "max"), "event_type": ("n",)}
    out = [F.col(f"`{c}.{p}`").alias(f"{c}_{p}") for c, ps in names.items() for p in ps]
    times = [F.date_format(F.col(f"`ts.{p}`"), "yyyy-MM-dd HH:mm:ss").alias(f"ts_{p}") for p in ("min", "max")]
    return z.select("chunk_id", "rows", *out, *times)


register("zone_map", zone_map, f"""WITH {NULLED.replace(" value,", " CASE WHEN nullif(label, 4) IS NULL THEN NULL ELSE value END AS number, value,").format(vec=PLAIN)}
SELECT CAST(floor(row_id / {CHUNK}) AS BIGINT) AS chunk_id, count(*) AS rows, count(label) AS label_n, min(label) AS label_min, max(label) AS label_max, count(*) AS pos_n, min(pos) AS pos_min, max(pos) AS pos_max,
count(*) AS value_n, min(value) AS value_min, max(value) AS value_max, count(event_type) AS event_type_n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts_min, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts_max
FROM base GROUP BY 1""")


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the chunks that a filter leaves."""
    q = store(spark, sf_dir).query(query_vectors(spark, sf_dir)[0], Metric.Cosine).meta_filter((col("pos").gte(100) & col("pos").lt(300)) | col("pos").eq(450))
    return q.surviving().select("chunk_id", "rows")


register("pruned_chunks", pruned, f"""SELECT CAST(floor(vec_id / {CHUNK}) AS BIGINT) AS chunk_id, count(*) AS rows FROM embeddings JOIN events ON event_id = vec_id GROUP BY 1
HAVING (max(vec_id) >= 100 AND min(vec_id) < 300) OR (min(vec_id) <= 450 AND max(vec_id) >= 450)""")


def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = store(spark, sf_dir)
    m.query_batch(query_vectors(spark, sf_dir, 2), Metric.Cosine).meta_filter(col("pos").gt(200)).take(5).collect()
    s = m.last_query_stats()
    return spark.createDataFrame([(s.total_chunks, s.pruned_chunks, s.evaluated_chunks, s.vectors_compared)], "total_chunks long, pruned_chunks long, evaluated_chunks long, vectors_compared long")


register("query_stats", query_stats, f"""WITH z AS (SELECT floor(vec_id / {CHUNK}) AS c, max(vec_id) AS top, count(*) AS n FROM embeddings JOIN events ON event_id = vec_id GROUP BY 1)
SELECT count(*) AS total_chunks, CAST(sum(CASE WHEN top > 200 THEN 0 ELSE 1 END) AS BIGINT) AS pruned_chunks, CAST(sum(CASE WHEN top > 200 THEN 1 ELSE 0 END) AS BIGINT) AS evaluated_chunks,
CAST(sum(CASE WHEN top > 200 THEN 2 * n ELSE 0 END) AS BIGINT) AS vectors_compared FROM z""")


def bloom_no_false_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event type, how many chunks that hold it its Bloom filters keep: all."""
    m = store(spark, sf_dir)
    out = None
    for kind in ("click", "view", "purchase", "signup"):
        keep = zonemaps.keeps(col("event_type").eq(kind).compile(m.schema), m.bloom, m.chunk_size)
        holds = m.rows.where(F.col("event_type") == kind).select("chunk_id").distinct()
        one = m.zones.where(keep).join(holds, "chunk_id").agg(F.count("*").alias("chunks")).select(F.lit(kind).alias("event_type"), "chunks")
        out = one if out is None else out.union(one)
    return out


register("bloom_no_false_negative", bloom_no_false_negative, f"""WITH k AS (SELECT unnest(['click', 'view', 'purchase', 'signup']) AS event_type),
h AS (SELECT DISTINCT event_type, floor(vec_id / {CHUNK}) AS c FROM embeddings JOIN events ON event_id = vec_id)
SELECT k.event_type, count(h.c) AS chunks FROM k LEFT JOIN h ON h.event_type = k.event_type GROUP BY 1""")


def store_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).rows.orderBy("row_id").limit(5).select(F.col("row_id").alias("idx"), "label", "user_id", "event_type", "value")


register("store_head", store_head, "SELECT vec_id AS idx, label, user_id, event_type, value FROM embeddings JOIN events ON event_id = vec_id ORDER BY vec_id LIMIT 5")


def result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = store(spark, sf_dir).query(query_vectors(spark, sf_dir)[0], Metric.Cosine).take(10)
    return ranked(q.dataframe(), True, "event_type", "label", "value")


register("result_columns", result_columns, sql(Metric.Cosine, names=", event_type, label, value"))


def parse_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the default formats and back: an offset counts, milliseconds stay, a T without offset is refused."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = lambda pattern: F.date_format("ts", pattern)
    texts = {"utc": at("yyyy-MM-dd'T'HH:mm:ss'Z'"), "east": at("yyyy-MM-dd'T'HH:mm:ss.123456'+02:00'"), "plain": at("yyyy-MM-dd HH:mm:ss"), "day": at("yyyy-MM-dd"), "bare_t": at("yyyy-MM-dd'T'HH:mm:ss")}
    return df.select("event_id", *(F.date_format(datetimes.parse_column(t), "yyyy-MM-dd HH:mm:ss.SSS").alias(n) for n, t in texts.items()))


register("parse_datetimes", parse_datetimes, """WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)
SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S.000') AS utc, strftime(t - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.123') AS east, strftime(t, '%Y-%m-%d %H:%M:%S.000') AS plain,
strftime(t, '%Y-%m-%d 00:00:00.000') AS day, CAST(NULL AS VARCHAR) AS bare_t FROM e""")


def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir).select("vec_id", "embedding", "label")
    out = standing_query(df, "embedding", "vec_id", query_vectors(spark, sf_dir, 2), Metric.Cosine, 0.15, Cmp.Gt, col("label").gte(2))
    return out.select(F.col("row_id").alias("idx"), F.col("query_idx").cast("long").alias("query_idx"), "label", F.round(F.col("score").cast("double"), 4).alias("score"))


register("standing_query", standing, f"""WITH {BASE.format(vec=PLAIN)}, q AS (SELECT vec_id AS query_idx, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id < 2),
s AS (SELECT row_id, query_idx, label, CAST(list_cosine_similarity(v, qv) AS FLOAT) AS score FROM base, q WHERE label >= 2)
SELECT row_id AS idx, query_idx, label, round(CAST(score AS DOUBLE), 4) AS score FROM s WHERE score > CAST(0.15 AS FLOAT)""")


def flagship_query(spark: SparkSession, sf_dir: str) -> StoreQuery:
    where = col("event_type").eq("click") & col("value").gt(5.0) & col("ts").gte("2024-01-01")
    return store(spark, sf_dir).query(query_vectors(spark, sf_dir)[0], Metric.Cosine).meta_filter(where).vec_filter(-0.9, Cmp.Gt).take(5)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata filter of three types, a score filter, the five nearest."""
    return ranked(flagship_query(spark, sf_dir).dataframe(), True, "event_type", "label", "value")


register("hybrid_flagship", flagship, sql(Metric.Cosine, "event_type = 'click' AND value > 5 AND ts >= TIMESTAMP '2024-01-01' AND score > CAST(-0.9 AS FLOAT)", 5, names=", event_type, label, value"))
