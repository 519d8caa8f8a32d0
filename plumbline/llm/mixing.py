"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by hash into blocks. Each source's target gives whole copies of all its blocks and, from
one copy more, the first blocks of a hashed permutation; the last of these is cut at the word that meets the target. The
numbers of drawn blocks per source (quotas) are split among the output shards by a binary tree: at each node the left half
gets a multivariate hypergeometric draw without replacement from the node's quotas, so every shard has its exact size and
quotas add up exactly at every level. A source's permuted draws are then dealt to the shards as disjoint ranges, and each
shard is shuffled locally by hash.

Only DataFrame operations are used. Tables over sources, runs of blocks, and tree nodes are small (a row for each source,
for some 4096 blocks, for each shard); nothing grows with a source's rows inside one task.

Defined cases: a null or empty text has size 0 and is never drawn; null is a source of its own, the last one; repeated rows
are drawn each on their own; an empty table gives an empty result. Extra columns travel inside a struct, so that their names
can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import WORD, n_words_of, stored

#: Words in a block, blocks in a shard, blocks that one window orders.
BLOCK_WORDS, SHARD_BLOCKS, RUN_BLOCKS = 1 << 16, 64, 4096
#: Standard deviations on either side of the mode that a hypergeometric draw looks at; what lies beyond is under 1e-30.
REACH = 12


def source_targets(sizes: DataFrame, cycle: list[float], share: float, cap: float) -> DataFrame:
    """A row for each source: source, source_no (0, 1, ...), source_size, n_rows, target.

    Sources in code-point order, null last, weigh as cycle says, again and again, and share `share` times all words; a target
    stops at `cap` times the source's words and the excess goes to the others by weight. That fixed point is a water level:
    with sources ordered by cap over weight, the first one that the level doesn't fill sets it.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    # these windows have a row for each source
    one = one.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, cycle))), (F.col("source_no") % len(cycle) + 1).cast("int")))
    one = one.withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    one = one.withColumn("level", left / weights)
    one = one.withColumn("level", F.first(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(everything))
    return one.select("source", "source_no", "source_size", "n_rows", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) from a hash of cols."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` items drawn without replacement from good + bad are good: the inverse distribution function at u.

    Probabilities follow from their ratios, upwards from REACH standard deviations below the mode.
    """
    g, b, n = (x.cast("double") for x in (good, bad, draws))
    total = g + b
    mode = F.floor((n + 1) * (g + 1) / (total + 2))
    sd = F.sqrt(F.greatest(F.lit(0.0), n * (g / F.greatest(total, F.lit(1.0))) * (b / F.greatest(total, F.lit(1.0))) * (total - n) / F.greatest(total - 1, F.lit(1.0))))
    reach = F.ceil(sd * REACH) + REACH
    low = F.greatest(F.lit(0), draws - bad, mode - reach).cast("long")
    high = F.greatest(low, F.least(draws, good, mode + reach).cast("long"))

    def ratio(k: Column) -> Column:
        k = k.cast("double")
        return F.greatest(F.lit(0.0), (g - k) * (n - k)) / ((k + 1) * F.greatest(F.lit(1.0), b - n + k + 1))

    def walk(until: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
        return F.aggregate(F.sequence(low, high), start, lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum"), (s["below"] + F.when(s["sum"] + s["w"] <= until, 1).otherwise(0)).cast("long").alias("below")))

    return F.least(high, low + walk(u * walk(F.lit(0.0))["sum"])["below"])


def split_quotas(quotas: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """The tree. quotas: one row whose array `quotas` has each source's number of blocks. Returns (source_no, shard, first, last): the
    ranks of the source's draws that the shard takes."""
    nodes = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quotas")
    upto = lambda k: F.floor(k.cast("double") * total / shards).cast("long")  # noqa: E731  blocks of the shards before k
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        start = F.struct((upto(F.col("hi")) - upto(F.col("lo"))).alias("left"), (upto(mid) - upto(F.col("lo"))).alias("draws"), F.array().cast("array<bigint>").alias("taken"), F.lit(0).cast("long").alias("last"))

        def step(s: Column, q: Column) -> Column:
            k = hypergeometric(q, s["left"] - q, s["draws"], uniform(F.lit(seed), F.col("lo"), F.col("hi"), F.size(s["taken"])))
            # two folds, so that the draw is made once
            return F.aggregate(F.array(k), s, lambda t, x: F.struct((t["left"] - q).alias("left"), (t["draws"] - x).alias("draws"), F.concat(t["taken"], F.array(x)).alias("taken"), x.alias("last")))

        nodes = nodes.withColumn("mid", mid).withColumn("taken", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("quotas", start, step)["taken"]))
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("taken").alias("quotas")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.zip_with("quotas", "taken", lambda a, b: a - b).alias("quotas")),
        )
        nodes = nodes.select(F.explode(F.when(F.col("taken").isNull(), F.array(F.struct("lo", "hi", "quotas"))).otherwise(halves)).alias("x")).select("x.*")
    cells = nodes.select(F.col("lo").alias("shard"), F.posexplode("quotas").alias("source_no", "n")).where("n > 0")
    upto_here = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("last", F.sum("n").over(upto_here) - 1).select("source_no", "shard", (F.col("last") - F.col("n") + 1).alias("first"), "last")


def document_key(id_: Column, text: Column) -> Column:
    """What deals a document to a block: its id and text, so that no id that many documents share (as null) makes a large block."""
    return F.struct(id_.alias("id"), F.xxhash64(text).alias("text"))


def mix(docs: DataFrame, *, narrow: DataFrame | None = None, cycle: list[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> DataFrame:
    """What the mix takes of each row of docs.

    docs: row (a struct of whatever the caller wants back), id (such as document_key), source, size (words). narrow: the same rows' id, source and
    size as a table that is cheap to read three times; by default they are written to one here.
    Returns row, size, source_size, target, taken (words, repeats counted) and draws: an array of (copy, words, shard, place), where
    place orders a shard's rows at random.
    """
    narrow = stored(docs.select("id", "source", "size"), "mix-sizes") if narrow is None else narrow
    sources = source_targets(narrow, list(cycle), share, cap)
    sources = sources.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))
    sources = sources.withColumn("moduli", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words), F.ceil(F.col("n_rows") / 8192)).cast("long"))
    sources = stored(sources, "mix-sources")

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(sources.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source", "n_rows")
        return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), "moduli"))

    blocks = placed(narrow.where("size > 0")).groupBy("source_no", "block").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("moduli", "copies", "rest")))
    blocks = blocks.withColumn("key", F.xxhash64(F.lit(seed + 1), "source_no", "block")).withColumn("run", F.pmod("key", F.ceil(F.col("moduli") / RUN_BLOCKS)))
    blocks = stored(blocks, "mix-blocks")
    earlier = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    runs = blocks.groupBy("source_no", "run").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    whole = Window.partitionBy("source_no")
    runs = runs.select("source_no", "run", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("run_words"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("run_rank"), F.sum("n").over(whole).alias("n_blocks"))
    inside = Window.partitionBy("source_no", "run").orderBy("key", "block")
    blocks = blocks.join(runs, ["source_no", "run"]).withColumn("start", F.col("run_words") + F.sum("words").over(inside) - F.col("words")).withColumn("rank", F.col("run_rank") + F.row_number().over(inside) - 1)
    blocks = stored(blocks.withColumn("times", F.col("copies") + F.when(F.col("start") < F.col("rest"), 1).otherwise(0)).select("source_no", "block", "start", "rank", "n_blocks", "times").where("times > 0"), "mix-order")

    quotas = blocks.groupBy("source_no").agg(F.sum("times").alias("q"))
    all_quotas = sources.select("source_no").join(quotas, "source_no", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_no", F.coalesce("q", F.lit(0)).alias("q")))), lambda x: x["q"]).alias("quotas"))
    total = quotas.agg(F.coalesce(F.sum("q"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_blocks))
    cells = split_quotas(all_quotas, total, shards, seed + 2)
    dealt = cells.select("source_no", "shard", F.explode(F.sequence("first", "last")).alias("draw"))
    draws = blocks.select("source_no", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"), (F.col("copy") * F.col("n_blocks") + F.col("rank")).alias("draw"))
    drawn = draws.join(dealt, ["source_no", "draw"]).groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("shards"))
    blocks = blocks.select("source_no", "block", "start").join(drawn, ["source_no", "block"])

    rows = placed(docs).join(blocks, ["source_no", "block"], "left")
    before = Window.partitionBy("source_no", "block").orderBy(F.xxhash64(F.lit(seed + 3), "id"), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start")))
    # a block that isn't drawn has no start, and least() passes over nulls
    rows = rows.withColumn("part", F.when((F.col("size") > 0) & F.col("start").isNotNull(), part).otherwise(0))
    rows = rows.withColumn("taken", F.when(F.col("size") > 0, F.col("copies") * F.col("size") + F.col("part")).otherwise(0).cast("long"))
    one = lambda x: F.struct(x["copy"].alias("copy"), F.when(x["copy"] < F.col("copies"), F.col("size")).otherwise(F.col("part")).cast("long").alias("words"), x["shard"].alias("shard"), F.xxhash64(F.lit(seed + 4), x["shard"], x["copy"], F.col("id")).alias("place"))
    drawn = F.filter(F.transform(F.coalesce("shards", F.array().cast("array<struct<copy:bigint,shard:bigint>>")), one), lambda x: x["words"] > 0)
    return rows.select("row", "size", "source_size", "target", "taken", F.when(F.col("size") > 0, drawn).otherwise(F.array().cast("array<struct<copy:bigint,words:bigint,shard:bigint,place:bigint>>")).alias("draws"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: a row for each drawn copy of a document, with docs' columns, dealt to shards and shuffled inside each.

    The one document of a source at which its target is met is cut to its first words, joined by single spaces.
    """
    rows = docs.select(F.struct("*").alias("row"), document_key(F.col(id_col), F.col(text_col)).alias("id"), F.col(source_col).alias("source"), n_words_of(F.col(text_col)).alias("size"))
    taken = mix(rows, **options).select("row", "size", F.explode("draws").alias("d"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(WORD), F.lit(0)), 1, F.greatest(F.lit(1), F.col("d.words")).cast("int")), " ")
    text = F.when(F.col("d.words") < F.col("size"), cut).otherwise(F.col(f"row.{text_col}"))
    new = {text_col: text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    out = taken.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns), F.col("d.shard").alias("__shard"), F.col("d.place").alias("__place"))
    return out.repartition("__shard").sortWithinPartitions("__shard", "__place").drop("__shard", "__place")
