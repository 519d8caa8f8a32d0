import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.shared import n_words_of


def sized(docs):
    return docs.select(F.struct("doc_id", "source").alias("row"), F.col("doc_id").alias("id"), "source", n_words_of(F.col("text")).alias("size"))


def targets(sizes, share=1.5, cap=2.0):
    """Shares are made again until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] > cap * sizes[s]]
        if not over:
            return fixed | part
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("options", [{}, {"block_words": 50, "shard_blocks": 4}])
def test_mix(docs, rows, options):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    whole = defaultdict(int)
    for i, _, _, s, _ in rows:
        whole[s] += size[i]
    want = targets(whole)
    out = mixing.mix(sized(docs), **options).collect()
    assert sorted(r["row"]["doc_id"] for r in out) == sorted(size)
    taken, shards = defaultdict(int), defaultdict(int)
    for r in out:
        i, s = r["row"]
        assert r["size"] == size[i] and r["source_size"] == whole[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] == sum(d["words"] for d in r["draws"]) <= 2 * size[i]
        assert len({d["copy"] for d in r["draws"]}) == len(r["draws"]) and all(0 < d["words"] <= size[i] for d in r["draws"])
        taken[s] += r["taken"]
        for d in r["draws"]:
            shards[d["shard"]] += d["words"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in whole)
    if options:
        assert len(shards) > 3
    again = mixing.mix(sized(docs.repartition(2)), **options).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_blocks_not_drawn_count_nothing(spark):
    """A source of many blocks whose target is far below its size."""
    df = spark.range(400).select(F.struct("id").alias("row"), "id", F.lit("a").alias("source"), F.lit(10).cast("long").alias("size"))
    out = mixing.mix(df, share=0.25, block_words=50).collect()
    assert sum(r["taken"] for r in out) == 1000 and sum(not r["draws"] for r in out) > 200
    assert all(r["taken"] == sum(d["words"] for d in r["draws"]) for r in out)


def test_tree_is_exact(spark):
    quotas = [100, 37, 0, 1, 262]
    total, shards = sum(quotas), 13
    df = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    cells = mixing.split_quotas(df, total, shards, 3).collect()
    per_shard, per_source = defaultdict(int), defaultdict(list)
    for c in cells:
        per_shard[c["shard"]] += c["last"] - c["first"] + 1
        per_source[c["source_no"]] += range(c["first"], c["last"] + 1)
    assert [per_shard[k] for k in range(shards)] == [(k + 1) * total // shards - k * total // shards for k in range(shards)]
    assert all(sorted(per_source[s]) == list(range(q)) for s, q in enumerate(quotas))


def test_hypergeometric_distribution(spark):
    from math import comb

    g, b, n, times = 6, 9, 7, 20000
    rows = spark.range(times).select(mixing.hypergeometric(F.lit(g).cast("long"), F.lit(b).cast("long"), F.lit(n).cast("long"), (F.col("id") + 0.5) / times).alias("k")).groupBy("k").count().collect()
    for r in rows:
        assert abs(r["count"] / times - comb(g, r["k"]) * comb(b, n - r["k"]) / comb(g + b, n)) < 2e-4
    edge = spark.range(3).select(*(mixing.hypergeometric(F.lit(x).cast("long"), F.lit(y).cast("long"), F.lit(z).cast("long"), F.lit(0.7)).alias(f"c{i}") for i, (x, y, z) in enumerate([(0, 5, 3), (5, 0, 3), (4, 4, 8), (10**9, 10**9, 10**6)]))).first()
    assert tuple(edge)[:3] == (0, 3, 4) and abs(edge[3] - 500262) < 20


def test_documents(docs, odd, empty):
    out = mixing.mix_documents(docs, block_words=50, shard_blocks=4)
    assert out.columns == docs.columns
    assert out.agg(F.sum(n_words_of(F.col("text")))).first()[0] == sum(r["taken"] for r in mixing.mix(sized(docs), block_words=50, shard_blocks=4).collect())
    whole = {r["text"] for r in docs.collect()}
    assert sum(r["text"] not in whole for r in out.collect()) <= 5  # at most one cut document for each source
    assert mixing.mix_documents(odd).columns == odd.columns and mixing.mix_documents(odd).count() > 0
    assert mixing.mix_documents(empty).count() == 0 and mixing.mix(sized(empty)).count() == 0


def test_a_shared_id_makes_no_large_block(spark):
    """A third of all rows without an id: their blocks are as small as others, and the mix still meets its targets."""
    texts = [(None if i % 3 == 0 else i, f"text number {i} " + "word " * (i % 50), "a" if i % 2 else "b") for i in range(3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").select(mixing.document_key(F.col("doc_id"), F.col("text")).alias("id"), "source", F.size(F.split(F.trim("text"), " ")).cast("long").alias("size"))
    out = mixing.mix(df.select(F.struct("id").alias("row"), "id", "source", "size"), block_words=1000, shard_blocks=4)
    sums = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")) if "source" in out.columns else out.groupBy("target").agg(F.sum("taken").alias("taken"))
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in sums.collect())
    moduli = df.groupBy("source").agg(F.ceil(F.sum("size") / 1000).alias("n"))
    blocks = df.join(moduli, "source").groupBy("source", F.pmod(F.xxhash64(F.lit(1), "id"), "n").alias("block")).agg(F.sum("size").alias("words"))
    assert blocks.agg(F.max("words")).first()[0] < 3000
