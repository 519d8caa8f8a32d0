import os
import re
from collections import Counter

import pytest
from test_lines import brute as brute_lines

import corpus_pipeline
from plumbline.llm.queries import ORACLES, QUERIES
from plumbline.llm.shared import stored

DATA = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(ORACLES) <= set(QUERIES)
    assert {"pipeline", *QUERIES} <= set(entry.queries())


def test_stages(docs, spark):
    """Each stage keeps the columns and works on all that the one before kept."""
    ids = {r["doc_id"] for r in docs.collect()}
    some = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        some = stage(spark, some, "").cache()
        assert some.columns == docs.columns
        assert {r["doc_id"] for r in some.collect()} <= ids
        ids = {r["doc_id"] for r in some.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, some, "").where("piece = 0").collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(r["doc_id"] for r in some.collect())


def test_odd_and_empty(odd, empty, spark):
    """Null and repeated ids, repeated rows, clashing names, and no rows at all go through every stage."""
    for docs in (odd, empty):
        some = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stored(stage(spark, some, ""), "test")
            assert some.columns == docs.columns
        assert (some.count() > 0) == (docs is odd)
        assert corpus_pipeline.STAGES[-1][1](spark, some, "").count() >= some.count()


def test_against_brute_force(spark, docs, rows):
    """The first four stages by other means: which documents and lines stay, and how often the mix takes them."""
    good = corpus_pipeline.quality_rules(spark, docs, "")
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    judged = {r["doc_id"]: brute_quality(t) for r in docs.collect() for t in [r["text"]]}
    assert all(judged[i] for i in kept) and all(i in kept for i, fine in judged.items() if fine and i < 60)

    gone, _ = brute_lines([(i, t) for i, t in kept.items()])
    cut = stored(corpus_pipeline.line_dedup(spark, good, ""), "test")
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])) for i, t in kept.items()}

    alone = stored(corpus_pipeline.simhash_dedup(spark, cut, ""), "test")
    left = {r["doc_id"] for r in alone.collect()}
    sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for i, t in texts.items()}
    for i in texts:
        near = [j for j in texts if j != i and len(sets[i] & sets[j]) >= 0.9 * len(sets[i] | sets[j])]
        far = all(len(sets[i] & sets[j]) < 0.5 * len(sets[i] | sets[j]) for j in texts if j != i)
        assert (i in left) if far else True
        assert not (i in left and any(j in left for j in near))

    mixed = corpus_pipeline.source_mix(spark, alone, "").collect()
    size = lambda t: len((t or "").split())
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += size(r["text"])
        assert r["doc_id"] in left and size(r["text"]) <= size(texts[r["doc_id"]])
    own = Counter()
    for i in left:
        own[sources(rows)[i]] += size(texts[i])
    total = sum(own.values())
    assert abs(sum(taken.values()) - min(1.5 * total, 2 * total)) <= len(own) and all(taken[x] <= 2 * own[x] for x in own)


def sources(rows):
    return {r[0]: r[3] for r in rows}


def brute_quality(text):
    """Whether the base rule lets a text pass."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words) >= 20 and 100 * len(covered) <= 30 * len(words)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 0 < out.join(docs, "doc_id", "left_semi").count() == out.count()
