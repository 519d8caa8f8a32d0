import math
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from plumbline.llm import lmscore


def brute(texts, target, file, prior=lmscore.PRIOR):
    tokenizer = Tokenizer.from_file(file)
    size, ids = tokenizer.get_vocab_size(), lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids

    def model(some):
        pairs, before, own = Counter(), Counter(), Counter()
        for t in some:
            last = -1
            for w in ids(t):
                pairs[last, w] += 1
                before[last] += 1
                own[w] += 1
                last = w
        n = sum(own.values())
        return lambda v, w: -math.log((pairs[v, w] + prior * (own[w] + 1) / (n + size)) / (before[v] + prior))

    models = model(target), model(texts.values())
    out = {}
    for i, t in texts.items():
        x = ids(t)
        out[i] = (len(x), *(sum(m(v, w) for v, w in zip([-1, *x], x, strict=False)) / len(x) if x else None for m in models))
    return out


def test_scores(spark, docs, rows, path):
    file = path("word_bpe_49k.json")
    target = [(i, t) for i, t, *_ in rows if i % 9 == 0] + [(None, None)]
    want = brute({i: t for i, t, *_ in rows}, [t for _, t in target], file)
    for group_rows in (7, 1000):
        out = lmscore.score(docs, spark.createDataFrame(target, "item_id long, text string"), file, group_rows=group_rows).collect()
        assert len(out) == len(want)
        for r in out:
            n, a, b = want[r["doc_id"]]
            assert r["n_tokens"] == n
            if n:
                assert abs(r["loss_target"] - a) < 2e-6 and abs(r["loss_background"] - b) < 2e-6 and abs(r["score"] - (a - b)) < 3e-6
            else:
                assert r["score"] is None


def test_like_target_scores_lower(spark, path):
    texts = [(i, ("alpha beta gamma delta " if i % 2 else "red green blue white ") * 20) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = lmscore.score(docs, spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma")], "item_id long, text string"), path("word_bpe_49k.json")).collect()
    assert max(r["score"] for r in out if r["doc_id"] % 2) < min(r["score"] for r in out if not r["doc_id"] % 2)


def test_odd_and_empty(spark, odd, empty, path):
    target = spark.createDataFrame([], "item_id long, text string")
    assert lmscore.score(odd, target, path("word_bpe_49k.json")).count() == odd.count()
    assert lmscore.score(empty, target, path("word_bpe_49k.json")).count() == 0


def test_groups_are_bounded_whatever_the_ids(spark, monkeypatch, path):
    """Copies and null ids, a third of all rows, don't share a group; nor do long texts."""
    monkeypatch.setattr(lmscore, "GROUP_CHARS", 5000)
    file = path("word_bpe_49k.json")
    rows = [(None, "the same text")] * 300 + [(i, "text " * (i % 400)) for i in range(300)] + [(7, None)] * 300 + [(1, "x" * 9000)]
    chars = {(i, t): len(t or "") for i, t in rows}
    tokens = Tokenizer.from_file(file)
    sizes = {}
    groups = lmscore.grouped(spark.createDataFrame(rows, "id long, t string").coalesce(2), "id", "t", 50, file, tokens.get_vocab_size()).collect()
    names = {(i, tuple(tokens.encode(t or "", add_special_tokens=False).ids)): n for (i, t), n in chars.items()}
    for r in groups:
        sizes.setdefault(r["group"], []).append(names[r["doc_id"], tuple(np.frombuffer(r["ids"], "<u2").tolist())])
    assert len(groups) == len(rows) and all(len(x) <= 50 and (len(x) == 1 or sum(x) <= 5000) for x in sizes.values())
