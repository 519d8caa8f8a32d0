import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.components import components


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(values, linked):
    """The least value that each can reach."""
    out = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            m = min(out[b] for b in values if linked(a, b))
            changed, out[a] = changed or m < out[a], min(m, out[a])
    return out


def test_near_duplicates(docs, rows):
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    got = {r["doc_id"]: (r["fp0"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    want = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert got == {i: (fps[i], want[i]) for i in fps}


def clustered(n, seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, max(1, n // 90), dtype=np.uint64)
    f = base[r.integers(0, len(base), n)]
    for _ in range(7):
        f = np.where(r.random(n) < 0.5, f ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)), f)
    return np.unique(f)


def test_links_are_whole(spark):
    f = clustered(700, 2)
    f = np.unique(np.concatenate([f, f[:50] ^ np.uint64(0b1111), f[:50] ^ np.uint64((1 << 63) | (1 << 40) | (1 << 20) | 1)]))
    df = spark.createDataFrame([(int(x), int(x)) for x in f.view(np.int64)], "node long, fp0 long")
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    label = np.arange(len(f))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    want = {}
    for i, k in enumerate(label):
        want.setdefault(k, set()).add(int(f[i]))
    for max_bucket in (8192, 40):  # the second cuts buckets into chunks
        found = {}
        for r in components(simhash.links(df, simhash.block_masks(4), 4, max_bucket)).collect():
            found.setdefault(r["component"], set()).add(r["node"] % 2**64)
        assert sorted(map(sorted, found.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def ranked(f):
    """Rows of words in order of Gray rank."""
    ranks, carry = [], np.zeros(len(f), np.uint64)
    for word in f.T:
        x = word.copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        x ^= np.uint64(0) - carry
        carry = x & np.uint64(1)
        ranks.append(x)
    return f[np.lexsort(ranks[::-1])]


def test_gray_order(spark):
    """Numbers of three words of two bits, as the six bits of a Gray code."""
    code = lambda shift: F.shiftright(F.col("id").bitwiseXOR(F.shiftright("id", 1)), shift).bitwiseAND(F.lit(3).cast("long"))
    ranks = spark.range(64).select("id", *simhash.gray_ranks([code(4), code(2), code(0)])).collect()
    assert all([x % 4 for x in r[1:]] == [r["id"] >> 4, r["id"] >> 2 & 3, r["id"] & 3] for r in ranks)


@pytest.mark.parametrize(("words", "most"), [(1, 4), (4, 44)])
def test_index_finds_all_pairs(words, most):
    f = ranked(clustered(3000, 4)[:, None] if words == 1 else wide(3000, 5))
    index = simhash.GrayIndex(f, np.array([0, 1700]), np.array([1700, len(f)]))
    found = set()
    for a in range(0, len(f), 200):
        q = np.arange(a, min(len(f), a + 200))
        i, j = index.pairs(q, (q >= 1700).astype(int), most, np.arange(len(f)))
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    near = np.bitwise_count(f[:, None] ^ f[None, :]).sum(axis=2) <= most
    near[:1700, 1700:] = False
    want = np.argwhere(np.triu(near, 1))
    assert len(want) > 100 and found == set(map(tuple, want.tolist()))


def wide(n, seed):
    """Fingerprints of four words, in families."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, (n // 30, 4), dtype=np.uint64)[r.integers(0, n // 30, n)]
    flips = np.packbits(r.random((n, 256)) < r.choice([0.0, 0.05, 0.15], n)[:, None], axis=1).view(np.uint64)
    return base ^ flips


def test_forest_of_many_groups():
    """Groups of one to some thousand fingerprints: the components are those of all pairs, and linked fingerprints are pruned."""
    f = wide(6000, 8)
    sizes = [1, 2, 2, 3, 1, 20, 200, 16, 17, 128, 129, 3000]
    sizes.append(len(f) - sum(sizes))
    group = np.repeat(np.arange(len(sizes)), sizes)
    f = np.concatenate([ranked(f[group == g]) for g in range(len(sizes))])
    a, b = simhash.forest(group, f, 44)
    got = np.arange(len(f))
    got[a] = b
    near = (np.bitwise_count(f[:, None, 0] ^ f[None, :, 0]) <= 44) & (group[:, None] == group[None, :])
    near[near] = np.bitwise_count(f[np.nonzero(near)[0]] ^ f[np.nonzero(near)[1]]).sum(axis=1) <= 44
    label = np.arange(len(f))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert (got == label).all() and len(a) > 3000


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_every_search_goes_through_the_index(monkeypatch, similarity):
    seen = []
    real = simhash.GrayIndex.pairs
    monkeypatch.setattr(simhash.GrayIndex, "pairs", lambda self, q, *a: seen.append(len(q)) or real(self, q, *a))
    f = wide(500, 3) if similarity else clustered(500, 3)[:, None]
    group = np.sort(np.random.default_rng(1).integers(0, 60, len(f)))
    simhash.forest(group, f, 44 if similarity else 4)
    assert sum(seen) == sum(n for n in np.bincount(group) if n > 1)


def test_recall_by_similarity(spark):
    """Of pairs with a five-word Jaccard similarity of 0.9 and more nearly all link, of those under 0.6 hardly any."""
    r = random.Random(3)
    texts, want = [], []
    for k, edits in enumerate([1, 3, 6, 25] * 60):
        words = [f"{r.choice('abcdefgh')}{r.randint(0, 9999)}" for _ in range(300)]
        other = list(words)
        for at in r.sample(range(300), edits):
            other[at] = "new"
        a, b = ({tuple(x[i : i + 5]) for i in range(296)} for x in (words, other))
        want.append(len(a & b) / len(a | b))
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), width=5, similarity=0.8).collect()}
    linked = [found[2 * k] == found[2 * k + 1] for k in range(len(want))]
    high, low = ([x for x, j in zip(linked, want, strict=True) if test(j)] for test in (lambda j: j >= 0.9, lambda j: j < 0.6))
    assert len(high) >= 100 and sum(high) >= 0.98 * len(high) and len(low) >= 50 and sum(low) <= 0.05 * len(low)
    assert all(found[i] // 2 == i // 2 for i in found)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(40)] + [(5, 5)] + [(3000, i) for i in range(2000, 2050)]
    nodes = sorted({x for e in edges for x in e})
    both = {e for a, b in edges for e in ((a, b), (b, a))}
    want = groups(nodes, lambda a, b: a == b or (a, b) in both)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == want[n] for n in nodes) and set(got) <= set(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(docs, rows, odd, empty):
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, c in found.items() if i == c)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(odd).count() == odd.count()


def test_unlike_texts_stay_whatever_their_ids(spark):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(60)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[3]), (8, texts[2])]
    for options in ({}, {"width": 5, "similarity": 0.8}):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3])])
