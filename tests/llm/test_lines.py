import random
from collections import Counter, defaultdict

import pytest
from llm_corpus import prose
from pyspark.sql import functions as F

from plumbline.llm import lines


def brute(rows):
    """Numbers of removed lines for each id, by comparing all lines."""
    first, seen = {}, []
    for i, text, *_ in sorted(rows, key=lambda x: x[0]):
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" \t\r").lower()
            if any(c.isalnum() for c in line):
                seen.append((i, k, line))
                first.setdefault(line, (i, k))
    units = list(first)
    sets = [frozenset(u[j : j + lines.SHINGLE] for j in range(max(1, len(u) - lines.SHINGLE + 1))) for u in units]
    label, index = list(range(len(units))), defaultdict(list)

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    fuzzy = 0
    for a, s in enumerate(sets):
        shared = Counter()
        for g in s:
            shared.update(index[g])
            index[g].append(a)
        for b, n in shared.items():
            if n / (len(s) + len(sets[b]) - n) >= lines.THRESHOLD:
                fuzzy += 1
                label[max(root(a), root(b))] = min(root(a), root(b))
    stays = {}
    for a, u in enumerate(units):
        stays[root(a)] = min(stays.get(root(a), first[u]), first[u])
    place, gone = {u: a for a, u in enumerate(units)}, defaultdict(list)
    for i, k, line in seen:
        if stays[root(place[line])] != (i, k):
            gone[i].append(k)
    return gone, fuzzy


def near_rows(seed=3, n=60):
    """Documents that share lines, many with a changed word or letter, chains of changes, and one line with many variants."""
    r = random.Random(seed)
    pool = [prose(r, 1) for _ in range(25)]
    hot = " ".join(prose(r, 1).split()[:60])
    rows = []
    for i in range(n):
        out = []
        for _ in range(r.randint(0, 6)):
            line = r.choice(pool)
            if r.random() < 0.5:
                at = r.randrange(len(line))
                line = line[:at] + r.choice(["", "x", "é", " and"]) + line[at + 1 :]
                pool.append(line)
            out.append(line)
        words = hot.split()
        words[r.randrange(len(words))] = f"v{i}"
        rows.append((i, "\n".join([*out, " ".join(words), "short line"]), "en", "a", 0))
    return rows


def test_fuzzy_lines(spark, rows):
    for some in (near_rows(), rows):
        df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        want, fuzzy = brute(some)
        got = {r["doc_id"]: r for r in lines.line_report(df).collect()}
        assert len(got) == len(some)
        for i, text, *_ in some:
            assert got[i]["removed"] == ",".join(map(str, want.get(i, []))), i
            assert got[i]["n_removed"] == len(want.get(i, [])) and got[i]["n_lines"] == (0 if text is None else text.count("\n") + 1)
        if some is not rows:
            assert fuzzy > 500


def test_texts(spark):
    some = near_rows(4, 25)
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
    want, _ = brute(some)
    for r in lines.drop_repeated_lines(df).collect():
        text = some[r["doc_id"]][1].split("\n")
        left = "\n".join(x for k, x in enumerate(text) if k not in want.get(r["doc_id"], []))
        assert r["text"] == left and (r["n_chars"] == len(left) or r["doc_id"] not in want)


def shared_bands(spark, pairs):
    """For each pair of lines the number of bands that their signatures share."""
    rows = [(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    found = {r["unit"]: set(r["bands"]) for r in lines.signed(spark.createDataFrame(rows, "unit long, line string").repartition(4)).collect()}
    return [len(found[2 * i] & found[2 * i + 1]) for i in range(len(pairs))]


def test_signatures_agree_as_jaccard_says(spark):
    r = random.Random(9)
    base = prose(r, 1)
    pairs = [(base, base), (base, base[:-1] + "!"), (base, prose(r, 1))]
    got = spark.createDataFrame(pairs, "a string, b string").select(lines.jaccard(lines.shingles(F.col("a")), lines.shingles(F.col("b"))).alias("j")).collect()
    n = shared_bands(spark, pairs)
    assert (n[0], got[0]["j"]) == (lines.BANDS, 1) and n[1] > 0 and got[1]["j"] > 0.9 and n[2] == 0


def test_odd_and_empty(odd, empty):
    out = lines.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert lines.line_report(empty).count() == 0


@pytest.mark.parametrize("shared", [24, 80, 400, 1600])
@pytest.mark.parametrize("contained", [True, False])
def test_recall_at_the_threshold(spark, shared, contained):
    """Pairs of Jaccard 0.8, short and long: one line begins the other, or both go on in their own way."""
    r = random.Random(shared)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    pairs = []
    for _ in range(400):
        s = letters(shared + lines.SHINGLE - 1)
        pairs.append((s, s + letters(shared // 4)) if contained else (s + letters(shared // 8), s + letters(shared // 8)))
    assert sum(n > 0 for n in shared_bands(spark, pairs)) >= 388


def test_short_lines_repeat_only_if_equal(spark):
    rows = [(1, "Yes.\n\n}\nab"), (2, "yes. \n\n}\nabc"), (3, "日本語です\n---\nYes!")]
    got = {r["doc_id"]: r["removed"] for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "0", 3: ""}


def test_very_long_lines(spark):
    r = random.Random(5)
    long = " ".join(prose(r, 1) for _ in range(2000)).replace("\n", " ")
    rows = [(1, long), (2, long + " and a little more"), (3, long[: len(long) // 2])]
    got = {r["doc_id"]: r["removed"] for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "0", 3: ""}


def test_a_shingle_meets_the_minima_of_its_part_only(spark):
    """The signatures are those of all permutations over all shingles, but few of the minima are worked out for each shingle."""
    r = random.Random(6)
    units = spark.createDataFrame([(i, prose(r, 1)[: 3 + 40 * i]) for i in range(12)], "unit long, line string")
    plan = lines.signed(units)._jdf.queryExecution().optimizedPlan().toString()
    by_shingle = next(x for x in reversed(plan.split("\n")) if "Aggregate" in x)
    assert 0 < by_shingle.count("min(") <= lines.BANDS * lines.ROWS // 8
    masks = [lines.low_masks()[i] ^ (part << (64 - lines.TOP)) for i, part in lines.permutations()]
    assert len(set(masks)) == lines.BANDS * lines.ROWS
    # longs are compared with their sign, which is the highest bit of the part
    signed = lambda x: x - (x >> 63 << 64)
    want = []
    for u in units.select("unit", lines.shingles(F.col("line")).alias("s")).collect():
        least = [min(signed((h ^ m) & (1 << 64) - 1) for h in u["s"]) for m in masks]
        want += [(u["unit"], j, *least[j * lines.ROWS : (j + 1) * lines.ROWS]) for j in range(lines.BANDS)]
    names = [f"m{k}" for k in range(lines.ROWS)]
    hashed = spark.createDataFrame(want, "unit long, j int, " + ", ".join(f"{x} long" for x in names)).select("unit", "j", F.xxhash64("j", *names).alias("band"))
    bands = {(x["unit"], x["j"]): x["band"] for x in hashed.collect()}
    for u in lines.signed(units).collect():
        assert u["bands"] == [bands[u["unit"], j] for j in range(lines.BANDS)]


def test_pairs_are_intersected_once(spark):
    """A filter by the similarity doesn't move below the sets, with their expressions in place of names, nor into a lambda."""
    texts = spark.createDataFrame([(1, "a line of some words"), (2, "a line of some wordz"), (3, "another")], "unit long, line string")
    texts = texts.withColumn("size", F.size(lines.shingles(F.col("line"))))
    found = lines.verified(spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "a long, b long"), texts, 0.8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(set_a") == 1 and [tuple(x) for x in found.collect()] == [(1, 2), (2, 2)]
