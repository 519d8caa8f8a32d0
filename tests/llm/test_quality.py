import re
from collections import Counter

from plumbline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base(docs, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: r for r in quality.judge(docs).select("d.doc_id", *(f"q.{n}" for n in [*names, "base_failed"]), "kept").collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want = brute(text)
        assert tuple(got[i][n] for n in names) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_prose_stays_and_junk_goes(docs, rows):
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    for i, text, *_ in rows:
        if i < 60:
            assert (i in kept) == (brute(text)[0] >= 20)
        if text and ("#$%" in text or "no no" in text):
            assert i not in kept


def test_order_changes_nothing(docs, monkeypatch):
    first = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    monkeypatch.setattr(quality, "rule_order", lambda docs, text, rules, n: sorted(rules, reverse=True))
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == first


def test_rejecting_cheap_rules_come_first(docs):
    from pyspark.sql import functions as F

    slow = F.size(F.filter("q.words", lambda w: F.length(F.repeat(w, 2000)) < 0)) > 0
    order = quality.rule_order(docs, F.col("text"), {"never": slow, "always": F.lit(True) | (F.col("q.n") > 0)}, 50)
    assert order == ["always", "never"]


def test_timing_noise_leaves_the_order():
    rates = {"a": 100.0, "b": 95.0, "c": 10.0, "d": 0.0, "e": 0.0}
    for noise in (0.9, 1.0, 1.1):
        assert quality.by_rate(rates | {"b": 95.0 * noise, "c": 10.0 * noise}) == ["a", "b", "c", "d", "e"]


def test_the_base_rules_are_in_the_cascade(docs, monkeypatch):
    """A document that goes early doesn't pay for repeated windows: with them last, they are worked out for the others only."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "rule_order", lambda docs, text, rules, n: [k for k in rules if k != "repeats"] + ["repeats"])
    monkeypatch.setattr(quality, "repeat_words", lambda words: F.when(F.size(words) < quality.MIN_WORDS, F.raise_error(F.lit("repeated windows of a text that had gone"))).otherwise(0))
    assert quality.keep_good(docs).count() > 0


def test_sql(spark, docs, rows):
    import duckdb

    from plumbline.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    found = con.sql(ORACLES["op3_quality_rules"])
    want = {x[0]: dict(zip(found.columns, x, strict=True)) for x in found.fetchall()}
    names = [c for c in found.columns if c not in ("doc_id", "kept")]
    got = {r["doc_id"]: r.asDict() for r in quality.judge(docs).select("d.doc_id", *(f"q.{c}" for c in names), "kept").collect()}
    assert got == want


def test_odd_and_empty(odd, empty):
    out = quality.keep_good(odd)
    assert out.columns == odd.columns and 0 < out.count() < odd.count()
    assert quality.keep_good(empty).count() == 0
