import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import secrets

PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]
TEXTS = [
    'x password = "hunter2hunter2" y',
    "secret: token: abcdefghijklmnop",  # the first match is too short and takes the second key with it
    "TOKEN:=abc api_key=abcdefghijkl apikey:'0123456789abcdef0123'",
    "é😀 AKIAABCDEFGHIJKLMN AKIASHORT 😀deadbeefdeadbeef0",
    "0123456789abcdef" * 700,
    "deadbeefdeadbeef " * 700,
    "k9Xv2LqPz7RtB4mWc8YdF1gH5jNs end",
    "00000000-1111-2222-3333-444444444444 example_key_9Xv2LqPz7RtB4mWc8 thisisaverylongordinaryword",
    None,
    "",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in secrets.scan_digest(df).collect():
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(TEXTS[r["doc_id"]] or "") if ok(m))
        shown = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in found)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in found) for j in range(3)]
        assert set(shown.split(",")) - {""} <= set(r["spans"].split(","))


def test_entropy_finds_and_allows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r["doc_id"]: [x["text"] for x in r["entropy"]] for r in secrets.scan(df).collect()}
    assert found[6] == ["k9Xv2LqPz7RtB4mWc8YdF1gH5jNs"]
    assert found[7] == []


def brute(s):
    """Whether some window of s reaches its class's threshold."""
    n = secrets.WINDOW
    for i in range(len(s) - n + 1):
        w = s[i : i + n]
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w) else "single" if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", w) else "wide"
        if " " not in w and -sum(c / n * math.log2(c / n) for c in Counter(w).values()) >= secrets.THRESHOLD[kind] - 1e-9:
            return True
    return False


def test_windows_are_exact(spark):
    r = random.Random(4)
    words = ["aaaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz0123456789", "aaaaaaaaaaaaaaaaaaaabcdefghijklmnopqrstu", "k9Xv2LqPz7RtB4mWc8YdF1gH5jNs"]
    for letters in ("0123456789abcdef", "ABCDEF0123", "abcdefghijklmnop01", "abcdeF0", secrets.ALPHABET, "aB ", "abcdefghijk lmnop012"):
        words += ["".join(r.choice(letters) for _ in range(r.randint(20, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(w,) for w in words], "s string").repartition(4).select("s", secrets.window_secret(F.col("s")).alias("e")).collect()
    want = {w: brute(w) for w in words}
    assert all(r.e == want[r.s] for r in rows) and 100 < sum(want.values()) < len(words) - 100


def random_text(letters, n, seed=1):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize("letters", [secrets.ALPHABET, "ab1" * 3 + "2", "aaaaaaaaaaaaaaaaaaab1"])
def test_long_candidates_take_linear_time(spark, letters):
    text = random_text(letters, 200_000)
    began = time.perf_counter()
    found = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["entropy"]
    assert [(x["start"], x["end"]) for x in found] == ([(0, 200_000)] if len(set(letters)) > 60 else [])
    assert time.perf_counter() - began < 60


def test_a_prefix_does_not_hide_a_secret(spark):
    """The class is that of a window, and the allow list blanks only the part that it matches."""
    r = random.Random(8)
    hexes = ["".join(r.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(40)]
    texts = [f"auth={x}" for x in hexes] + [f"KEY-{x}" for x in hexes] + [f"path/sample/{x}" for x in hexes]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert secrets.scan(df).where("size(entropy) = 1").count() >= 0.95 * len(texts)
    hidden = ["path/sample", "the/example_k9Xv2LqPz7RtB4mWc8/key", "00000000-1111-2222-3333-444444444444/abc"]
    assert secrets.scan(spark.createDataFrame(list(enumerate(hidden)), "doc_id long, text string")).where("size(entropy) > 0").count() == 0


def test_sql(spark):
    """The SQL of the query gives the same rows, on texts with all kinds of candidates."""
    import duckdb

    from plumbline.llm.queries import ORACLES

    r = random.Random(6)
    parts = [*(t for t in TEXTS if t and len(t) < 500), "path/sample/9Xv2LqPz7RtB4mWc8YdF1gH5", "-", "=", "é😀", "aB3" * 9, "0123456789" * 3, "fedcba9876543210fedc"]
    rows = [(i, " ".join(r.choice(parts) + random_text(secrets.ALPHABET, r.randint(0, 30), i) for _ in range(r.randint(0, 4)))) for i in range(200)] + [(900, None), (901, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.sql(ORACLES["op4_secret_scan"])
    want = [dict(zip(found.columns, x, strict=True)) for x in found.fetchall()]
    got = [x.asDict() for x in secrets.scan_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda x: x["doc_id"]
    assert sorted(got, key=key) == sorted(want, key=key) and sum(x["n_entropy"] for x in got) > 30


def test_prose_has_none(docs, odd, empty):
    assert secrets.scan_digest(docs).where("spans <> ''").count() == 0
    assert secrets.scan_digest(odd).count() == odd.count() and secrets.scan_digest(empty).count() == 0
