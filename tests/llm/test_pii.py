import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-% Z9é", max_size=40))
def test_emails_as_the_pattern_has_them(text):
    assert list(pii.emails(text)) == [m.span() for m in EMAIL.finditer(text)]


PATTERNS = {"email": EMAIL, "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def base_brute(text):
    """The base spans by their definition alone."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and not all(int(x) <= 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits[::-1])]
                if not 13 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(alphabet="12.0 5-+()@aé", max_size=60), st.lists(st.sampled_from(["4111 1111 1111 1111", "10.0.0.255", "256.1.1.1", "1.2.3", ".", "1", " ", "+1 (974) 555-3436", "a@b.cd", "-", "+", "00", "😀"]), max_size=9).map("".join)))
def test_base_spans_as_defined(text):
    assert [x[:3] for x in pii.find(text) if x[0] in pii.BASE] == base_brute(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail a.b@c-d.example.com.", ["email:5:24"]),
        ("ip 10.0.0.255 and 10.0.0.256", ["ip:3:13"]),
        ("0000000000000000000000000255.1.1.1", ["ip:0:34"]),
        ("4111 1111 1111 1111, 4111-1111-1111-1112", ["card:0:19"]),
        ("call +1 (974) 555-3436 now", ["phone:5:22"]),
        ("+1 23", []),
        ("IBAN DE89 3704 0044 0532 0130 00", ["iban:5:32"]),
        ("IBAN DE89 3704 0044 0532 0130 01", []),
        ("ssn 123-45-6789", ["ssn:4:15"]),
        ("part 123-45-6789", []),
        ("😀 x@y.zz", ["email:2:8"]),
    ],
)
def test_spans(text, found):
    assert [f"{k}:{a}:{b}" for k, a, b, _ in pii.find(text)] == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("GB82 WEST 1234 5698 7654 32 BIC NWBKGB2L", ["iban:0:27"]),
        ("GB82 WEST 1234 5698 7654 32 EUR 500", ["iban:0:27"]),
        ("DE89370400440532013000 OR", ["iban:0:22"]),
        ("GB82WEST12345698765432 5 days", ["iban:0:22"]),
        ("NR AB12 GB82WEST12345698765432 DE89370400440532013000", ["iban:8:30", "iban:31:53"]),
        ("ZZ33WEST12345698765432 EUR", ["iban:0:22"]),
        ("GB82WEST1234569876543201 5 days", []),
        ("GB82WEST12345698765433 5 days", []),
    ],
)
def test_ibans_before_other_words(text, found):
    assert [f"{k}:{a}:{b}" for k, a, b, _ in pii.find(text) if k == "iban"] == found


@pytest.mark.parametrize("part", ["a", "a.@", "1 ", "+", "1.", "1", "1-", "A", "AB12 ", "+1(", "a@", "9.9.9 "])
@pytest.mark.parametrize("tail", ["", ".", "1." * 3, "@b", "+1-", "(+"])
def test_long_texts_take_linear_time(part, tail):
    """Runs of all that a pattern may repeat, with the other characters that patterns need."""
    began = time.perf_counter()
    pii.find(part * (200_000 // len(part)) + tail + "+ @ . -")
    assert time.perf_counter() - began < 5


def test_context_moves_scores():
    score = lambda t: pii.find(t)[0][3]
    assert score("server 10.0.0.1") > score("thing 10.0.0.1") > score("version 10.0.0.1")


def test_mask():
    assert pii.mask("to a@b.cd from 10.0.0.1") == "to <email> from <ip>"
    assert pii.mask(None) == ""


def test_scan(spark, docs, odd, empty):
    rows = {r["doc_id"]: r for r in pii.scan(spark.createDataFrame([(1, "a@b.cd 10.0.0.1 x@y.zz"), (2, None), (None, "")], "doc_id long, text string")).collect()}
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[1]["spans"]) == (2, 1, "email:0:6,email:16:22,ip:7:15")
    assert rows[1]["base_sha256"] == hashlib.sha256(rows[1]["spans"].encode()).hexdigest()
    assert rows[2]["base_sha256"] == rows[None]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.scan(docs).where("spans <> ''").count() == 0
    assert pii.scan(odd).count() == odd.count() and pii.scan(empty).count() == 0
