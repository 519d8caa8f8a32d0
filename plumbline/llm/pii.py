"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds (email, ip, card, phone) are reported whenever their pattern and its check hold. Two further kinds are added: iban (mod-97
must hold) and ssn (a pattern too weak by itself, which needs a context word). A span's score starts at its kind's prior, rises when a word of the
kind's list stands within CONTEXT characters of it and falls for words that speak against it; added kinds need MIN_SCORE.

Defined cases: a null text is empty, without spans. A document is one row in, one row out, whole; batches bound the memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared as _  # noqa: F401  functions travel with the job

CONTEXT, MIN_SCORE = 48, 0.5
#: Patterns of the base kinds, in the order in which they are listed.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ADDED = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"),
    "ssn": re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
}
#: Characters of an IBAN by country.
IBAN_SIZE = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "isbn", "order", "build")
SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def small(part: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def digits_of(match: str) -> str:
    return re.sub("[^0-9]", "", match)


def card_ok(match: str) -> bool:
    digits = digits_of(match)
    return 13 <= len(digits) <= 19 and luhn(digits)


CHECK = {
    "email": lambda m: True,
    "ip": lambda m: all(map(small, m.split("."))),
    "card": card_ok,
    "phone": lambda m: 9 <= len(digits_of(m)) <= 15,
    "iban": mod97,
    "ssn": lambda m: True,
}
#: The ip pattern as it is searched for: a match never begins inside a run of digits, since it would begin with the run, and gives no digit back. So each run is
#: read a few times at most.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
#: A character without which a kind's pattern can't match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The email pattern's matches, in time linear in the text: the part before an @ is the run that ends there, from where the
    last match ended."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = start < at and DOMAIN.match(text, at + 1)
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs whose mod-97 holds. The pattern may take words that follow: a candidate ends at its country's size, or, of a country that isn't listed,
    at the last word's end where mod-97 holds. After one that fails the search goes on inside it."""
    m = ADDED["iban"].search(text)
    while m:
        start, at = m.start(), m.start() + 1
        places = [i + 1 for i in range(start, m.end()) if text[i] != " "]
        size = IBAN_SIZE.get(text[start : start + 2])
        ends = reversed(places[14:]) if size is None else places[size - 1 : size]
        for end in ends:
            if not WORD_CHAR.match(text, end) and mod97(text[start:end]):
                yield start, end
                at = end
                break
        m = ADDED["iban"].search(text, at)


WORD_CHAR = re.compile("[A-Za-z0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def score(text: str, kind: str, start: int, end: int) -> float:
    near = re.findall(r"\w+", (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower())
    value = PRIOR[kind] + 0.3 * any(w.startswith(WORDS[kind]) for w in near) - 0.3 * any(w in AGAINST for w in near)
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """kind, start, end, score, by kind and then start."""
    found = []
    for kind, pattern in (BASE | ADDED).items():
        if NEEDS.get(kind, "") not in text:
            continue
        places = emails(text) if kind == "email" else ibans(text) if kind == "iban" else (m.span() for m in (IP if kind == "ip" else pattern).finditer(text))
        for start, end in places:
            if CHECK[kind](text[start:end]):
                value = score(text, kind, start, end)
                if kind in BASE or value >= MIN_SCORE:
                    found.append((kind, start, end, value))
    return found


def mask(text: str | None) -> str:
    """text with every span replaced by its kind in angle brackets; of spans that overlap, the earlier and longer one counts."""
    out, at, text = [], 0, text or ""
    for kind, start, end, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, counts of base spans, the digest of base spans, all spans, their scores."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for value in batch.column(1):
                found = find(value.as_py() or "")
                base = [x for x in found if x[0] in BASE]
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(x[0] == kind for x in base))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in base).encode()).hexdigest())
                out["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found))
                out["scores"].append(",".join(f"{x[3]:g}" for x in found))
            arrays = [pa.array(out[n], pa.int64() if n.startswith("n_") else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, *names])

    df = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    return df.mapInArrow(rows, f"`{id_col}` {df.schema[0].dataType.simpleString()}, {SCHEMA}")
