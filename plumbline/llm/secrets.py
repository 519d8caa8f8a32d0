"""Secret scans: patterns of known secrets, and sliding-window entropy over candidate strings.

Spans are found without Python: regexp_extract_all has the matches and split by the same pattern the text between them, so that running
sums of their lengths are code-point offsets. Candidates for the entropy scan are runs of at least 20 characters of the base64 alphabets ("=" parts them)
that have two digits and two letters. Parts of a candidate between slashes that the allow list matches (placeholders, UUIDs, counted numbers) are blanked; the rest of it is
still scanned. A window of 20 characters without a blank has a class of its own, by the characters in it: hex digits of one case, letters of one case with
digits, or the wide alphabet. The class sets the threshold that the window's Shannon entropy must reach. Counts of characters and of classes are kept
from window to window: each step adds one character and takes one away, in counts of five bits that share six numbers.

Defined cases: a null text is empty, without spans. One pass, no shuffle; a document's work is linear in its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import let

#: The base patterns, and the group and length that a match needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16)}
#: For the hex pattern: passes over runs that are too short without a match for each; the matches that stay are the same.
LONG_HEX = r"[0-9a-f]{16,}+"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+"
WINDOW = 20
#: Bits a character in some window, by its class; 20 random hex digits have about 3.3, letters of one case with digits 3.8, base64 characters 4.1.
THRESHOLD = {"hex": 2.9, "single": 3.5, "wide": 3.75}
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|1234567|abcdef|(?:^|[^0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: The alphabet, in whose order characters are numbered; counts of five bits, of which a number holds twelve.
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_-"
BITS, EACH = 5, 12
#: Offsets are summed over this many matches at once.
CHUNK = 256


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, match) of the matches whose group has at least `least` characters; empty if the pattern isn't there."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    kind = "array<struct<start:bigint,end:bigint,text:string>>"
    pieces = F.transform(F.arrays_zip(found.alias("m"), between.alias("g"), inner.alias("i")), lambda x: F.struct(F.char_length(x["g"]).cast("long").alias("gap"), F.char_length(x["m"]).cast("long").alias("size"), x["m"].alias("m"), F.char_length(x["i"]).alias("inner")))
    pieces = F.filter(pieces, lambda x: x["m"].isNotNull())  # the text after the last match

    def place(chunk: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast(kind).alias("out"))
        step = lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), F.when(x["inner"] >= least, x["m"]).alias("text")))).alias("out"))
        return F.aggregate(chunk, start, step)["out"]

    def chunked(p: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, F.lit(CHUNK)))
        state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["gap"] + x["size"])
        return F.flatten(F.aggregate(chunks, state, lambda s, c: F.struct((s["at"] + total(c)).alias("at"), F.concat(s["out"], F.array(place(c, s["at"]))).alias("out")))["out"])

    # a fold over one value names the pieces, which are then made once
    placed = F.aggregate(F.array(pieces), F.array().cast(kind), lambda s, p: F.when(F.size(p) > 0, chunked(p)).otherwise(s))
    return F.when(text.rlike(pattern), F.filter(placed, lambda x: x["text"].isNotNull())).otherwise(F.array().cast(kind))


def blanked(s: Column) -> Column:
    """A candidate with blanks for what the allow list suppresses, of the same length."""
    parts = F.transform(F.split(s, "/"), lambda x: F.when(x.rlike(ALLOWED), F.repeat(F.lit(" "), F.char_length(x))).otherwise(x))
    return F.when(s.rlike(ALLOWED), F.array_join(parts, "/")).otherwise(s)


def window_secret(s: Column) -> Column:
    """Whether a window of WINDOW characters of s (ASCII) without blanks reaches the threshold of its class."""
    part = lambda c: c * F.log2(F.greatest(c, F.lit(1)).cast("double"))
    # a character's number, and its classes: digit, lower or upper letter of hex, other lower, other upper, sign, blank
    number = {c: k for k, c in enumerate(ALPHABET)}
    number[" "] = len(ALPHABET)
    kind = lambda c: 0 if c.isdigit() else 6 if c == " " else 5 if not c.isalpha() else (1 if c in "abcdef" else 3) if c.islower() else 2 if c in "ABCDEF" else 4
    numbers = F.array(*(F.lit(number.get(chr(k), 0)) for k in range(128)))
    kinds = F.array(*(F.lit(1 << (BITS * kind(chr(k)))).cast("long") for k in range(128)))
    slots = -(-(len(ALPHABET) + 1) // EACH)
    #: Of all windows so far: the counts of the characters, of the classes, the sum of c log2 c, and whether one was found.
    state = F.struct(F.array_repeat(F.lit(0).cast("long"), slots).alias("n"), F.lit(0).cast("long").alias("kinds"), F.lit(0.0).alias("sum"), F.lit(False).alias("found"))

    def count(n: Column, k: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(n, F.floor(k / EACH).cast("int")), (k % EACH) * BITS).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def moved(n: Column, k: Column, by: int) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (k % EACH) * BITS)
        return F.transform(n, lambda x, i: F.when(i == F.floor(k / EACH).cast("int"), x + by * one).otherwise(x))

    def step(points: Column, a: Column, i: Column) -> Column:
        """Take the character that the window leaves away, then add the one that it meets."""
        code = lambda j: F.get(points, j)

        def drop(a: Column, c: Column) -> Column:
            k = F.get(numbers, c)
            return let(count(a["n"], k), lambda m: F.struct(moved(a["n"], k, -1).alias("n"), (a["kinds"] - F.get(kinds, c)).alias("kinds"), (a["sum"] + part(m - 1) - part(m)).alias("sum"), a["found"].alias("found")))

        def meet(a: Column, c: Column) -> Column:
            k = F.get(numbers, c)
            return let(count(a["n"], k), lambda m: F.struct(moved(a["n"], k, 1).alias("n"), (a["kinds"] + F.get(kinds, c)).alias("kinds"), (a["sum"] + part(m + 1) - part(m)).alias("sum"), a["found"].alias("found")))

        def judged(a: Column) -> Column:
            has = lambda k: F.shiftrightunsigned(a["kinds"], BITS * k).bitwiseAND(F.lit(31).cast("long")) > 0
            lower, upper = has(1) | has(3), has(2) | has(4)
            least = F.when(has(5) | (lower & upper), THRESHOLD["wide"]).when(has(3) | has(4), THRESHOLD["single"]).otherwise(THRESHOLD["hex"])
            found = (i >= WINDOW - 1) & ~has(6) & (math.log2(WINDOW) - a["sum"] / WINDOW >= least - 1e-9)
            return F.struct(a["n"].alias("n"), a["kinds"].alias("kinds"), a["sum"].alias("sum"), found.alias("found"))

        after = let(F.when(i >= WINDOW, let(code(i - WINDOW), lambda c: drop(a, c))).otherwise(a), lambda a: let(code(i), lambda c: meet(a, c)))
        return F.when(a["found"], a).otherwise(let(after, judged))

    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    return let(codes, lambda points: F.aggregate(F.sequence(F.lit(0), F.size(points) - 1), state, lambda a, i: step(points, a, i))["found"])


def is_secret(s: Column) -> Column:
    """Whether a candidate string has a window that is secret by its entropy."""
    return let(blanked(s), lambda x: F.when(x.rlike(r"[0-9].*[0-9]") & x.rlike("[A-Za-z].*[A-Za-z]"), window_secret(x)).otherwise(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, assign, access, hex, entropy: arrays of (start, end, text), end exclusive, in order of start."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text = F.col("__text")
    df = df.withColumns({k: spans(text, LONG_HEX if k == "hex" else p, g, n) for k, (p, g, n) in BASE.items()} | {"entropy": spans(text, CANDIDATE, 0, WINDOW)})
    new = lambda x: ~F.exists("assign", lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"])) & ~F.exists("access", lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"])) & ~F.exists("hex", lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]))
    return df.withColumn("entropy", F.filter("entropy", lambda x: is_secret(x["text"]) & new(x))).drop("__text")


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the columns' spans by start, then by the order of kinds, joined by commas."""
    each = [F.transform(k, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("k"), x["end"].alias("end"))) for i, k in enumerate(kinds)]  # noqa: B023
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def scan_digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(listed([*BASE]).cast("binary"), 256).alias("base_sha256"), listed([*BASE, "entropy"]).alias("spans"), F.size("entropy").cast("long").alias("n_entropy"))
