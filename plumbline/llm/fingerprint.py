"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph (a line of the text) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, the first LANES
modulo 2**64 and the other SKETCH modulo 2**16. Sums don't depend on order, and a paragraph is inserted or deleted by adding or
subtracting its vector (`add`, `subtract`), without the rest of the text. Lanes of the first part are independent hashes of the whole paragraph and decide
equality of multisets. The second part is a count sketch of the paragraph's word triples, so that the cosine of two of them, as signed
numbers, estimates how alike two documents are: 1 for equal, near 0 for unrelated ones.

Paragraph order doesn't count, by design: the same paragraphs in another order have the same fingerprint.

Defined cases: a null text is empty; the empty text has one paragraph, the empty one; fewer than three words make one piece.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared as _  # noqa: F401  functions travel with the job

LANES, SKETCH = 8, 128
N_BYTES = LANES * 8 + SKETCH * 2
#: Words whose hashes a worker keeps.
KEPT_WORDS = 200_000


class Hasher:
    """Fingerprints of texts, as bytes; keeps hashes of words it has met."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def sketch(self, paragraph: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Lane and sign of each word triple of a paragraph."""
        known = self.words
        hashes = []
        for w in paragraph.split():
            h = known.get(w)
            if h is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                h = known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        n = max(1, len(h) - 2)
        mixed = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
        for i in range(min(3, len(h))):
            mixed = (mixed ^ h[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(32)
        return (mixed & np.uint64(SKETCH - 1)).astype(np.int64), ((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1

    def of(self, text: str) -> bytes:
        lanes, where, signs = np.zeros(LANES, np.uint64), [], []
        for paragraph in text.encode("utf-8", "surrogatepass").split(b"\n"):
            lanes += np.frombuffer(hashlib.blake2b(paragraph, digest_size=LANES * 8).digest(), np.uint64)
            a, b = self.sketch(paragraph)
            where.append(a)
            signs.append(b)
        counts = np.bincount(np.concatenate(where), np.concatenate(signs), SKETCH).astype(np.int64)
        return lanes.tobytes() + (counts & 0xFFFF).astype(np.uint16).tobytes()


def parts(fingerprint: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(fingerprint, np.uint64, LANES), np.frombuffer(fingerprint, np.uint16, SKETCH, LANES * 8)


def add(a: bytes, b: bytes) -> bytes:
    """The fingerprint of both multisets together."""
    return b"".join((x + y).tobytes() for x, y in zip(parts(a), parts(b), strict=True))


def subtract(a: bytes, b: bytes) -> bytes:
    """The fingerprint of a without b's paragraphs."""
    return b"".join((x - y).tobytes() for x, y in zip(parts(a), parts(b), strict=True))


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal fingerprints, else the cosine of their sketches, 0 at least and below 1."""
    if a == b:
        return 1.0
    x, y = (parts(f)[1].view(np.int16).astype(np.float64) for f in (a, b))
    size = float(np.sqrt((x @ x) * (y @ y)))
    return round(min(0.999999, max(0.0, float(x @ y) / size)), 6) if size else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint (binary), a row for each row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hasher.of(x.as_py() or "") for x in batch.column(1)], pa.binary())], [id_col, "fingerprint"])

    df = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    return df.mapInArrow(rows, f"`{id_col}` {df.schema[0].dataType.simpleString()}, fingerprint binary")


#: Documents in a range of neighbours, on average, while there are fewer than MAX_RANGES ranges; beyond, ranges are longer.
RANGE_ROWS, MAX_RANGES = 4096, 1 << 16
EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each document its fingerprint, that of the text in which the next document's beginning replaces its second half, and likenesses.

    The next document is the one with the next higher id, after the last the first; repeated ids come in order of their text, null ids first. Texts are
    shuffled once, into ranges of ids. A range's last document needs the first one of the next range, which goes to both: only the ranges' bounds
    and least ids (two numbers for each of at most MAX_RANGES ranges) are gathered.
    """
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = df.select("id")
    n = ids.count()
    ranges = min(n // range_rows, MAX_RANGES)
    bounds = sorted({int(x) for x in ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))}) if ranges > 1 else []
    df, ids = (x.withColumn("range", _upto(F.col("id"), bounds)) for x in (df, ids))
    least = {r["range"]: r["least"]["id"] for r in ids.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("least")).collect()}
    order = sorted(least)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    everywhere = range(len(bounds) + 1)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(_numbers([before.get(r, 0) for r in everywhere]), F.col("range")).cast("int").alias("range"), F.lit(True).alias("guest"))
    is_least = F.col("id").eqNullSafe(F.get(_numbers([least.get(r) for r in everywhere]), F.col("range")))
    df = df.select("id", "text", F.explode(F.when(is_least, F.array(own, guest)).otherwise(F.array(own))).alias("x")).select("x.range", "x.guest", "id", "text")
    df = df.repartition("range").sortWithinPartitions("range", "guest", F.col("id").asc_nulls_first(), "text")
    return df.mapInArrow(_edits, EDIT_SCHEMA)


def _numbers(values: list[int | None]) -> Column:
    """A constant array of longs, however many."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _upto(x: Column, bounds: list[int]) -> Column:
    """The number of bounds, which are in order, that are at most x, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.get(_numbers(bounds), mid) <= x)
        return F.struct(F.when(right, mid + 1).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(mid).alias("high"))

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.when(x.isNull(), 0).otherwise(F.aggregate(steps, start, halve)["low"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    names = [x.split()[0] for x in EDIT_SCHEMA.split(", ")]

    def done(doc: tuple, text: str, fingerprint: bytes) -> tuple:
        half = len(doc[1]) // 2
        edited = doc[1][: len(doc[1]) - half] + text[:half]
        new = doc[2] if edited == doc[1] else hasher.of(edited)
        return doc[0], len(doc[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), doc[2].hex(), new.hex(), likeness(doc[2], new), likeness(doc[2], fingerprint)

    waiting, at = None, None  # the document that awaits its next one, and its range
    for batch in batches:
        out = []
        for r, guest, i, t in zip(*(batch.column(k) for k in range(4)), strict=True):
            r, guest, i, t = r.as_py(), guest.as_py(), i.as_py(), t.as_py()
            if r != at:
                waiting, at = None, r
            if guest and waiting is None:
                continue  # a repeated least id: the first of them has served
            fingerprint = hasher.of(t)
            if waiting is not None:
                out.append(done(waiting, t, fingerprint))
            waiting = None if guest else (i, t, fingerprint)
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
