"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index for pairs within a few bits, components.

Fingerprints that occur several times are one node. The index over the nodes has, from the top:

1. Shared masked patterns: each of a list of masks has a node for every pattern that it leaves of a fingerprint. Two lists are offered. `block_masks` makes the search
   exact: of six blocks of 64 bits two at least are equal in a pair within four bits, so that fifteen masks, one for each two blocks, miss none.
   `sampled_masks` serves wide radii, for which no short list is exact: each mask has a few bits drawn at random, and their number follows from
   the share of pairs (RECALL) that are to meet in some mask.
2. Under a masked pattern, fingerprints are sorted by Gray rank (the place of the fingerprint in the reflected Gray code, where neighbours differ in
   few bits). Runs of LEAF of them are leaves, and FAN nodes make a node of the next level; a node has the mask of the bits in which all below it
   agree, and their pattern. A search goes down from the top and accumulates the differences in the bits that each level adds; a node whose
   sum passes the radius is left out with all below it, and so is one whose fingerprints are all linked with the query already.

All groups of a batch are searched together, large ones and small ones by the same steps. A group emits a forest that links what it found, not its pairs. A group
of over MAX_BUCKET fingerprints is cut into chunks, and each two chunks meet in a part of their own, so that no task ever holds more.

For a similarity, `near_duplicates(..., similarity=0.8)` takes fingerprints of WIDE bits: two texts whose shingles have Jaccard similarity s, so cosine
2s / (1 + s), differ in a share acos(2s / (1 + s)) / pi of them. The radius is that share and one standard deviation more; README has how many pairs of which similarity it
links.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; rows with a null doc_id are linked but name no component unless
a group has no other (then null); repeated rows are copies.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import drop_stored, stored

SEED, MAX_BITS, SHINGLE = 42, 4, 4
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Bits of a fingerprint that is compared by similarity; the share of pairs of that similarity that meet in some sampled mask; bits of a mask, at least, and
#: how many fingerprints (as a power of two) a masked pattern may have on average before masks get more bits.
WIDE, RECALL, MASK_BITS, MASK_ROWS = 256, 0.98, 14, 12
LEAF, FAN, MAX_BUCKET = 16, 8, 8192
#: Comparisons that are made at once.
TOGETHER = 1 << 20


def fingerprint(text: str, width: int = SHINGLE, n_bits: int = 64) -> np.ndarray:
    """The SimHash of a text's word shingles, as n_bits / 64 unsigned numbers. The first one's bits are those of XXH64; others come from it by mixing."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    more = n_bits // 64
    if not words:
        return np.zeros(more, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(n_bits, np.int64)
    for i in range(0, n, 1 << 14):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 14)], stops[i : i + (1 << 14)], strict=True)], np.uint64)
        wide = np.stack([mixed(h, j) if j else h for j in range(more)], axis=1).astype("<u8")
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8").astype(np.uint64)


def mixed(h: np.ndarray, j: int) -> np.ndarray:
    """Another hash of what h is a hash of."""
    h = h + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def word_names(n_bits: int) -> list[str]:
    return [f"fp{j}" for j in range(n_bits // 64)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, n_bits: int = 64) -> DataFrame:
    """doc_id, row (a hash that names the document) and the fingerprint's words fp0, fp1, ... as signed longs."""
    names = ["doc_id", "row", *word_names(n_bits)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or "", width, n_bits) for x in batch.column(2)]
            found = np.stack(found).view(np.int64) if found else np.zeros((0, n_bits // 64), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names)

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("__text"))
    return df.mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def row_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def gray_ranks(words: list[Column]) -> list[Column]:
    """The place of the words' bits in the reflected Gray code, word by word."""
    out: list[Column] = []
    for word in words:
        for shift in (1, 2, 4, 8, 16, 32):
            word = word.bitwiseXOR(F.shiftrightunsigned(word, shift))
        # an odd number of bits before turns the order round
        out.append(word.bitwiseXOR(-out[-1].bitwiseAND(F.lit(1).cast("long"))) if out else word)
    return out


#: A mask over all words of a fingerprint.
Mask = list[int]


def block_masks(most: int) -> list[Mask]:
    """Masks over 64 bits such that any two fingerprints within `most` bits have a pattern in common."""
    if most > len(BLOCKS) - 2:
        raise ValueError(f"two of {len(BLOCKS)} blocks are equal only in pairs of {len(BLOCKS) - 2} bits or fewer")
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    one = [((1 << width) - 1) << a for width, a in zip(BLOCKS, at, strict=True)]
    return [[a | b] for a, b in combinations(one, 2)]


def share_of(similarity: float) -> float:
    """The share of bits in which texts of that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float, n_bits: int = WIDE) -> int:
    p = share_of(similarity)
    return round(n_bits * p + math.sqrt(n_bits * p * (1 - p)))


def sampled_masks(n: int, similarity: float, n_bits: int = WIDE) -> list[Mask]:
    """Masks for n fingerprints, such that a share RECALL of the pairs of that similarity has a pattern in common."""
    size = max(MASK_BITS, math.ceil(math.log2(max(2, n))) - MASK_ROWS)
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - share_of(similarity)) ** size))
    draw = random.Random(SEED)
    whole = [sum(1 << b for b in draw.sample(range(n_bits), size)) for _ in range(tables)]
    return [[(m >> (64 * j)) & ((1 << 64) - 1) for j in range(n_bits // 64)] for m in whole]


def patterns(words: list[Column], masks: list[Mask]) -> Column:
    """An array of the masked patterns, each as a hash of the mask's number and what it leaves."""
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    return F.array(*(F.xxhash64(F.lit(k), *(w.bitwiseAND(signed(m)) for w, m in zip(words, mask, strict=True) if m)) for k, mask in enumerate(masks)))


def differing(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """The number of bits, inside mask, in which rows of a and b differ."""
    x = a ^ b
    if mask is not None:
        x &= mask
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from first to last, exclusive, of each place, and the places that they belong to."""
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class GrayIndex:
    """Trees of one height, one for each of some groups. fps: rows of words; groups are runs of it, from cuts[k] to ends[k], each in order of Gray rank."""

    def __init__(self, fps: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> None:
        self.fps = fps
        #: From leaves to the top: first child, last child (exclusive), mask and pattern of each node, and the last fingerprint below it.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.cuts, self.ends = cuts, ends
        low, high, last, first, until, size = fps, fps, np.arange(1, len(fps) + 1), cuts, ends, LEAF
        while not self.levels or (until - first > 1).any():
            n = -(-(until - first) // size)
            group, k = spread(np.zeros(len(n), np.int64), n)
            begin = first[group] + k * size
            end = np.minimum(begin + size, until[group])
            low, high = self._over(np.bitwise_and, low, begin, end), self._over(np.bitwise_or, high, begin, end)
            mask, last = ~(low ^ high), last[end - 1]
            self.levels.append((begin, end, mask, low & mask, last))
            first, until, size = np.cumsum(n) - n, np.cumsum(n), FAN
        self.roots = first

    @staticmethod
    def _over(ufunc: np.ufunc, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """ufunc over x[begin:end] for each of some runs in order."""
        edges = np.stack([begin, end], axis=1).ravel()
        return ufunc.reduceat(np.concatenate([x, x[-1:]]), edges, axis=0)[::2]

    def pairs(self, queries: np.ndarray, groups: np.ndarray, most: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j), i < j, of fingerprints within `most` bits whose labels differ, for i among queries, which belong to groups (numbers)."""
        bounds = []  # the least and greatest label below each node
        low = high = labels
        for begin, end, *_ in self.levels:
            low, high = self._over(np.minimum, low, begin, end), self._over(np.maximum, high, begin, end)
            bounds.append((low, high))
        q, node = queries, self.roots[groups]
        mask, pattern = self.levels[-1][2:4]
        sums = differing(self.fps[q], pattern[node], mask[node])
        for level in range(len(self.levels) - 1, -1, -1):
            begin, end, mask, _, last = self.levels[level]
            low, high = bounds[level]
            # what ends before q has found it already
            fine = (sums <= most) & (last[node] > q + 1) & ~((low[node] == labels[q]) & (high[node] == labels[q]))
            q, node, sums = q[fine], node[fine], sums[fine]
            owner, child = spread(begin[node], end[node])
            q, sums, above = q[owner], sums[owner], mask[node][owner]
            if level:
                below, pattern = self.levels[level - 1][2:4]
                sums = sums + differing(self.fps[q], pattern[child], below[child] & ~above)
            else:
                sums = sums + differing(self.fps[q], self.fps[child], ~above)
            node = child
        fine = (sums <= most) & (node > q)
        return q[fine], node[fine]


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels after i and j are linked: each the least place that can be reached."""
    while len(i):
        a, b = labels[i], labels[j]
        m = np.minimum(a, b)
        open_ = a != b
        if not open_.any():
            break
        np.minimum.at(labels, a[open_], m[open_])
        np.minimum.at(labels, b[open_], m[open_])
        while True:
            nearer = labels[labels]
            if (nearer == labels).all():
                break
            labels = nearer
    return labels


def forest(groups: np.ndarray, fps: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places that are linked to the first one of their component inside each group. groups: in runs, each in order of Gray rank; fps: rows of words."""
    n = len(fps)
    labels = np.arange(n)
    cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]])) if n else np.zeros(1, np.int64)
    first, sizes = cuts[:-1], np.diff(cuts)
    # neighbours in Gray order and the first of the group: links that spare most others
    inner = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    inner = inner[inner != np.repeat(first, sizes)[inner]]
    for other in (inner - 1, np.repeat(first, sizes)[inner]):
        near = differing(fps[inner], fps[other]) <= most
        labels = join_labels(labels, other[near], inner[near])
    height = np.zeros(len(sizes), np.int64)
    nodes = -(-sizes // LEAF)
    while (nodes > 1).any():
        height += nodes > 1
        nodes = -(-nodes // FAN)
    for h in np.unique(height[sizes > 1]):
        some = np.flatnonzero((height == h) & (sizes > 1))
        index = GrayIndex(fps, first[some], cuts[1:][some])
        owner, queries = spread(first[some], cuts[1:][some])
        # as many queries at once as have TOGETHER fingerprints to meet
        batch = np.cumsum(sizes[some][owner]) // TOGETHER
        for part in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(batch)) + 1):
            labels = join_labels(labels, *index.pairs(queries[part], owner[part], most, labels))
    linked = np.flatnonzero(labels != np.arange(n))
    return linked, labels[linked]


def links(nodes: DataFrame, masks: list[Mask], most: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """nodes: node and its words fp0, fp1, .... Edges (a, b) between nodes that link all fingerprints within `most` bits that share a masked
    pattern, directly or through others."""
    names = word_names(64 * len(masks[0]))
    keyed = nodes.select("node", *names, F.explode(patterns([F.col(c) for c in names], masks)).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket).select("key", F.ceil(F.col("n") / (max_bucket // 2)).cast("int").alias("chunks"))
    keyed = keyed.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(k, own) * F.col("chunks") + F.greatest(k, own))
    parts = keyed.select("key", "node", *names, F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array_distinct(meets))).alias("part"))
    parts = parts.select("key", F.col("part").cast("long"), "node", *names).repartition("key", "part").sortWithinPartitions("key", "part", *gray_ranks([F.col(c) for c in names]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group so far, which may go on
        last = False
        batches = iter(batches)
        while not last:
            batch = next(batches, None)
            last = batch is None
            new = None if last else np.stack([c.to_numpy() for c in batch.columns], axis=1)
            parts_ = [x for x in (held, new) if x is not None]
            if not parts_:
                return
            table = np.concatenate(parts_)
            group = np.cumsum(np.concatenate([[0], (table[1:, :2] != table[:-1, :2]).any(axis=1)]))[: len(table)]
            cut = len(table) if last else int(np.searchsorted(group, group[-1])) if len(table) else 0
            held = table[cut:]
            a, b = forest(group[:cut], np.ascontiguousarray(table[:cut, 3:]).view(np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[x, 2])) for x in (a, b)], ["a", "b"])

    return parts.mapInArrow(rows, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, most: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """doc_id, row, node, component, component_id and the fingerprint's words for each row of docs; component_id is the smallest doc_id that can be reached by links, its
    own included. With a similarity, fingerprints have WIDE bits and link at the radius of that similarity; without, they have 64 and link at `most` bits."""
    n_bits = 64 if similarity is None else WIDE
    names = word_names(n_bits)
    signed = stored(fingerprints(docs, id_col, text_col, width, n_bits), "simhash")
    node = F.col("fp0") if similarity is None else F.xxhash64(*names)
    signed = signed.withColumn("node", node)
    nodes = stored(signed.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in names)), "simhash-nodes")
    if similarity is None:
        found = links(nodes, block_masks(most), most)
    else:
        found = links(nodes, sampled_masks(nodes.count(), similarity), radius(similarity))
    named = nodes.select("node", "least").join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return signed.join(named.join(smallest, "component").select("node", "component", "component_id"), "node").select("doc_id", "row", "node", "component", "component_id", *names)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays, with its own columns.

    Rows without an id go if the component has one with an id; of rows with equal ids and different texts the first by hash stays, and of repeated rows one. Texts that aren't linked
    stay, whatever their ids.
    """
    found = stored(near_duplicates(docs, id_col, text_col, **options).select("doc_id", "row", "component"), "simhash-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))["row"].alias("__row")
    kept = found.groupBy("component").agg(first).join(found.groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("__n")), "__row").select("__row", "__n")
    kept = stored(kept, "simhash-kept")
    drop_stored(found)
    rows = docs.withColumn("__row", row_key(F.col(id_col), F.col(text_col))).join(kept.hint("merge"), "__row")
    several = rows.where("__n > 1").dropDuplicates(["__row"])
    return rows.where("__n = 1").select(*docs.columns).union(several.select(*docs.columns))
