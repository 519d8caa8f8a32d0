"""Line dedup: of all lines of all documents that are alike, one stays.

A line is compared trimmed and in lower case; lines without a letter or digit (blank ones, rules, brackets) always stay. Equal lines are one unit. Units are
alike if the Jaccard similarity of their sets of SHINGLE-character shingles is THRESHOLD or more, directly or through others (of a line shorter than a shingle
the whole line is the one shingle, so that short lines repeat only if they are equal):

1. Signatures: each shingle of a unit is a row and is hashed once; BANDS * ROWS minima are taken, each of the hash under a permutation of its own. The range
   of hashes is cut in parts, and a shingle meets the minima of its part only; the parts' minima make the unit's. ROWS minima make a band. Units, not
   lines, are signed.
2. Banding: units with an equal band share a bucket. Each is compared with the bucket's most frequent unit first. After these links are merged,
   whatever isn't in a bucket's largest component is compared, block by block, with all of the bucket that is in another component: so
   every pair of a bucket is linked, compared, or inside one component, and no pairs are listed but links.
3. Verification: the exact Jaccard similarity of the shingle sets of a pair. Pairs whose sets differ too much in size are told apart by the sizes.
4. Union: distributed connected components; of each the first line by doc_id, then row, then line stays.

Only DataFrame functions are used. Shingles are cut from UTF-32 bytes, where a code point's place is known, so that a line's work is
linear in its length. Tables in between go when they have been used, and their shuffles with them.

Defined cases: a null text has no lines and stays null; rows with the same id and text are one document and are treated alike; rows with the same id and
other text are documents of their own; null ids come first. Documents keep their row even if no line stays.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import drop_stored, let, stored

SHINGLE, THRESHOLD = 8, 0.8
BANDS, ROWS = 10, 4
#: The leading bits of a hash, which name its part of the range. 2 ** TOP parts by BANDS * ROWS >> TOP low masks (of no common factor) are all permutations.
TOP = 3
#: Lines that are compared with twice as many others in one row.
BLOCK = 32
#: Blocks on a side of a grid cell.
CELL = 8


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(" \t\r")))


def shingle(points: Column, byte: Column) -> Column:
    """The hash of the shingle that begins at a byte (from 1) of a line in UTF-32."""
    return F.xxhash64(F.substring(points, byte, F.lit(4 * SHINGLE)))


def starts(line: Column) -> Column:
    """The bytes where shingles begin."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), 4 * (F.char_length(line) - SHINGLE) + 1), F.lit(4))


def shingles(line: Column) -> Column:
    """The set of shingle hashes of a line."""
    return F.array_distinct(let(F.encode(line, "UTF-32"), lambda points: F.transform(starts(line), lambda i: shingle(points, i))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: let(F.size(F.array_intersect(p["a"], p["b"])), lambda n: n / (F.size(p["a"]) + F.size(p["b"]) - n).cast("double")))


def constant(bits: int) -> Column:
    """64 bits as a long."""
    return F.lit(bits - (bits >> 63 << 64)).cast("long")


def low_masks() -> list[int]:
    draw = random.Random(17)
    return [draw.getrandbits(64 - TOP) for _ in range(BANDS * ROWS >> TOP)]


def permutations() -> list[tuple[int, int]]:
    """For each minimum of a signature the low mask and the part that make its permutation. Those of a band have no mask and no part in common."""
    return [(k % (BANDS * ROWS >> TOP), k % (1 << TOP)) for k in range(BANDS * ROWS)]


def signed(units: DataFrame) -> DataFrame:
    """unit and bands, BANDS hashes of its signature, for units with a column line.

    All shingles of all lines count. A permutation of the hashes is an exclusive or with a constant: a low mask orders the hashes within each part, and
    the leading bits order the parts. So the least hash under it is the least one, by the low mask, of the first part that has any.
    """
    rows = units.select("unit", F.encode("line", "UTF-32").alias("points"), starts(F.col("line")).alias("starts")).select("unit", "points", F.explode("starts").alias("start"))
    rows = rows.select("unit", shingle(F.col("points"), F.col("start")).alias("hash"))
    parts = rows.groupBy("unit", F.shiftrightunsigned("hash", 64 - TOP).alias("part")).agg(*(F.min(F.col("hash").bitwiseXOR(constant(m))).alias(f"low{i}") for i, m in enumerate(low_masks())))
    least = parts.groupBy("unit").agg(*(F.min(F.col(f"low{i}").bitwiseXOR(constant(part << (64 - TOP)))).alias(f"m{k}") for k, (i, part) in enumerate(permutations())))
    return least.select("unit", F.array(*(F.xxhash64(F.lit(j), *(f"m{j * ROWS + k}" for k in range(ROWS))) for j in range(BANDS))).alias("bands"))


def row_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def all_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row (a hash that names the document), number (from 0), unit, check (two hashes of the line), line: normal lines with a letter or digit."""
    doc, text = F.col(id_col).alias("doc"), F.col(text_col)
    df = docs.select(doc, row_key(F.col(id_col), text).alias("row"), F.posexplode(F.split(text, "\n")).alias("number", "line"))
    df = df.withColumn("line", normal(F.col("line"))).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    return df.select("doc", "row", "number", F.xxhash64("line").alias("unit"), F.xxhash64(F.lit(1), "line").alias("check"), "line")


def close(m: Column, n: Column, threshold: float) -> Column:
    """Whether sets of m and n shingles can be alike."""
    return F.least(m, n) >= threshold * F.greatest(m, n)


def fixed(column: Column) -> Column:
    """column, of which Catalyst thinks that it isn't deterministic: a filter by it stays above the projection that makes it, and it is made once."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """The rows (a, b, set_a, set_b) whose sets are, as (a, b). Sets are intersected in generated code, which lambdas would leave."""
    n, both = F.col("n"), F.col("both")
    counted = pairs.select("a", "b", fixed(F.size(F.array_intersect("set_a", "set_b"))).alias("n"), (F.size("set_a") + F.size("set_b")).alias("both"))
    return counted.where(n / (both - n).cast("double") >= threshold).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of units whose shingle sets are alike."""
    a, b = (texts.select(F.col("unit").alias(x), F.col("line").alias(f"line_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    both = both.where(close(F.col("size_a"), F.col("size_b"), threshold))
    return alike(both.select("a", "b", shingles(F.col("line_a")).alias("set_a"), shingles(F.col("line_b")).alias("set_b")), threshold)


def blocks(members: DataFrame, texts: DataFrame, size: int, count: str, name: str) -> DataFrame:
    """key, part, and an array of some `size` of a bucket's members, with their lines. count: the column that says how many there are in the bucket."""
    part = F.pmod(F.xxhash64("unit"), F.ceil(F.col(count) / size)).alias("part")
    # the bands before this key's: a pair that shares one of them is compared there
    before = F.slice("bands", F.lit(1), F.array_position("bands", F.col("key")).cast("int") - 1).alias("before")
    row = F.struct("unit", "component", "outer", before, "size", "line")
    return members.join(texts, "unit").groupBy("key", "n_outer", "n_all", part).agg(F.collect_list(row).alias(name))


def cells(count: str, size: int) -> Column:
    """Into how many runs of CELL blocks a bucket's blocks of `size` members are dealt."""
    return F.ceil(F.ceil(F.col(count) / size) / CELL)


def cross_links(inside: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the components inside each bucket.

    A member outside the bucket's largest component is compared with all members of other components, block by block: a row holds two blocks, and gives
    its links only. A bucket's blocks are dealt into a grid of cells, each a task's key of its own with at most CELL blocks a side on average, so that no bucket
    is one task's work; a block goes to a row or a column of cells. Shingle sets are made once in a row, and only of lines that have a partner to be compared
    with. A pair of several common buckets is compared in the first.
    """
    kinds = inside.groupBy("key", "component").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("n_all"), F.count("*").alias("kinds")).where("kinds > 1")
    kinds = kinds.select("key", F.col("largest.component").alias("largest"), (F.col("n_all") - F.col("largest.n")).alias("n_outer"), "n_all")
    members = stored(inside.join(kinds, "key").select("key", "unit", "component", (F.col("component") != F.col("largest")).alias("outer"), "n_outer", "n_all"), "line-members")
    x_cells, y_cells = cells("n_outer", BLOCK), cells("n_all", 2 * BLOCK)
    xs = blocks(members.where("outer"), texts, BLOCK, "n_outer", "xs")
    xs = xs.select("key", F.pmod("part", x_cells).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), y_cells - 1)).alias("j"), "xs")
    ys = blocks(members, texts, 2 * BLOCK, "n_all", "ys")
    ys = ys.select("key", F.explode(F.sequence(F.lit(0).cast("long"), x_cells - 1)).alias("i"), F.pmod("part", y_cells).alias("j"), "ys")
    pairs = xs.join(ys.hint("merge"), ["key", "i", "j"])

    def new(x: Column, y: Column) -> Column:
        """Whether the pair is to be compared here."""
        return (x["component"] != y["component"]) & (~y["outer"] | (x["unit"] < y["unit"])) & close(x["size"], y["size"], threshold) & ~F.arrays_overlap(x["before"], y["before"])

    def sets(xs: Column) -> Column:
        return F.transform(xs, lambda x: F.struct(*(x[c].alias(c) for c in ("unit", "component", "outer", "before", "size")), shingles(x["line"]).alias("s")))

    def found(xs: Column, ys: Column) -> Column:
        alike = lambda x, y: F.when(new(x, y), jaccard(x["s"], y["s"]) >= threshold).otherwise(False)
        return F.flatten(F.transform(xs, lambda x: F.transform(F.filter(ys, lambda y: alike(x, y)), lambda y: F.struct(x["unit"].alias("a"), y["unit"].alias("b")))))

    open_xs = F.filter("xs", lambda x: F.exists("ys", lambda y: new(x, y)))
    open_ys = F.filter("ys", lambda y: F.exists("xs", lambda x: new(x, y)))
    both = pairs.select(fixed(open_xs).alias("xs"), open_ys.alias("ys")).where(F.size("xs") > 0)
    both = both.select(sets(F.col("xs")).alias("xs"), sets(F.col("ys")).alias("ys"))
    links = both.select(F.explode(let(F.struct("xs", "ys"), lambda p: found(p["xs"], p["ys"]))).alias("x")).select("x.*")
    links = stored(links, "line-links")
    drop_stored(members)
    return links


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """row (see row_key) and lines: the sorted numbers of its lines that repeat another line that stays. A stored table."""
    lines = all_lines(docs, id_col, text_col)
    first = F.min(F.struct(F.col("doc").isNotNull().alias("known"), "doc", "row", "number")).alias("first")
    # lines that only share a hash, which a second one tells, are left alone
    units = lines.groupBy("unit").agg(first, F.count("*").alias("n"), (F.min("check") != F.max("check")).alias("mixed"), F.first("line").alias("line"))
    units = units.where("not mixed").select("unit", "first.*", "n", "line")
    # both sides of this join read one shuffle, as the side that is signed needs all its columns too: for a condition that always holds
    needed = (F.col("n") > 0) | (F.xxhash64("known", "doc", "row", "number") > 0)
    units = stored(units.join(signed(units.where(needed)), "unit"), "line-units")

    keyed = units.select("unit", "n", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(keyed.join(several, "key"), "line-buckets")
    # the line that others are variants of is likely the one that occurs most often
    members = stored(shared.drop("n").join(shared.groupBy("key").agg(F.max_by("unit", "n").alias("chief")), "key"), "line-buckets")
    drop_stored(shared)
    texts = units.select("unit", "line", "bands").join(members.select("unit").distinct(), "unit")
    texts = stored(texts.withColumn("size", F.size(shingles(F.col("line")))), "line-texts")

    starred = stored(verified(members.where("unit <> chief").select(F.col("unit").alias("a"), F.col("chief").alias("b")).distinct(), texts, threshold), "line-links")
    linked = components(starred).withColumnRenamed("node", "unit")
    inside = members.where("size > 2 and unit <> chief").join(linked, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    inside = stored(inside.select("key", "unit", "component"), "line-components")
    drop_stored(members)
    more = cross_links(inside, texts, threshold)
    drop_stored(texts, inside)

    linked = components(starred.union(more)).withColumnRenamed("node", "unit")
    grouped = units.select("unit", F.struct("known", "doc", "row", "number").alias("first"), "n").join(linked, "unit", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "unit"))
    grouped = stored(grouped, "line-groups")
    stays = grouped.groupBy("component").agg(F.min("first").alias("stays"))
    grouped_ = grouped.join(stays, "component").select("unit", F.col("stays.row").alias("its_row"), F.col("stays.number").alias("its_number"))
    gone = lines.select("row", "number", "unit").join(grouped_, "unit").where("row <> its_row or number <> its_number")
    gone = stored(gone.groupBy("row").agg(F.sort_array(F.collect_set("number")).alias("lines")), "lines-gone")
    drop_stored(units, starred, more, grouped)
    return gone


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col, n_lines, n_removed and removed (the numbers of removed lines from 0, joined by commas) for each row of docs."""
    gone = repeated_lines(docs, id_col, text_col, **options)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col), row_key(F.col(id_col), text).alias("row"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long"))).join(gone.hint("merge"), "row", "left")
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    return rows.select(id_col, "n_lines", F.size(lines).cast("long").alias("n_removed"), F.array_join(lines.cast("array<string>"), ",").alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated lines cut from their texts, and n_chars counted again if there is such a column."""
    gone = repeated_lines(docs, id_col, text_col, **options).select(F.col("row").alias("__row"), F.col("lines").alias("__lines"))
    rows = docs.withColumn("__row", row_key(F.col(id_col), F.col(text_col))).join(gone.hint("merge"), "__row", "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("__lines", i)), "\n")
    rows = rows.withColumn("__text", F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(left))
    new = {text_col: F.col("__text")} | ({"n_chars": F.when(F.col("__lines").isNull(), F.col("n_chars")).otherwise(F.char_length("__text").cast("long"))} if "n_chars" in docs.columns else {})
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
