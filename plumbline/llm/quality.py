"""Quality rules as a short-circuit cascade.

Every rule is a boolean column that is true for a document to reject. Each rule's cost (seconds a row) and selectivity (share
rejected) are estimated on a bounded sample; rules then run by rejection per cost, highest first, inside one CASE expression, which
stops at the first rule that rejects. The order changes the cost only: a document is kept if no rule rejects it.

A rule makes what it needs from the text and its words itself, so that a document that is rejected early never pays for later rules: repeated windows, by far the dearest,
are one rule among the others (`keep_good`). Where a report of all counts is asked for (`judge`), these are worked out for every document, and the
cascade has the rules that aren't told by the counts' base verdict.

Costs are medians of several runs, each over the sample several times, less what reading takes. Rates are compared by powers of two, so that
timing noise hardly ever changes the order.

Defined cases: a null text has no words and fails the base rule; repeated rows are judged each on their own; extra columns are kept.
"""

from __future__ import annotations

import math
import statistics
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import drop_stored, let, settled, stored, words_of

#: Rows that the estimates are made on, on average; runs of each rule, and how often a run reads the sample.
SAMPLE_ROWS, RUNS, TIMES = 2000, 3, 1
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def repeat_words(words: Column) -> Column:
    """The number of words in windows of WINDOW words that occur twice or more.

    Windows are compared by 64-bit hashes, built in three doublings from hashes of the words. Only texts in which a window occurs twice sort their windows.
    """
    n = F.size(words)
    doubled = lambda h, width: F.transform(F.sequence(F.lit(0), n - 2 * width), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + width)))
    eight = let(let(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1)), lambda h: doubled(h, 2)), lambda h: doubled(h, 4))

    def covered(again: Column) -> Column:
        twice = F.filter(again, lambda x, i: (F.get(again, i - 1)["h"] == x["h"]) | (F.get(again, i + 1)["h"] == x["h"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return F.aggregate(places, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).cast("long").alias("n"), p.alias("last")))["n"]

    def counted(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, covered)).otherwise(F.lit(0).cast("long"))

    return F.when(n >= WINDOW, let(eight, counted)).otherwise(F.lit(0).cast("long"))


def n_removed(text: Column, pattern: str) -> Column:
    """How many code points the pattern's matches have."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def full_lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def with_words(docs: DataFrame, text: Column) -> DataFrame:
    """docs as the struct d, and the struct column q: text (empty for null), words, n (their number)."""
    df = docs.select(F.struct("*").alias("d"), F.coalesce(text, F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    return df.select("d", F.struct("text", "words", F.size("words").cast("long").alias("n")).alias("q"))


def base_rules(q: Column) -> dict[str, Column]:
    """The base rule, in two."""
    return {"few_words": q["n"] < MIN_WORDS, "repeats": 100 * repeat_words(q["words"]) > MAX_REPEAT_PERCENT * q["n"]}


def default_rules(q: Column) -> dict[str, Column]:
    """Rules that texts of ordinary sentences pass with room to spare."""
    share = lambda kept: F.size(F.filter(q["words"], kept)) / F.greatest(q["n"], F.lit(1))
    n = F.greatest(q["n"], F.lit(1)).cast("double")
    return {
        "symbols": n_removed(q["text"], "[#*$%&|<>]+") > 0.1 * n,
        "exclamations": n_removed(q["text"], "[!?]+") > 0.3 * n,
        "word_length": let(word_chars(q["words"]), lambda c: (c < 2 * n) | (c > 15 * n)),
        "duplicate_lines": let(full_lines(q["text"]), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x)),
        "upper_case": n_removed(q["text"], r"\p{Lu}+") > 0.4 * F.greatest(word_chars(q["words"]), F.lit(1)),
        "letters": share(lambda w: w.rlike(r"\p{L}")) < 0.7,
        "stutter": share(lambda w, i: w == F.get(q["words"], i - 1)) > 0.2,
        "ellipsis": F.size(F.filter(F.split(q["text"], "\n"), lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) > 0.3 * F.greatest(F.size(full_lines(q["text"])), F.lit(1)),
    }


def by_rate(rates: dict[str, float]) -> list[str]:
    """Names by rate, highest first; rates of the same power of two are equal and go by name."""
    power = lambda x: round(math.log2(x)) if x > 0 else -math.inf
    return sorted(rates, key=lambda k: (-power(rates[k]), k))


def rule_order(docs: DataFrame, text: Column, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of rules by rejection per cost on a sample of about sample_rows rows (twice as many at most)."""
    some = docs.sample(min(1.0, sample_rows / max(1, docs.count())), seed=7).limit(2 * sample_rows)
    sample = stored(with_words(some.repartition(8), text).select("q"), "quality-sample")
    n = max(1, sample.count())
    several = sample.select("q", F.explode(F.sequence(F.lit(1), F.lit(TIMES))).alias("time"))

    def timed(column: Column) -> tuple[float, float]:
        """Seconds of a row and the share that is rejected."""
        seconds, rejected = [], 0
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected = several.agg(F.sum(F.when(column, 1).otherwise(0))).first()[0] or 0
            seconds.append(time.perf_counter() - began)
        return statistics.median(seconds) / (TIMES * n), rejected / (TIMES * n)

    plain = F.length(F.col("q.text")) + F.size("q.words") < 0  # what reading costs
    timed(plain)
    nothing = timed(plain)[0]
    measured = {k: timed(v) for k, v in rules.items()}
    # what can't be told from nothing costs a fiftieth of the dearest
    least = max([t - nothing for t, _ in measured.values()] + [1e-9]) / 50
    order = by_rate({k: share / max(t - nothing, least) for k, (t, share) in measured.items()})
    drop_stored(sample)
    return order


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """True if no rule rejects; a rule is only looked at if those before it don't."""
    kept = F.when(F.lit(False), False)
    for name in order:
        kept = kept.when(rules[name], False)
    return kept.otherwise(True)


def judge(docs: DataFrame, text_col: str = "text", rules=default_rules, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """d (docs' row), q (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) and kept."""
    df = with_words(docs, F.col(text_col))
    q = F.col("q")
    order = rule_order(docs, F.col(text_col), rules(q), sample_rows)
    lines = let(full_lines(q["text"]), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    df = df.select("d", "q", q["n"].alias("n_words"), word_chars(q["words"]).alias("word_chars"), n_removed(q["text"], "[#*$%&|<>]+").alias("n_symbols"), lines.alias("n_dup_lines"), repeat_words(q["words"]).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    named = {"base": F.col("base_failed")} | rules(q)
    df = df.withColumn("kept", cascade(named, ["base", *order]))
    return df.select("d", F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").alias("q"), "kept")


def keep_good(docs: DataFrame, text_col: str = "text", rules=default_rules, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, base rules included, with their own columns. All rules are in one cascade."""
    every = base_rules(F.col("q")) | rules(F.col("q"))
    order = rule_order(docs, F.col(text_col), every, sample_rows)
    judged = with_words(docs, F.col(text_col)).select("d", settled(cascade(every, order)).alias("kept"))
    return judged.where("kept").select("d.*")
