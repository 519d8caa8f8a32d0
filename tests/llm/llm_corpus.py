"""A small corpus with the cases that operators must handle."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SYLLABLES = "an er on the ing ti re ha es nd ou ed ly th at".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def sentence(r, n=12):
    return " ".join(word(r) for _ in range(n)).capitalize() + "."


def prose(r, lines=5):
    return "\n".join(" ".join(sentence(r) for _ in range(r.randint(1, 4))) for _ in range(lines))


def corpus(seed=1, n=60):
    """Rows with nulls, empty, very long, repeated and nearly repeated texts, junk, odd white space, and text outside the basic plane."""
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 8)) for _ in range(n)]
    near = texts[0].replace("the", "teh", 1) if "the" in texts[0] else texts[0] + " x"
    texts += [None, "", " \n\t\v ", "one", "a b c", texts[0], texts[0], near, "no no no no " * 40, "#$% *** " * 30, "é😀 日本語 ß x\x1cy\x85z " * 9, prose(r, 400), "line of some length here twice\n" * 3]
    rows = [(i, t, r.choice(["en", None]), r.choice(["a", "b", "c", "é", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows
