"""LM scoring: cross-entropy difference between a target and a background bigram model.

Both models are over the ids of one public tokenizer (the shared vocabulary), of the same order and smoothing: the probability of an id after
another is (c(v, w) + PRIOR * p(w)) / (c(v) + PRIOR), with p(w) = (c(w) + 1) / (N + size of the vocabulary). The target's counts are those of a table of target
texts, the background's those of all documents. A document's score is the mean over its tokens of the target's loss less the background's, in nats: the
lower, the more it is like the target.

No table of bigrams is collected or broadcast, since it grows with the corpus. Documents are dealt into groups in the order in which they are read, each of GROUP_ROWS
documents and GROUP_CHARS characters at most (a single longer text is a group): what ids or texts they have doesn't matter, so that no id or group of copies
makes a large one. Texts are encoded once, and their ids stored. A group lists its distinct bigrams with their counts once. Summed over groups these lists are the background model; joined with the
models by bigram, they come back to their group with the counts that the group's documents need. Only the counts of single ids, as many as the vocabulary has,
go to every worker.

Defined cases: a null or empty text has 0 tokens and null losses and score; repeated rows are scored alike; without target texts or documents the smoothing
alone decides. Documents with a null id are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import stored
from plumbline.llm.wordids import WordIds, word_ids

PRIOR, GROUP_ROWS, GROUP_CHARS = 8.0, 2048, 1 << 24
#: Documents of a group that are encoded at once.
TOGETHER = 256
SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def bigrams(ids: np.ndarray, size: int) -> np.ndarray:
    """The number of each id's bigram with the id before it; before the first one stands `size`."""
    before = np.concatenate([[size], ids[:-1]]) if len(ids) else ids
    return before.astype(np.int64) * (size + 1) + ids


def id_type(size: int) -> str:
    """How the ids of a vocabulary of that size are stored."""
    return "<u2" if size < 1 << 16 else "<u4"


def grouped(docs: DataFrame, id_col: str, text_col: str, group_rows: int, tokenizer_path: str, size: int) -> DataFrame:
    """group, doc_id, ids (of id_type): a stored table, since groups must be the same whenever it is read."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, group, rows, chars = word_ids(tokenizer_path), TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                texts, groups = [t or "" for t in some.column(1).to_pylist()], []
                for text in texts:
                    if rows and (rows >= group_rows or chars + len(text) > GROUP_CHARS):
                        group, rows, chars = group + 1, 0, 0
                    rows, chars = rows + 1, chars + len(text)
                    groups.append(group)
                ids = [np.frombuffer(x, "<u4").astype(id_type(size)).tobytes() for x in model.encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), some.column(0), pa.array(ids, pa.binary())], ["group", "doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(dealt, "group long, doc_id long, ids binary"), "lm-docs")


def counted(rows: DataFrame, size: int) -> DataFrame:
    """group, bigram, n."""

    def count(table: pa.Table) -> pa.Table:
        texts = table.column("ids").to_pylist()
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in range(0, len(texts), TOGETHER):
            found = [bigrams(np.frombuffer(x, id_type(size)).astype(np.int64), size) for x in texts[i : i + TOGETHER]]
            new, more = np.unique(np.concatenate(found), return_counts=True)
            both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, n = both, np.bincount(where, np.concatenate([n, more]), len(both)).astype(np.int64)
        group = pa.array(np.full(len(keys), table.column("group")[0].as_py(), np.int64))
        return pa.table({"group": group, "bigram": pa.array(keys), "n": pa.array(n)})

    return rows.groupBy("group").applyInArrow(count, "group long, bigram long, n long")


def singles(model: DataFrame, count: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each id stands before another one, and how often it stands at all: two numbers for each id of the vocabulary."""
    before, own = np.zeros(size + 1), np.zeros(size + 1)
    for out, key in ((before, F.floor(F.col("bigram") / (size + 1))), (own, F.col("bigram") % (size + 1))):
        for r in model.groupBy(key.cast("int").alias("id")).agg(F.sum(count).alias("n")).collect():
            out[r["id"]] = r["n"] or 0
    return before, own


def score(docs: DataFrame, target: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", group_rows: int = GROUP_ROWS, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (nats a token) and score for each row of docs."""
    size = WordIds(tokenizer_path).tokenizer.get_vocab_size()
    rows = grouped(docs, id_col, text_col, group_rows, tokenizer_path, size)
    wanted = stored(counted(rows, size), "lm-groups")
    target_counts = counted(grouped(target, target_id, target_text, group_rows, tokenizer_path, size), size).groupBy("bigram").agg(F.sum("n").alias("c_target"))
    models = wanted.groupBy("bigram").agg(F.sum("n").alias("c_background")).join(target_counts, "bigram", "full")
    models = stored(models, "lm-models")
    tables = docs.sparkSession.sparkContext.broadcast([singles(models, c, size) for c in ("c_target", "c_background")])
    answers = wanted.select("group", "bigram").join(models, "bigram").select("group", "bigram", F.coalesce("c_target", F.lit(0)).alias("c_target"), F.coalesce("c_background", F.lit(0)).alias("c_background"))

    def losses(keys: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        before, own = table
        v, w = np.divmod(keys, size + 1)
        single = (own[w] + 1) / (own.sum() + size)
        return -np.log((counts + prior * single) / (before[v] + prior))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCORES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        key = right.column("bigram").to_numpy()
        order = np.argsort(key)
        key = key[order]
        loss = [losses(key, right.column(c).to_numpy()[order], t) for c, t in zip(("c_target", "c_background"), tables.value, strict=True)]
        out = []
        for doc, x in zip(left.column("doc_id").to_pylist(), left.column("ids").to_pylist(), strict=True):
            at = np.searchsorted(key, bigrams(np.frombuffer(x, id_type(size)).astype(np.int64), size))
            n = len(at)
            a, b = (float(s[at].sum()) / n if n else None for s in loss)
            out.append((doc, n, round(a, 6), round(b, 6), round(a - b, 6)) if n else (doc, 0, None, None, None))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return rows.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(scored, SCORES)
