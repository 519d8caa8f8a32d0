"""Token counts without token ids: Viterbi over a unigram vocabulary that carries a best score and a piece count.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each character of a word; the dynamic program keeps,
for each position, the best score of a way to cut the text before it and the number of tokens on that way. Nothing is traced back.

The model's rules, which are those of the `tokenizers` library's Unigram model behind its Metaspace pre-tokenizer: spaces become "▁" and
one stands before the text; a word starts at each "▁". Of two ways with equal scores the one whose last piece is longer wins (the one found first, going
from left to right by start). A character that is no piece itself costs the least score less UNKNOWN_PENALTY and, with byte fallback, counts as its UTF-8
bytes; without it, a run of such characters counts as one token.

Words are independent of each other, so that a worker keeps the counts of words it has met. A line feed is in no piece and cuts
a word in two parts, which are independent as well while scores are whole numbers, whose sums are exact, and bytes stand for unknown characters.

Defined cases: a null or empty text has 0 tokens; a text is counted whole, however long. Rows in, rows out: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared as _  # noqa: F401  functions travel with the job

#: Fixed values of the tokenizer: the sign for a space, and what an unknown character costs below the least score.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Parts of texts whose counts a worker keeps.
KEPT = 400_000


class Unigram:
    """Counts the tokens of texts. pieces: (piece, score) in order of id; control pieces and byte pieces must not be among them."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.trie = ahocorasick.Automaton()
        for piece, score in pieces:
            self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p: s for p, s in pieces if len(p) == 1}
        self.bytes = byte_fallback
        # whether a line feed cuts a word: without byte fallback it could join a run of unknown characters
        self.cuts = byte_fallback and all(float(s).is_integer() for _, s in pieces) and not any("\n" in p for p, _ in pieces)
        self.kept: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Tokens of a part that is cut on its own."""
        n = len(text)
        # a piece's candidates must be tried in order of its start; matches are listed by end, so they are compared by length
        best, count, tail = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.trie.iter(text):
            ends[end + 1].append(found)
        for at in range(1, n + 1):
            top = None
            for size, score in sorted(ends[at], reverse=True):
                score += best[at - size]
                if top is None or score > top:
                    top, best[at], count[at], tail[at] = score, score, count[at - size] + 1, False
            if text[at - 1] not in self.single:
                score = best[at - 1] + self.unknown
                if top is None or score > top:
                    more = len(text[at - 1].encode("utf-8", "surrogatepass")) if self.bytes else not tail[at - 1]
                    best[at], count[at], tail[at] = score, count[at - 1] + more, True
        return count[n]

    def known(self, part: str) -> int:
        n = self.kept.get(part)
        if n is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            n = self.kept[part] = self.part(part)
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        get, total = self.kept.get, 0
        # each space starts a word, and one stands before the text unless it begins with one already
        words = text.replace(" ", SPACE)
        words = (words if words[0] == SPACE else SPACE + words)[1:].split(SPACE)
        for w in words:
            if self.cuts and "\n" in w:
                first, *rest = w.split("\n")
                total += self.known(SPACE + first) + len(rest) + sum(self.known(p) for p in rest if p)
                continue
            n = get(w := SPACE + w)
            total += self.known(w) if n is None else n
        return total


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model file, with their scores."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score) for p in model.pieces if p.type == model.SentencePiece.NORMAL]


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True) -> DataFrame:
    """id_col, n_chars and n_tokens for each row of docs. The vocabulary, of a size that its file fixes, goes to each worker with the job."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(pieces)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(vocabulary.value, byte_fallback)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(model.count, texts), pa.int64())], [id_col, "n_chars", "n_tokens"])

    df = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    return df.mapInArrow(rows, f"`{id_col}` {df.schema[0].dataType.simpleString()}, n_chars long, n_tokens long")
