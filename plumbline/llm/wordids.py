"""Ids of texts by a `tokenizers` file whose pre-tokenizer never joins what ASCII white space parts.

For such a tokenizer the words of a text are encoded independently, and a worker keeps the ids of words it has met. A word of plain Latin
letters, with ASCII punctuation after them at most, is two pre-tokens whose normal form is known; its ids come from the merge model directly. All other
words go through the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

from plumbline.llm.shared import worker_memory

#: Bytes that a generation of words and their ids may take in a worker, which keeps two, and what one takes besides its letters and ids.
KEPT_BYTES, ENTRY_BYTES = 24 << 20, 180
#: Letters that are their own canonical composition and whose lower case is one letter; punctuation but ' (contractions) and < (special tokens).
PLAIN = re.compile(r"""([A-Za-zÀ-ÖØ-öø-ÿ]+)([!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)""")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class WordIds(dict):
    """The ids of words (bytes to bytes, little-endian unsigned 32-bit numbers), worked out when first asked for.

    When the words take KEPT_BYTES they become the elder generation, from which those that are met again come back, and the elder ones before are forgotten.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES) -> None:
        super().__init__()
        self.kept_bytes, self.bytes, self.elder = kept_bytes, 0, {}
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.signs: dict[str, bytes] = {}
        # the short way holds for lower-casing byte-level models with the usual pre-tokens only
        self.short = self.whole("Aé#!") == self.plain("Aé", "#!")

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, letters: str, signs: str) -> bytes:
        if signs not in self.signs:
            self.signs[signs] = self.merged(signs) if signs else b""
        return self.merged(letters.lower()) + self.signs[signs]

    def merged(self, part: str) -> bytes:
        """Of one pre-token in normal form."""
        part = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(part)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.elder.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            m = self.short and PLAIN.fullmatch(text)
            ids = self.plain(*m.groups()) if m else self.whole(text)
        self.bytes += len(word) + len(ids) + ENTRY_BYTES
        if self.bytes >= self.kept_bytes:
            self.elder, self.bytes = dict(self), 0
            self.clear()
            self.signs.clear()
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [b"".join([self[w] for w in t.encode("utf-8", "surrogatepass").split()]) for t in texts]


def word_ids(path: str) -> WordIds:
    """The worker's own, which it keeps from task to task."""
    kept = worker_memory().setdefault("word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]
