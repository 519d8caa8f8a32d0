import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from plumbline.llm import tokens
from plumbline.llm.wordids import WordIds

TEXTS = ["", " ", "  a", "a  b ", "\n\n", "a\n\nb\n", "日本語 éñ😀😀 x", " ▁x", "▁", "x▁▁▁▁y", "😀\n😀", "\n😀", "😀 \n\n", "abab" * 500, "the cat sat " * 50]


def reference(pieces, byte_fallback):
    least = min(s for _, s in pieces)
    special = [("<unk>", least)] + ([(f"<0x{i:02X}>", least) for i in range(256)] if byte_fallback else [])
    t = Tokenizer(models.Unigram(special + pieces, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_as_the_tokenizer_counts(path, rows, byte_fallback):
    pieces = tokens.pieces_of(path("piece_bpe_32k.model"))
    want, model = reference(pieces, byte_fallback), tokens.Unigram(pieces, byte_fallback)
    for text in TEXTS + [t for _, t, *_ in rows if t]:
        assert model.count(text) == want(text), text[:50]


#: Scores that tie on purpose.
TIES = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -6.0), ("▁a", -3.0), ("bb", -3.0), ("aab", -6.0)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc \n", max_size=24), st.booleans())
def test_ties(text, byte_fallback):
    assert tokens.Unigram(TIES, byte_fallback).count(text) == reference(TIES, byte_fallback)(text)


def test_scan(docs, rows, odd, empty, path):
    pieces = tokens.pieces_of(path("piece_bpe_32k.model"))
    model = tokens.Unigram(pieces)
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"]) for r in tokens.count_tokens(docs, pieces).collect()}
    assert got == {i: (len(t or ""), model.count(t or "")) for i, t, *_ in rows}
    assert tokens.count_tokens(odd, pieces).count() == odd.count() and tokens.count_tokens(empty, pieces).count() == 0


def test_word_ids(path, rows):
    file = path("word_bpe_49k.json")
    ours, theirs = WordIds(file), Tokenizer.from_file(file)
    odd = ["a<|startoftext|>b c <|endoftext|> d<|startoftext|", "A<|STARTOFTEXT|> [x] (y) z_a ²x x² Å É ǅ İ ΣΑΣ", "it's they'LL 123 O'Neil'S d'été ÀÖ×Ø÷ß 'S", "x\u0085y\x1cz   q"]
    for text in [*odd, *TEXTS, *(t for _, t, *_ in rows if t)]:
        assert ours.encode([text])[0] == np.array(theirs.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:50]
