"""Texts that need no cut are encoded side by side, without a cache of their words."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillspark.llm import bpe, packing, token_files

ODD = ["", " ", "\n\t ", " a", "a ", "a", "1", "?", "'", "''s", "it's don't we'll 'tis o'clock l'été.'s", "1984 3.14,15 x1y2 a.b..c...", "!!!??? --- ***word*** (x)", "é É ß straße ÇA ŽŠ œuvre", "naïve\x0bx\x1cy", "nul\x00byte \x7f del\x07.", "<|endoftext|> x <|y", "日本語 и русский ﬁ İ ŉ", "word " * 40, "a" * 63 + " " + "a" * 64 + " " + "a" * 65 + " " + "b" * 3000 + ".", "×÷ £5 50% $1,000.00 é"]


@pytest.fixture(scope="module")
def tok() -> bpe.Encoder:
    return bpe.Encoder(bpe.default_path())


def same(tok: bpe.Encoder, texts: list[str | None], leaf: int) -> None:
    for text, ids in zip(texts, tok.encode_all(texts, leaf), strict=True):
        assert ids.tolist() == tok.library.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("leaf", [8, 512, 1 << 16])
def test_odd_texts_as_the_library_encodes_them(tok, leaf):
    same(tok, [None, *ODD], leaf)
    for text in ODD:
        same(tok, [text], leaf)
    same(tok, [], leaf)


def test_invented_texts_as_the_library_encodes_them(tok, monkeypatch):
    draw = random.Random(5)
    alphabet = "aaabcdeeeghiilmnoorssttuuy" * 3 + "ABCé ÉßŽ0123456789.,;:!?'-$%&*()   \n\t\""
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 300))) for _ in range(400)]
    same(tok, texts, 1 << 16)
    monkeypatch.setattr(bpe, "UNCUT", 500)
    monkeypatch.setattr(bpe.Merges, "GROUP", 7)
    same(tok, texts, 1 << 16)


def test_words_fill_no_cache(tok):
    """Each new word used to be encoded by itself and kept, up to 300,000, then all were encoded anew."""
    draw = np.random.default_rng(1)
    words = ["".join(map(chr, 97 + draw.integers(0, 26, 9))) for _ in range(5000)]
    before = len(tok.known)
    same(tok, [" ".join(words[i : i + 50]) + "." for i in range(0, 5000, 50)], 1 << 16)
    assert len(tok.known) == before


def test_pairs_in_a_crowded_table(tok, monkeypatch):
    monkeypatch.setattr(bpe.Merges, "SLOTS", 1 << 16)
    merges = bpe.Merges(tok.tree)
    pairs = np.array([[tok.tree.spec["vocab"][x] for x in pair] for pair in tok.tree.merges])
    assert (merges.rank(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    known = set(map(tuple, pairs.tolist()))
    other = np.array([x for x in np.random.default_rng(2).integers(0, 40_000, (5000, 2)).tolist() if tuple(x) not in known])
    assert (merges.rank(other[:, 0], other[:, 1]) == bpe.NO_RANK).all()


@pytest.mark.parametrize("leaf", [token_files.LEAF, packing.LEAF])
def test_packing_and_token_files_keep_no_words_of_the_given_documents(tok, leaf):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    before = len(tok.known)
    same(tok, texts, leaf)
    distinct = {w for x in texts if x for w in x.lower().split()}
    assert len(tok.known) - before < len(distinct) / 20
