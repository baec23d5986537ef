import random
import time

import public_tokenizers
import pytest
import sentencepiece

from netsift.llm import token_counts

PIECE = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def pieces():
    return token_counts.Pieces(PIECE)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def _long(kind, n):
    rnd = random.Random(3)
    if kind == "letters":
        return "".join(rnd.choice(LETTERS) for _ in range(n))
    if kind == "words":
        words = ["the", "token", "count", "ing", "of", "unbroken", "text", "licence", "was", "quadratic", "once", "Straße", "naïve"]
        return "".join(rnd.choice(words) for _ in range(n // 4))[:n]
    return (kind * (n // len(kind) + 1))[:n]


@pytest.mark.parametrize("kind", ["letters", "words", "z", "ab", "aab", LETTERS, "=", "漢字", "é"])
def test_a_million_characters_without_a_blank(pieces, library, kind):
    text = _long(kind, 1_000_000)
    began = time.process_time()
    got = token_counts.Counter(pieces).count([text]).tolist()
    assert time.process_time() - began < 20  # a quadratic merge takes hours
    assert got == [len(library.encode(text))]


def test_hostile_strings(pieces, library):
    rnd = random.Random(4)
    parts = ["a", "b", "the", "tion", "  ", " ", "\n", "\t", "▁", "<s>", "</s>", "<0x41>", "1", "é", "漢", "\U0001f600", "\0", "zz", "...", "----", "́", "﻿"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 80))) for _ in range(2000)]
    assert token_counts.Counter(pieces).count(texts).tolist() == [len(library.encode(t)) for t in texts]


@pytest.mark.parametrize("text", [" " * 1_000_000, "▁" * 1_000_000, "a b" + " " * 1_000_000 + "c", "x " + "▁" * 500_000 + " y" + " " * 300_000 + "the end", "\0" + " " * 1_000_000 + "a", ("\n" + " " * 200) * 5000], ids=range(6))
def test_a_million_blanks(pieces, library, text):
    began = time.process_time()
    got = token_counts.Counter(pieces).count([text]).tolist()
    assert time.process_time() - began < 2
    assert got == [len(library.encode(text))]


def test_runs_of_blanks_of_every_length(pieces, library):
    rnd = random.Random(8)
    texts = [f"{a}{sign * n}{b}" for n in range(1, 400, 3) for sign in " ▁" for a, b in (("", ""), ("a", "b"), ("", "the"), ("\n", "x"), ("▁ ", "\0"))]
    some = [" " * 90, "▁" * 333, " " * 1000, "the", "a", "\n", "=====", "\t", "é", "x1"]
    texts += ["".join(rnd.choice(some) for _ in range(rnd.randrange(1, 9))) for _ in range(500)]
    assert token_counts.Counter(pieces).count(texts).tolist() == [len(library.encode(t)) for t in texts]
