"""op6: how many steps encoding takes, and texts that fall into several parts."""

import random
import sys

import numpy as np
import public_tokenizers as public
from tokenizers import Tokenizer

from notegraph.llm import bpe


def calls(function, *args) -> int:
    """Calls of functions, Python's and C's, that ``function`` makes."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        function(*args)
    finally:
        sys.setprofile(None)
    return n


def library() -> Tokenizer:
    out = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    out.no_truncation()
    out.no_padding()
    return out


def test_a_new_word_takes_few_steps_a_letter():
    rng, automaton = random.Random(1), bpe.word_tokenizer().automaton
    syllables = ["ción", "heit", "tion", "que", "the", "ing", "oi", "er", "sch", "an", "d"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 6))).replace("ó", "Ã³") for _ in range(500)] + ["ab" * 500]
    for word in words:
        automaton.encode_word(word)  # arcs are known from here on
    assert calls(lambda: [automaton.encode_word(w) for w in words]) <= 6 * sum(map(len, words))


def test_known_chunks_take_no_step_of_their_own():
    own = bpe.WordTokenizer(public.path("word_bpe_49k.json"))
    text = "to be, or not to be: " * 5000
    own.encode(text)
    assert calls(own.encode, text) < 1000


def test_parts_and_special_tokens(monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", 50)
    monkeypatch.setattr(bpe, "WORD_ENTRIES", 7)
    rng, own, lib = random.Random(2), bpe.WordTokenizer(public.path("word_bpe_49k.json")), library()
    pieces = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\t", "\n", " ", "  ", "\x1c", "\x85", " ", "it's", "don'T", "x" * 90, "é", "ΑΣ", "12", "</w>", "!?", "日本", ""]
    texts = ["", None, " ", "\n", "<|endoftext|>", *("".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)), ""]
    got = list(own.encode_all(texts))
    assert len(got) == len(texts)
    for text, (ids, decoded) in zip(texts, got, strict=True):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert str(decoded, "utf-8") == lib.decode(want, skip_special_tokens=False)
    assert list(own.encode_all([])) == []
