"""Word shingles of whole texts as 64-bit hashes, and their similarity sketches.

Everything works on the bytes of a block of texts at once, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
#: Bytes of text that are hashed together.
BLOCK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (MurmurHash3's finalizer)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased, and
    the number of words of each text."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    inside = ~_SPACE[data]
    at = np.flatnonzero(inside)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # places in `at` where words start
    lengths = np.diff(first, append=len(at))
    offset = np.arange(len(at)) - np.repeat(first, lengths)
    terms = _BYTE[data[at]] * _powers(int(lengths.max()))[offset]
    hashes = mix(np.add.reduceat(terms, first))
    return hashes, np.diff(np.searchsorted(at[first], ends), prepend=0)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than five words are
    one shingle, no words none."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield from _block_sets(block)
            block, size = [], 0
    if block:
        yield from _block_sets(block)


def _block_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    words, counts = word_hashes(texts)
    n = max(0, len(words) - WORDS + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        rolled += words[k : k + n] * _PLACE[k]
    rolled = mix(rolled)
    start = 0
    for count in counts.tolist():
        if count >= WORDS:
            own = np.sort(rolled[start : start + count - WORDS + 1])
            yield own[np.diff(own, prepend=own[0] ^ _U(1)) != 0]
        elif count:
            short = np.append(words[start : start + count] * _PLACE[WORDS : WORDS + count], _PLACE[10 + count])
            yield mix(short.sum(keepdims=True, dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        start += count


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches, ``len(sets)`` x ``size`` (a power of two).

    In round r every element falls into one coordinate by a hash of its own; a
    coordinate keeps the least (round, hash).  Rounds go on for the sets that have
    an empty coordinate; after ``size`` rounds each round serves one fixed coordinate,
    so that every coordinate is filled.  Two sets agree in a coordinate with the
    probability of their Jaccard similarity.  An empty set has all ones.
    """
    out = np.full((len(sets), size), ~_U(0))
    flat = out.reshape(-1)
    if not sets:
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets)
    steps = np.arange(1, 2 * size + 1, dtype=np.uint64) * _BASE
    for r in range(2 * size):
        if not len(items):
            break
        h = mix(items + steps[r])
        place = (h & _U(size - 1)).astype(np.int64) if r < size else r - size
        np.minimum.at(flat, owner * size + place, (h >> _U(16)) | (_U(r) << _U(48)))
        open_ = (out == ~_U(0)).any(axis=1)[owner]
        items, owner = items[open_], owner[open_]
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` coordinates."""
    n, size = sketch.shape
    parts = sketch.reshape(n, size // rows, rows)
    keys = (parts * _PLACE[20 : 20 + rows]).sum(axis=2, dtype=np.uint64)
    return mix(keys + np.arange(size // rows, dtype=np.uint64) * _BASE)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
