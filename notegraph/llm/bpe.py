"""BPE encoding and decoding by a tokenization automaton.

The automaton has a state for each token (the one just read) and its arcs are tokens:
a path spells a text and visits exactly the tokens BPE gives for it.  It starts with
the base symbols, each of which may follow each, and takes the merges in order.  The
gadget of a merge (u, v) -> w does three things: the arc v leaves the state u, an arc w
is added wherever u and then v could be read, and the state w gets the arcs v has then.

Forty-nine thousand gadgets copied in full make 618,612,971 arcs, so arcs are unfolded on demand: whether a state a has the arc b is decided by walking
back through the gadgets that made a and b, newest first, and is remembered as an
entry of the transition table.  In ``_arc`` the gadget of rank r acts at time 3r + 1
between two tokens, its result stands as left neighbour from 3r and as right one from
3r + 2 on, since equal merges act from left to right.

Encoding walks a pre-split word from left to right along the longest arc there is, then
along shorter ones, and steps back where none leads on: at each place exactly one token
that ends there may follow the state of the place where it starts, so a place that was
left is not entered again.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: What a Python worker remembers, words of at most WORD_CHARS; each store is emptied when full.
WORD_ENTRIES, ARC_ENTRIES, WORD_CHARS = 1_000_000, 2_000_000, 64
#: Characters of texts that are encoded at once.
PART_CHARS = 4_000_000
#: White space as the tokenizers library's regular expressions see it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class MergeAutomaton:
    """Transitions between tokens of a merge list with a word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.labels = {i: s for s, i in vocab.items()}
        size = 1 + max(vocab.values(), default=0)
        self._rank, self._left, self._right = [-1] * size, [0] * size, [0] * size
        self._gadget: dict[tuple[int, int], int] = {}
        for rank, (u, v) in enumerate(merges):
            a, b, made = vocab[u], vocab[v], vocab[u + v]
            self._gadget[a, b] = rank
            if self._rank[made] < 0:
                self._rank[made], self._left[made], self._right[made] = rank, a, b
        self._end = "\n" if suffix else ""  # stands for the suffix; no byte symbol is a line feed
        self._longest = max(map(len, vocab), default=1)
        self._root: dict[str, list] = {}  # trie of the labels: symbol to [what may follow, token that ends here]
        self._shorter, self._length = [-1] * size, [0] * size
        spelled = {s.removesuffix(suffix) + self._end if suffix and s.endswith(suffix) else s: i for s, i in vocab.items()}
        for label, i in sorted(spelled.items()):  # a label comes after those that it begins with
            follow, self._length[i] = self._root, len(label)
            for symbol in label[:-1]:
                node = follow.get(symbol)
                if node is None:
                    node = follow[symbol] = [{}, -1]
                follow, token = node
                if token >= 0:
                    self._shorter[i] = token
            follow[label[-1]] = [{}, i]
        self._table: dict[tuple[int, int], bool] = {}

    def _arc(self, a: int, b: int) -> bool:
        """Does the state ``a`` have the arc ``b`` once all gadgets have acted?"""
        gadget, rank = self._gadget, self._rank
        until = 3 * len(gadget) + 3
        while True:
            acts = gadget.get((a, b))
            if acts is not None and 3 * acts + 1 < until:
                return False
            made_a, made_b = rank[a], rank[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_b >= made_a:
                until, b = 3 * made_b + 2, self._left[b]
            else:
                until, a = 3 * made_a, self._right[a]

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-split word, given in byte symbols."""
        text, longest, table, shorter, length = word + self._end, self._longest, self._table, self._shorter, self._length
        if len(table) > ARC_ENTRIES:
            table.clear()
        n, place, out, left = len(text), 0, [], set()
        while place < n:
            follow, token = self._root, -1
            for symbol in text[place : place + longest]:
                node = follow.get(symbol)
                if node is None:
                    break
                follow, ends = node
                if ends >= 0:
                    token = ends
            while True:
                while token >= 0:
                    if place + length[token] not in left:
                        if not out:
                            break
                        pair = (out[-1], token)
                        arc = table.get(pair)
                        if arc is None:
                            arc = table[pair] = self._arc(*pair)
                        if arc:
                            break
                    token = shorter[token]
                if token >= 0:
                    break
                if not out:
                    raise ValueError(f"no tokens for {word!r}")
                left.add(place)
                token = out.pop()
                place -= length[token]
                token = shorter[token]
            out.append(token)
            place += length[token]
        return out


class Words(dict):
    """What ``make`` gives for each word, made when first asked for."""

    def __init__(self, make: Callable[[str], tuple[bytes, bytes]]):
        self._make = make

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        found = self._make(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORD_ENTRIES:
                self.clear()
            self[word] = found
        return found


class WordTokenizer:
    """Whole texts to (ids as little-endian unsigned 32-bit bytes, decoded text).

    The different chunks between the white space of a part are encoded once, their bytes dealt by index.

    Follows a ``tokenizers`` file of this kind: NFC, white space to a space, lower
    case, words by a pattern, byte symbols, merges with a word-end suffix, no decoder
    (labels joined by spaces).  The strings of special tokens are those tokens.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = MergeAutomaton(model["vocab"], map(tuple, model["merges"]), model["end_of_word_suffix"] or "")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: s for s, i in special.items()}
        self._out = {i: (s + " ").encode() for i, s in self.labels.items()}
        self._special = {f"\t{s}": i for s, i in special.items()}
        self._marks = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self._first = os.path.commonprefix(list(special))  # a quick test before the pattern
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile("|".join(["\n", *map(re.escape, self._special), pattern.replace(r"\s", SPACE)]))
        self._space = re.compile(f"[{SPACE.replace(' ', '')}]")
        self._symbols = byte_symbols()
        self._word = Words(self._encode_word)

    def _encode_word(self, word: str) -> tuple[bytes, bytes]:
        """Ids, and their labels in UTF-8 with a space after each; nothing for a line feed."""
        symbols, out = self._symbols, self._out
        if word in self._special:
            ids = [self._special[word]]
        else:
            ids = self.automaton.encode_word("".join([symbols[b] for b in word.encode()])) if word != "\n" else []
        return struct.pack(f"<{len(ids)}I", *ids), b"".join([out[i] for i in ids])

    def _plain(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() gives a final sigma at word ends, the library none
            text = text.replace("Σ", "σ")
        return self._space.sub(" ", text.lower())

    def _spaced(self, text: str) -> str:
        """Chunks with spaces between them, special tokens being chunks that begin with a tab."""
        if self._first not in text or not self._marks.search(text):
            return self._plain(text)
        return " ".join([f"\t{x}" if f"\t{x}" in self._special else self._plain(x) for x in self._marks.split(text) if x])

    def _encode_part(self, texts: list[str]) -> Iterator[tuple[memoryview, memoryview]]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        chunks = lists.flatten().dictionary_encode()
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks.dictionary)], chunks.dictionary), pa.scalar("\n", pa.large_string()))[0].as_py() + "\n"
        made = list(map(self._word.__getitem__, self._words.findall(lines)))
        columns = []
        for k in (0, 1):
            _, places, values = pa.array([x[k] for x in made], pa.large_binary()).buffers()
            places = np.frombuffer(places, np.int64, len(made) + 1)
            ends = places[np.flatnonzero(places[1:] == places[:-1])]  # line feeds alone give nothing
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), values])
            _, places, values = coded.take(chunks.indices).buffers()
            places = np.frombuffer(places, np.int64)[lists.offsets.to_numpy()].tolist()
            columns.append((memoryview(b"" if values is None else values), places))
        (ids, i), (labels, j) = columns
        for k in range(len(texts)):
            yield ids[i[k] : i[k + 1]], labels[j[k] : max(j[k], j[k + 1] - 1)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[memoryview, memoryview]]:
        """(ids, decoded text in UTF-8) of each text; in each PART_CHARS a chunk is looked up once."""
        part, size = [], 0
        for text in texts:
            part.append(self._spaced(text or ""))
            size += len(part[-1])
            if size >= PART_CHARS:
                yield from self._encode_part(part)
                part, size = [], 0
        if part:
            yield from self._encode_part(part)

    def encode(self, text: str) -> tuple[bytes, str]:
        ids, decoded = next(self.encode_all([text]))
        return bytes(ids), str(decoded, "utf-8")

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, special tokens included."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


@functools.lru_cache(1)
def word_tokenizer(name: str = "word_bpe_49k.json") -> WordTokenizer:
    """Kept from task to task of a Python worker, with the arcs it has unfolded."""
    import public_tokenizers as public

    return WordTokenizer(public.path(name))


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", with_tokens: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for each row.

    A null or empty text has no tokens and decodes to an empty text.  Repeated rows
    give repeated rows, an empty table an empty one; other columns are ignored.
    ``tokenizer`` names a file of the public tokenizers.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_tokens

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        sha = hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for ids, decoded in words.encode_all(text.as_py() for text in batch.column(1)):
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(decoded).hexdigest())
                if with_tokens:
                    all_ids.append(np.frombuffer(ids, "<i4"))
                    texts.append(str(decoded, "utf-8"))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_tokens:
                columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(encode, schema)
