"""Best-fit packing of documents into fixed-length token sequences.

Two parts.  ``tokenize_pieces`` encodes whole texts and cuts the long ones.
``best_fit`` packs pieces of any table by best-fit decreasing over *all* rows:

* Piece lengths are whole numbers up to the capacity, so best-fit decreasing
  needs only the histogram of lengths (at most ``capacity`` rows, whatever the
  input): equal pieces are interchangeable.  A segment tree over remaining
  capacities finds the tightest open sequence in logarithmic time; sequences
  that hold the same lengths move together as an interval of ids.
* The plan says which ranks of a length go where.  Ranks come from counts per
  (length, cell) and a row number inside a cell; cells are hashes of the row, so
  a length that holds a third of all rows is spread over all of them.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import ChainMap
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

CAPACITY = 2048
#: Rows that one cell of a length should hold, and the least number of cells.
CELL_ROWS, LEAST_CELLS = 1_000_000, 64
#: Chunks that a Python worker remembers, and their longest; the store is emptied when full.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 64
#: Latin letters, all of them letters in every version of Unicode.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts that are encoded together.
AT_ONCE = 256


class ByteTokenizer:
    """Token ids of whole texts, by the tokenizers library, as little-endian unsigned
    32-bit bytes.

    A space with anything but white space on one side starts a new pre-token, so texts are
    cut there, and the ids of each distinct chunk are made once.  Unknown chunks of a batch
    are cut once more, where a Latin letter meets punctuation or a digit and around a line
    break of its own, which start pre-tokens as well; the library gets their unknown parts,
    those that follow a space as one text, whose ids are dealt back by the bytes each one
    stands for.  A run of white space stays in one chunk, however long.  The string of a
    special token is that token; it holds no white space and is never cut.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._library = library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        added = library.get_added_tokens_decoder()
        # A character of a byte-level token stands for one byte.
        sizes = {i: len(label) for label, i in library.get_vocab(with_added_tokens=False).items()} | {i: len(t.content.encode()) for i, t in added.items()}
        self._bytes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)
        self._known: dict[str, bytes] = {}  # chunks after a space
        self._tails: dict[str, bytes] = {}  # parts of chunks, without a space
        self._inner, self._cut = re.compile(r"(?<!\S) (?!\S)"), re.compile(r"(?<=\S) | (?=\S)")
        special = {c for t in added.values() for c in t.content}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalpha() and c not in special)
        self._part = re.compile(rf"(?<=[{LATIN}])(?=[{marks}])|(?<=[!-~{LATIN}])(?=\n)|(?<=[!-~{LATIN}]\n)(?=[{LATIN}])")

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> np.ndarray:
        return self._each([text])[0]

    def _after_space(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that follow a space, which starts their first token."""
        # One that starts with white space could form a run with the end of another.
        joined = [c for c in chunks if c[:1].strip()]
        alone = [c for c in chunks if not c[:1].strip()]
        out = {c: ids.tobytes() for c, ids in zip(alone, self._each([" " + c for c in alone]))}
        if joined:
            ids = self._ids(" " + " ".join(joined))
            ends = np.cumsum([len(c.encode()) + 1 for c in joined])
            at = np.searchsorted(np.cumsum(self._bytes[ids]), ends, side="left") + 1
            data, start = ids.tobytes(), 0
            for chunk, end in zip(joined, (4 * at).tolist()):
                out[chunk] = data[start:end]
                start = end
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not known, from those of their parts."""
        cut, known, tails = self._part.split, self._known, self._tails
        whole = {c for c in chunks if c.isalpha()}  # nothing to cut
        parts = [(c, *cut(c)) for c in chunks - whole]
        own = self._after_space(list(whole.union(p[1] for p in parts).difference(known)))
        rest = list({t for p in parts for t in p[2:]}.difference(tails))
        more = {t: ids.tobytes() for t, ids in zip(rest, self._each(rest))}
        tails.update((t, ids) for t, ids in more.items() if len(t) <= CACHE_CHARS)
        for chunk, head, *others in parts:
            ids = own[head] if head in own else known[head]
            own[chunk] = ids + b"".join([more[t] if t in more else tails[t] for t in others]) if others else ids
        return own

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        known = self._known
        if len(known) + len(self._tails) > CACHE_ENTRIES:
            known.clear()
            self._tails.clear()
        parts = [self._cut.split(t) if self._inner.search(t) else t.split(" ") for t in texts]
        own = self._learn({c for chunks in parts for c in chunks[1:]}.difference(known))
        kept = {c: ids for c, ids in own.items() if len(c) <= CACHE_CHARS}
        known.update(kept)
        found = ChainMap(known, own).__getitem__ if len(kept) < len(own) else known.__getitem__
        firsts = self._each([first for first, *_ in parts])
        return [first.tobytes() + b"".join(map(found, rest)) for first, (_, *rest) in zip(firsts, parts)]


@functools.lru_cache(1)
def byte_tokenizer(name: str = "byte_bpe_50k.json") -> ByteTokenizer:
    """Kept from task to task of a Python worker."""
    import public_tokenizers as public

    return ByteTokenizer(public.path(name))


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be short."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of ``docs`` (doc_id, text).

    A null or empty text is the end id alone.  Repeated rows and repeated doc_ids
    are documents of their own.  Other columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokenizer()
        for batch in batches:
            out: list[tuple] = []
            ids_out = []
            for begin in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(begin, AT_ONCE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode_batch(texts)):
                    ids += end
                    for piece, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        out.append((doc_id, piece, start, length, zlib.crc32(own)))
                        if with_ids:
                            ids_out.append(np.frombuffer(own, "<i4"))
            columns = list(zip(*out)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


class _Tightest:
    """Segment tree over remaining capacities 0..n: is there an open sequence?"""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, at: int, open_: bool) -> None:
        i = at + self.leaves
        self.any[i] = open_
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def first(self, least: int) -> int | None:
        """The smallest capacity >= least that is open."""
        i = least + self.leaves
        while not self.any[i]:
            while i & 1:  # a right child: nothing further under this parent
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i *= 2
            i += not self.any[i]
        return i - self.leaves


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``{length: count}``.

    Returns rows (length, first rank, ranks, first sequence, offset) and the number
    of sequences: the n-th of those ranks goes to the n-th sequence from the first.
    """
    tree, opened = _Tightest(capacity), 0
    intervals: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: (first sequence, sequences)
    plan = []
    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        while count:
            left = tree.first(length)
            if left is None:
                left, first, many = capacity, opened, count
            else:
                first, many = intervals[left].pop()
                if not intervals[left]:
                    tree.set(left, False)
            each = left // length  # the tightest sequence stays the tightest until it is full
            used = min(many, count // each)
            if not used:
                used, each = 1, count
            if first == opened:
                opened += used
            elif used < many:
                intervals.setdefault(left, []).append((first + used, many - used))
                tree.set(left, True)
            for layer in range(each):
                plan.append((length, rank, used, first, capacity - left + layer * length))
                rank += used
            count -= used * each
            rest = left - each * length
            if rest:
                intervals.setdefault(rest, []).append((first, used))
                tree.set(rest, True)
    return np.array(plan, np.int64).reshape(-1, 5), opened


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) plus sequence_id and offset.

    ``order`` names columns that tell rows apart; rows equal in them (repeats) get
    places of their own in any order.  An empty table gives an empty table.
    ``pieces`` is read several times, so give a checkpointed one.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit_plan(histogram, capacity)
    cells = max(LEAST_CELLS, sum(histogram.values()) // CELL_ROWS)
    dealt = pieces.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "_cell").agg(F.count("*").alias("_n")).select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = dealt.join(base, ["length", "_cell"]).withColumn("_rank", F.col("_base") + F.row_number().over(Window.partitionBy("length", "_cell").orderBy(*order)) - 1)
    steps = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = steps.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            own = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if len(rank) else table[:0]
            arrays = [batch.column(c) for c in names]
            arrays += [pa.array(own[:, 3] + rank - own[:, 1], pa.int64()), pa.array(own[:, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    return ranked.select(*[F.col(f"`{c}`") for c in names], "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece."""
    return best_fit(cut(tokenize_pieces(docs, capacity)), capacity)
