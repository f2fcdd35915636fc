"""Token ids of whole documents in files of directly addressable codes.

A file holds the ids of consecutive documents.  An id is split into chunks of bits, the
lowest first; chunk k of all ids that have one stands in level k, packed at one width,
and a bitmap over the level says which ids go on to the next.  A directory of the bitmap's
ones before each block of 512 bits turns the place of an id in one level into its place
in the next, so any token is read from a few bytes without decoding its neighbours.  The
widths are those that make the file smallest, by the histogram of the ids' bits.

Documents are range-partitioned by doc_id, encoded and laid down by Spark's own writer, one
file for FILE_TOKENS tokens at most and a document, so a retried task leaves nothing behind
and any store that Spark writes to will do.  A manifest beside the files says where each begins.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut

#: Tokens after which a file is closed; a document is never cut.
FILE_TOKENS = 1 << 23
#: Bytes of text that a token stands for, about; only the number of files depends on it.
TEXT_BYTES = 2
#: The id that ends a document.
END_ID = 1
#: Words that a Python worker remembers, and their longest; the store is emptied when full.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 64
#: Bytes of text that are encoded together, values packed together, positions looked up together.
ENCODED, PACKED, LOOKUPS = 3 << 20, 1 << 20, 1 << 16

_MAGIC = b"DACT"
_HEAD = struct.Struct("<4sIQQQQQ")  # magic, levels, partition, place in it, its tokens before, documents, tokens
_BLOCK, _WORDS = 512, 8


def best_widths(ids: np.ndarray) -> list[int]:
    """Bits of each level that make the ids shortest: one bit a chunk for the bitmap, but
    for the last level."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    # longer[b]: ids that need more than b bits, at 0 all.
    sizes = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=bits + 1)
    longer = [len(ids), *(int(sizes[b + 1 :].sum()) for b in range(1, bits))]
    best: dict[int, tuple[int, list[int]]] = {bits: (0, [])}
    for at in reversed(range(bits)):
        options = [(longer[at] * (end - at + (end < bits)) + best[end][0], [end - at, *best[end][1]]) for end in range(at + 1, bits + 1)]
        best[at] = min(options)
    return best[0][1]


def _packed(values: np.ndarray, width: int) -> bytes:
    """``values`` of ``width`` bits each, the lowest bit first, and bytes to read beyond."""
    rows = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    parts = [np.packbits(np.unpackbits(rows[i : i + PACKED], axis=1, count=width, bitorder="little").reshape(-1), bitorder="little").tobytes() for i in range(0, len(rows), PACKED)]
    return b"".join(parts) + bytes(8)  # PACKED values end on a whole byte


class TokenFile:
    """The image of one file: ``build`` makes it, an instance reads from it."""

    def __init__(self, image: bytes):
        magic, levels, self.part, self.place, self.before, self.n_docs, self.n_tokens = _HEAD.unpack_from(image)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(image, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.has_id = np.frombuffer(image, np.uint8, self.n_docs, at).astype(bool)
        at += self.n_docs
        #: Place of each document's first token in the file, and the end.
        self.bounds = np.frombuffer(image, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self._levels = []
        for k in range(levels):
            width, size = struct.unpack_from("<IQ", image, at)
            at += 12
            n_bytes = -(-size * width // 8) + 8
            chunks = np.frombuffer(image, np.uint8, n_bytes, at)
            at += n_bytes
            words = ranks = None
            if k < levels - 1:
                blocks = size // _BLOCK + 1
                words = np.frombuffer(image, "<u8", blocks * _WORDS, at)
                at += 8 * blocks * _WORDS
                ranks = np.frombuffer(image, "<u4", blocks, at)
                at += 4 * blocks
            self._levels.append((width, chunks, words, ranks))

    @staticmethod
    def build(part: int, place: int, before: int, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
        """Image of documents with so many of the ``ids`` each."""
        left = ids.astype(np.uint32)
        bounds = np.cumsum([0, *sizes], dtype="<i8")
        widths = best_widths(left)
        out = [
            _HEAD.pack(_MAGIC, len(widths), part, place, before, len(sizes), len(left)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            bounds.tobytes(),
        ]
        for k, width in enumerate(widths):
            out += [struct.pack("<IQ", width, len(left)), _packed(left & np.uint32((1 << width) - 1), width)]
            if k < len(widths) - 1:
                left = left >> np.uint32(width)
                goes_on = left != 0
                bitmap = np.zeros((len(left) // _BLOCK + 1) * _BLOCK, bool)
                bitmap[: len(left)] = goes_on
                words = np.packbits(bitmap, bitorder="little").view("<u8")
                ones = np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1)
                out += [words.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
                left = left[goes_on]
        return b"".join(out)

    @staticmethod
    def head(image: bytes) -> tuple[int, int, int, int, int]:
        """(partition, place in it, tokens of it before, documents, tokens)."""
        return _HEAD.unpack_from(image)[2:]

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at these places of the file, each from its own bytes."""
        out = np.zeros(len(positions), np.uint32)
        own, place, shift = np.arange(len(positions)), np.asarray(positions, np.int64), 0
        for width, chunks, words, ranks in self._levels:
            bit = place * width
            byte = bit >> 3
            value = sum(chunks[byte + j].astype(np.uint64) << np.uint64(8 * j) for j in range((width + 14) // 8))
            value = (value >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)
            out[own] |= value.astype(np.uint32) << np.uint32(shift)
            shift += width
            if words is None:
                break
            word, inner = place >> 6, (place & 63).astype(np.uint64)
            goes_on = (words[word] >> inner) & np.uint64(1) != 0
            own, place, word, inner = own[goes_on], place[goes_on], word[goes_on], inner[goes_on]
            if not len(own):
                break
            first = place // _BLOCK * _WORDS
            rank = ranks[place // _BLOCK].astype(np.int64)
            for j in range(_WORDS - 1):
                rank += np.where(first + j < word, np.bitwise_count(words[first + j]), 0)
            place = rank + np.bitwise_count(words[word] & ((np.uint64(1) << inner) - np.uint64(1)))
        return out

    def ids(self) -> np.ndarray:
        """All ids: each level in one go, the next one's where its bitmap says so."""
        # A level has as many chunks as the bitmap of the one above has ones.
        sizes = [self.n_tokens, *(int(np.bitwise_count(words).sum()) for _, _, words, _ in self._levels[:-1])]
        found = np.zeros(0, np.uint32)
        for n, (width, chunks, words, _) in reversed(list(zip(sizes, self._levels))):
            out = np.empty(n, np.uint32)
            for i in range(0, n, PACKED):
                bits = np.arange(i, min(n, i + PACKED), dtype=np.int64) * width
                byte = bits >> 3
                value = chunks[byte].astype(np.uint32)
                for j in range(1, (width + 14) // 8):
                    value |= chunks[byte + j].astype(np.uint32) << np.uint32(8 * j)
                out[i : i + PACKED] = (value >> (bits & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)
            if words is not None:
                goes_on = np.unpackbits(words.view(np.uint8), count=n, bitorder="little").view(bool)
                out[goes_on] |= found << np.uint32(width)
            found = out
        return found


class LibraryWords:
    """Ids of whole texts by the tokenizers library, as little-endian bytes of ``dtype``.

    The library drops white space, no word crosses it, and its first step is NFC and lower
    case; so texts are brought to that form, and the ids of each distinct run of other
    characters in a batch are made once.  Of unknown runs, Latin letters and marks behind them are
    words of their own; the library gets all such words of a batch as one text, whose ids
    are dealt back by the tokens that end a word.  Other runs go to the library as they are,
    and so do texts with the string of a special token and a few others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._library = library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        vocabulary = library.get_vocab(with_added_tokens=True)
        self.dtype = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        suffix = library.model.end_of_word_suffix
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for label, i in vocabulary.items() if suffix and label.endswith(suffix)]] = True
        self._special = [t.content for t in library.get_added_tokens_decoder().values()]
        self._first = os.path.commonprefix(self._special)  # a quick test before the others
        # Separators that are no white space to the library, and a letter whose lower case has a mark that NFC may move.
        self._odd = re.compile("[\x1c-\x1fİ]")
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum())
        self._parts = re.compile(f"([a-zß-öø-ɏ]*)([{marks}]*)")
        self._known: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each_word(self, words: list[str]) -> list[bytes]:
        """Ids of texts that are one word of the library each."""
        ids = np.array(self._library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            return self._each(words)
        data, at = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *at], at)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        known = self._known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        out = list(map(known.get, chunks))
        parts, others = {}, []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            found = self._parts.fullmatch(chunks[i])
            if found:
                parts[i] = found.groups()
            else:
                others.append(i)
        fresh = list({w for p in parts.values() for w in p}.difference(known, ("",)))
        own = dict(zip(fresh, self._each_word(fresh))) if fresh else {}
        known.update((w, ids) for w, ids in own.items() if len(w) <= CACHE_CHARS)
        for i, (head, tail) in parts.items():
            out[i] = (own.get(head) or known[head] if head else b"") + (own.get(tail) or known[tail] if tail else b"")
        for i, ids in zip(others, self._each([chunks[i] for i in others])):
            out[i] = ids
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if self._first in t and any(s in t for s in self._special) or self._odd.search(t)}
        # lower() gives a final sigma at word ends, the library none
        plain = ["" if i in whole else t.lower() if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for i, t in enumerate(texts)]
        split = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        chunks = split.flatten().dictionary_encode()
        at = chunks.indices.to_numpy()
        ids = self._chunks(chunks.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), self.dtype)
        size = sizes[at]
        ends = np.cumsum(size)
        flat = data[np.repeat(starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[split.offsets.to_numpy()].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        for i, own in zip(whole, self._each([texts[i] for i in whole])):
            out[i] = own
        return out


@functools.lru_cache(1)
def library_words(name: str = "word_bpe_49k.json") -> LibraryWords:
    """Kept from task to task of a Python worker."""
    import public_tokenizers as public

    return LibraryWords(public.path(name))


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ENCODED bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes, dtype=np.int64) // ENCODED
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    return zip(cuts, cuts[1:])


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write them under ``path``, which must not exist, in
    ascending order of doc_id, null ones last; repeated rows and doc_ids are documents of
    their own, in any order.  A null or empty text is the end id alone.  An empty table
    gives a manifest without files.  Other columns are ignored.

    Texts are ordered first and encoded where their file is written, so nothing but the
    texts goes through a shuffle and nothing else is kept on the way."""
    spark = docs.sparkSession

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        place = before = tokens = part = 0
        names, sizes, ids = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal place, before, tokens
            image = TokenFile.build(part, place, before, names, sizes, np.frombuffer(b"".join(ids), words.dtype))
            place, before, tokens = place + 1, before + tokens, 0
            for column in (names, sizes, ids):
                column.clear()
            return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], ["image"])

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for begin, stop in _portions(batch.column("text")):
                rows = batch.slice(begin, stop - begin)
                for doc_id, own in zip(rows.column("doc_id").to_pylist(), words.encode_batch([t or "" for t in rows.column("text").to_pylist()])):
                    names.append(doc_id)
                    ids.append(own + end)
                    sizes.append(len(ids[-1]) // len(end))
                    tokens += sizes[-1]
                    if tokens >= file_tokens:
                        yield close()
        if ids:
            yield close()

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # row spreads repeats over range partitions; a retry may number rows anew, which changes no result.
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").isNull(), "doc_id", "row"]
    laid = rows.repartitionByRange(max(1, -(-total // (TEXT_BYTES * file_tokens))), *order).sortWithinPartitions(*order)
    images = laid.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(build, "image binary")
    # The text writer passes bytes on as they are; the line break behind an image is not read.
    images.select(F.col("image").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{path}/files")

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(TokenFile.head(x.as_py()) for x in batch.column("content")))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array(c, pa.int64()) for c in found)], ["file", "part", "place", "before", "n_docs", "n_tokens"])

    found = cut(_files(spark, path).select("path", F.substring("content", 1, _HEAD.size).alias("content")).mapInArrow(heads, "file string, part long, place long, before long, n_docs long, n_tokens long"))
    base, bases = 0, []
    for part, n in sorted(map(tuple, found.groupBy("part").agg(F.sum("n_tokens")).collect())):  # a row for each range partition
        bases.append((part, base))
        base += n
    placed = found.join(spark.createDataFrame(bases, "part long, base long"), "part")
    placed.select("file", "part", "place", (F.col("base") + F.col("before")).alias("start"), "n_docs", "n_tokens").write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/files").select("path", "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, place, start, n_docs, n_tokens): start counts the tokens of all files before."""
    return spark.read.parquet(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files."""
    schema = "doc_id long, part long, place long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column("content"):
                file = TokenFile(image.as_py())
                ids, bounds = file.ids().astype("<u4", copy=False), file.bounds.tolist()
                own = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
                columns = {
                    "doc_id": pa.array(file.doc_ids, pa.int64(), mask=~file.has_id),
                    "part": pa.array(np.full(file.n_docs, file.part)),
                    "place": pa.array(np.full(file.n_docs, file.place)),
                    "within": pa.array(file.bounds[:-1]),
                    "n_tokens": pa.array(np.diff(file.bounds)),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array([x.view("<i4") for x in own], pa.list_(pa.int32()))} if with_ids else {}))

    starts = manifest(spark, path).select("part", "place", "start")
    rows = _files(spark, path).mapInArrow(read, schema).join(starts, ["part", "place"])
    return rows.select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for each of ``positions`` (position) that the files hold, counted
    over all of them; repeats are looked up once and given once, others and nulls are
    left out.

    Positions meet files by cells as wide as the longest file, of which a file touches two
    at most.  A file gets its positions in lists of at most LOOKUPS.
    """
    files = manifest(spark, path).where("n_tokens > 0").select("file", "start", "n_tokens")
    width = files.agg(F.max("n_tokens")).first()[0] or 1  # no file is longer, so a file touches few cells of this width
    cells = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_tokens") - 1) / width))
    near = files.withColumn("cell", F.explode(cells))
    asked = positions.where("position >= 0").select(F.col("position").cast("long")).distinct().withColumn("cell", F.floor(F.col("position") / width))
    found = asked.join(near, "cell").where("position >= start AND position < start + n_tokens")
    lists = found.withColumn("list", F.floor((F.col("position") - F.col("start")) / LOOKUPS)).groupBy("file", "start", "list").agg(F.collect_list("position").alias("positions"))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, start, own in zip(batch.column("content"), batch.column("start").to_pylist(), batch.column("positions")):
                own = np.array(own.values if hasattr(own, "values") else own.as_py(), np.int64)
                got = TokenFile(image.as_py()).at(own - start)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(got, pa.int64())], ["position", "token"])

    content = _files(spark, path).withColumnRenamed("path", "file")
    return lists.join(content, "file").select("content", "start", "positions").mapInArrow(look, "position long, token long")


def coded_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to token files, in a new folder beside the checkpoints unless ``path``
    names one, and read (doc_id, start, n_tokens, ids_crc32) back from them."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path)
    return read_documents(spark, path)
