"""Collocations: phrases of two to five words that stand together more often than their parts
would by chance.

A phrase that starts at some word is a prefix of the run of up to five words from there to
the end of its piece, so counting those runs counts all phrases.

1. A task sorts the runs of a block of text and builds a weighted acyclic automaton from
   them: each sorted run keeps the path it shares with the one before it and adds arcs for
   its other words; the arc that ends a run carries the run's count.
2. The automaton is cut at splitters, sampled runs, into ranges of prefixes; what goes
   through the shuffle is an automaton for each block and range.
3. The automata of a range are united: runs that several have are one, their counts added.
   The count of a phrase is the sum over the runs below its path.  Paths of the first and
   last run of a range may go on in the next one; those sums, at most ten a range, are added
   up afterwards.  So a phrase that holds a third of all text is cut into ranges as well.
4. Phrases of the least count are kept: every part of one is among them.  A cut phrase is
   composed with the counts by joining its two parts to them.

Splitters place work, they never change a result.
"""

from __future__ import annotations

import bisect
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

WORDS, LEAST, TOP = 5, 100, 2000
#: Bytes of text of a block and of a range; runs sampled for a range; documents in so many that are sampled.
BLOCK_BYTES, RANGE_BYTES, SAMPLED, ONE_IN = 5 << 20, 5 << 20, 32, 8
#: Of counts as decimals: 38 digits hold both products.
SCORE = "(CAST(1000 AS DECIMAL(4, 0)) * {a} * {n}) div ({l} * {r})"

_SPLITS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(0x2E if b in _SPLITS else b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x09 else b for b in range(256))
_MARK = b"."  # stands between pieces; no word has it


def _slices(data: bytes) -> Iterator[bytes]:
    """``data`` in blocks cut at marks; a piece is never cut."""
    at = 0
    while len(data) - at > BLOCK_BYTES:
        end = data.rfind(_MARK, at + 1, at + BLOCK_BYTES)
        if end < 0:
            end = data.find(_MARK, at + BLOCK_BYTES)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def _words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of ``data`` in order, and the place in them, from 1, of each word;
    0 for a mark."""
    split = pc.split_pattern(pa.array([data.replace(_MARK, b" . ")], pa.large_binary()), pattern=" ")
    found = split.flatten().dictionary_encode()
    known, at = found.dictionary.to_pylist(), found.indices.to_numpy()
    order = sorted((i for i, w in enumerate(known) if w and w != _MARK), key=known.__getitem__)
    place = np.full(len(known), -1, np.int32)
    place[order] = np.arange(1, len(order) + 1)
    if _MARK in known:
        place[known.index(_MARK)] = 0
    ids = place[at]
    return [known[i] for i in order], ids[ids >= 0]


def _runs(ids: np.ndarray) -> np.ndarray:
    """The run of up to WORDS words from each word on; ``ids`` has 0 for marks, a run that
    the piece ends has 0 behind it."""
    padded = np.append(ids, np.zeros(WORDS, ids.dtype))
    columns = [ids]
    for k in range(1, WORDS):
        columns.append(np.where(columns[-1] == 0, 0, padded[k : k + len(ids)]))
    return np.stack(columns, axis=1)[ids != 0]


def _summed(runs: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``runs`` in order, with the sums of their ``counts``."""
    if not len(runs):
        return runs, counts
    bits = int(n_words).bit_length()

    def key(columns: tuple[int, ...]) -> np.ndarray:
        out = runs[:, columns[0]].astype(np.int64)
        for k in columns[1:]:
            out <<= bits
            out |= runs[:, k]
        return out

    order = np.lexsort((key((3, 4)), key((0, 1, 2))) if 3 * bits <= 62 else runs.T[::-1])
    runs, counts = runs[order], counts[order]
    first = np.flatnonzero(np.r_[True, (runs[1:] != runs[:-1]).any(axis=1)])
    return runs[first], np.add.reduceat(counts, first)


class CountAutomaton:
    """Sorted distinct runs with counts, as an acyclic automaton with a level for each word.

    An arc has a label (a word), the arc before it and the count of the runs that end with
    it.  Runs of full length all end in one state, which has no arcs."""

    @staticmethod
    def build(words: list[bytes], runs: np.ndarray, counts: np.ndarray) -> bytes:
        """Image of ``runs`` (rows of 1-based places in ``words``, 0 behind the end)."""
        used = np.unique(runs)
        used = used[used > 0]
        labels = np.searchsorted(used, runs)  # 0-based; 0 behind the end is not read
        names = b" ".join([words[i - 1] for i in used.tolist()])
        out = [struct.pack("<QQ", len(used), len(names)), names]
        changed = np.zeros(len(runs), bool)
        changed[:1] = True
        above = None  # of each run, its arc in the level above
        size = (runs != 0).sum(axis=1)
        for k in range(WORDS):
            changed[1:] |= runs[1:, k] != runs[:-1, k]
            fresh = changed & (runs[:, k] != 0)
            own = np.cumsum(fresh) - 1
            arcs = int(fresh.sum())
            ends = np.zeros(arcs, np.int64)
            last = size == k + 1
            ends[own[last]] = counts[last]
            arrays = [labels[fresh, k], ends]
            if k:
                arrays.append(np.bincount(above[fresh], minlength=n_above))  # arcs that follow each arc above
            for array in arrays:
                array = array.astype(np.min_scalar_type(int(array.max()) if len(array) else 0))
                out += [struct.pack("<BQ", array.itemsize, len(array)), array.tobytes()]
            above, n_above = own, arcs
        return b"".join(out)

    @staticmethod
    def read(image: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words, runs, counts), the runs in any order."""
        n_words, size = struct.unpack_from("<QQ", image)
        at = 16 + size
        words = image[16:at].split(b" ") if n_words else []

        def array() -> np.ndarray:
            nonlocal at
            width, n = struct.unpack_from("<BQ", image, at)
            at += 9 + width * n
            return np.frombuffer(image, f"<u{width}", n, at - width * n)

        paths, all_runs, all_counts = None, [], []
        for k in range(WORDS):
            labels, ends = array(), array()
            own = np.zeros((len(labels), WORDS), np.int32)
            if k:
                own[:] = np.repeat(paths, array(), axis=0)
            own[:, k] = labels.astype(np.int32) + 1
            paths = own
            final = np.flatnonzero(ends)
            all_runs.append(own[final])
            all_counts.append(ends[final].astype(np.int64))
        return words, np.concatenate(all_runs), np.concatenate(all_counts)


def united(images: Iterable[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The union of automata with added counts: (words, sorted runs, counts)."""
    parts = [CountAutomaton.read(x) for x in images]
    words = sorted(set().union(*(w for w, _, _ in parts)))
    number = {w: i for i, w in enumerate(words, 1)}
    runs = []
    for own, rows, _ in parts:
        to = np.array([0, *map(number.__getitem__, own)], np.int32)
        runs.append(to[rows])
    none = np.zeros((0, WORDS), np.int32), np.zeros(0, np.int64)
    rows, counts = _summed(np.concatenate([none[0], *runs]), np.concatenate([none[1], *(c for _, _, c in parts)]), len(words))
    return words, rows, counts


def phrase_counts(words: list[bytes], runs: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[int, bytes, int]]:
    """(number of words, phrase, count) of each prefix of a range of sorted runs that has the
    ``least`` count or may go on in a neighbouring range; the empty one counts all."""
    if not len(runs):
        return []
    out = [(0, b"", int(counts.sum()))]
    changed = np.zeros(len(runs), bool)
    changed[0] = True
    for k in range(WORDS):
        changed[1:] |= runs[1:, k] != runs[:-1, k]
        starts = np.flatnonzero(changed)
        sums = np.add.reduceat(counts, starts)
        wanted = sums >= least
        wanted[[0, -1]] = True
        wanted &= runs[starts, k] != 0
        for i in np.flatnonzero(wanted).tolist():
            out.append((k + 1, b" ".join([words[w - 1] for w in runs[starts[i], : k + 1].tolist()]), int(sums[i])))
    return out


def _by_lang(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text of whole pieces) of about a block each."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            own = (text.as_py() or b"").translate(_PLAIN)
            held[lang].append(own)
            size += len(own)
            if size >= BLOCK_BYTES:
                for name, texts in held.items():
                    for block in _slices(_MARK.join(texts)):
                        yield name, block
                held.clear()
                size = 0
    for name, texts in held.items():
        for block in _slices(_MARK.join(texts)):
            yield name, block


def splitters(texts: DataFrame, total: int, n: int) -> list[tuple]:
    """``n`` - 1 runs, each with its language before it, that cut all runs of ``total`` bytes
    into parts of like size; the driver sorts about ``SAMPLED`` sampled runs for each part."""
    if n < 2:
        return []
    step = max(1, total // (6 * ONE_IN * SAMPLED * n))  # a word with its space takes about six bytes

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = step // 2
        for lang, data in _by_lang(batches):
            words, ids = _words(data)
            runs = _runs(ids)
            out = [b" ".join([words[w - 1] for w in run if w]) for run in runs[skip::step].tolist()]
            skip = (skip - len(runs)) % step
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(out, pa.binary())], ["lang", "run"])

    rows = texts.where(F.rand(7) * ONE_IN < 1).mapInArrow(sample, "lang string, run binary").collect()
    keys = sorted((r["lang"].encode(), *bytes(r["run"]).split(b" ")) for r in rows)
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def phrases(docs: DataFrame, least: int = LEAST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, size, phrase, f): the phrases of 1 to WORDS words that a language has ``least``
    times or more, and of each language the empty phrase, which counts all its words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = spark.sparkContext.broadcast(splitters(texts, total, -(-total // range_bytes)))  # one run for each range_bytes of text

    def count_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = known.value
        for lang, data in _by_lang(batches):
            words, ids = _words(data)
            runs = _runs(ids)
            runs, counts = _summed(runs, np.ones(len(runs), np.int64), len(words))
            key = lang.encode()

            def own(i: int) -> tuple:
                return (key, *(words[w - 1] for w in runs[i].tolist() if w))

            # The ranges of this language, and where they cut its runs.
            low, high = bisect.bisect_left(limits, (key,)), bisect.bisect_left(limits, (key + b"\0",))
            cuts = [0]
            for limit in limits[low:high]:
                cuts.append(bisect.bisect_left(range(len(runs)), limit, lo=cuts[-1], key=own))
            cuts.append(len(runs))
            rows = [(low + k, CountAutomaton.build(words, runs[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([lang] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["range", "lang", "automaton"])

    def unite(key: tuple, rows: pa.Table) -> pa.Table:
        out = [(key[1].as_py(), *found) for found in phrase_counts(*united(x.as_py() for x in rows.column("automaton")), least)]
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.table(arrays, names=["lang", "size", "phrase", "f"])

    blocks = texts.mapInArrow(count_block, "range long, lang string, automaton binary")
    counted = blocks.groupBy("range", "lang").applyInArrow(unite, "lang string, size int, phrase string, f long")
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    a, l and r count the phrase and the two parts of its weakest cut, n all words of the
    language.  A phrase inside a longer one that is as frequent is left out.  Null text
    counts as empty, null lang as ``und``; a language without such phrases has no rows.
    Repeated rows count each time.  An empty table gives an empty one; other columns are
    ignored.
    """
    counts = cut(phrases(docs, least, range_bytes))
    n = small(counts.where("size = 0").select("lang", F.col("f").alias("n")))
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.split("phrase", " ", -1).alias("words"), F.col("f").alias("a"))

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", start, length), " ")

    cuts = candidates.select("lang", "phrase", "words", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = counts.where("size BETWEEN 1 AND 4")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "alnr"}
    scored = cuts.join(n, "lang").withColumn("score", F.expr(SCORE.format(**exact)))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")

    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    starts = F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("start")
    inside = candidates.where("size > 2").select("lang", "words", "size", "a", F.explode(lengths).alias("length")).select("lang", "words", "length", "a", starts)
    inside = inside.select("lang", part(F.col("start"), F.col("length")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT c.*, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN n ON n.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
alone AS (SELECT * FROM weakest s WHERE NOT EXISTS (SELECT 1 FROM cand d WHERE d.lang = s.lang AND length(d.phrase) > length(s.phrase) AND contains(' ' || d.phrase || ' ', ' ' || s.phrase || ' ') AND d.a >= s.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, phrase, a, l, r, n, score::BIGINT AS score, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INT AS rank FROM alone) WHERE rank <= 2000"""
