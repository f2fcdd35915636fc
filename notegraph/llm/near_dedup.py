"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

1. Every document becomes its set of hashed 5-word shingles, a digest of the set and
   BANDS band keys of its sketch (``shingles.sketches``).  Documents with equal sets are
   one class from here on, so copies cost nothing further.
2. Classes that share a band key are a bucket.  Each member is compared with the bucket's
   smallest class, on the full sets; the links give first components.
3. Where a bucket still holds several components, every pair across them is compared by
   size and on long sketches, in the bucket of its first common band alone.  Members with
   a likely partner send their full sets to the block, once each, and pairs are verified
   there; a pair whose ends are joined by then is skipped, as it could add nothing.
   Large buckets are compared in blocks (``_blocks``), so no task holds one whole.
   N texts that lie just below the threshold of each other still cost N * N / 2
   comparisons, but no more than N rows leave or enter a block.
4. Components of all links, joined back to documents.

With 32 bands of 4 coordinates a pair at the threshold of 0.85 shares no band key
with probability 5.5e-11; a long sketch of 512 coordinates falls short of 0.74 with 4.3e-11.
At a threshold of 0.8 it is 4.7e-8, and 2.2e-9 for falling short of 0.69.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed, one_row_each, small
from .components import connected_components
from .shingles import bands, shingle_sets, sketches

SKETCH, ROWS, LONG = 128, 4, 512
PERCENT = 85
#: How far an estimate from the long sketch may lie below the threshold.
SLACK = 0.11
BLOCK = 512
#: A set of so many shingles weighs one more in a block.
HEAVY_SET = 4096
#: A class is hot if it holds one in so many documents; so many there are at most.
HOT_SHARE = 1000
#: Documents a Python worker sketches at a time.
AT_ONCE = 256


def _texts(batch: pa.RecordBatch, start: int) -> list[bytes]:
    return [x or b"" for x in batch.column("text").slice(start, AT_ONCE).cast(pa.binary()).to_pylist()]


def row_key() -> Column:
    """Equal for rows of equal doc_id and text."""
    return F.unhex(F.md5(keyed(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_shingles, digest, bands) of whole texts."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                sets = list(shingle_sets(_texts(batch, start)))
                keys = bands(sketches(sets, SKETCH), ROWS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, AT_ONCE),
                        batch.column("row_key").slice(start, AT_ONCE),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "row_key", "n_shingles", "digest", "bands"],
                )

    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(sign, "doc_id long, row_key binary, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(rep, n, items, long, bands) of ``docs`` (rep, text): size of the set, its sorted hashes, a
    long sketch and the band keys, as bytes."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                sets = list(shingle_sets(_texts(batch, start)))
                long = (sketches(sets, LONG) & np.uint64(255)).astype(np.uint8)
                keys = bands(sketches(sets, SKETCH), ROWS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(start, AT_ONCE), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([r.tobytes() for r in long], pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary())],
                    ["rep", "n", "items", "long", "bands"],
                )

    return docs.select("rep", "text").mapInArrow(gather, "rep long, n long, items binary, long binary, bands binary")


class _Overlaps:
    """Sizes of the intersections of sets of one block.  Items of one set alone are left out once."""

    def __init__(self, sets: list[np.ndarray]):
        values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shared = counts[codes] > 1
        self._rows = np.split(codes[shared], np.searchsorted(owner[shared], np.arange(1, len(sets))))
        self._mark = np.zeros(len(values), bool)

    def sizes(self, i: int, at: np.ndarray) -> np.ndarray:
        """Of set i with each of ``at``."""
        self._mark[self._rows[i]] = True
        rows = [self._rows[j] for j in at]
        hits = np.append(0, np.cumsum(self._mark[np.concatenate(rows)]))
        self._mark[self._rows[i]] = False
        return np.diff(hits[np.cumsum([len(r) for r in rows])], prepend=0)


def _partners(rows: list[tuple], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, at): the members ``at`` that member i of a block may be linked with, each pair once.

    ``rows`` are (key, rep, component, half, n, long, bands).  The two lie in different
    components and halves, the smaller set is large enough, the long sketches agree in
    enough coordinates, and of all the buckets they share this is that of their first
    common band (if ``bands`` are given).
    """
    component, half, n = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    names, label, counts = np.unique(component, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    least = LONG * (percent / 100 - SLACK)
    long = np.frombuffer(b"".join([r[5] for r in rows]), np.uint8).reshape(-1, LONG)
    earlier = np.zeros((0, len(rows)), np.uint64)
    if rows[0][6] is not None:
        keys = np.frombuffer(b"".join([r[6] for r in rows]), np.uint64).reshape(len(rows), -1)
        band = (keys[0] == np.array([rows[0][0]], np.int64).view(np.uint64)).argmax()
        earlier = keys[:, :band].T.copy()
    largest, order = counts.argmax(), np.arange(len(rows))
    for i in np.flatnonzero(label != largest):  # pairs inside the largest component are never looked at
        # Both ends outside the largest component: the later one is looked at from the earlier.
        at = np.flatnonzero((label != label[i]) & ((half != half[i]) | (half[i] < 0)) & ((label == largest) | (order > i)))
        at = at[100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i])]
        for keys_of_band in earlier:
            if not len(at):
                break
            at = at[keys_of_band[at] != keys_of_band[i]]
        at = at[np.count_nonzero(long[at] == long[i], axis=1) >= least]
        if len(at):
            yield int(i), at


def _likely(rows: list[tuple], percent: int, star: bool) -> list[int]:
    """The members that have a partner."""
    found = np.zeros(len(rows), bool)
    for i, at in _partners(rows, percent):
        found[i] = found[at] = True
    return np.flatnonzero(found).tolist()


def _confirmed(rows: list[tuple], percent: int, star: bool) -> list[tuple[int, int]]:
    """Links on the full sets: those of the centre of a star, or else as many as join the
    components that any links of the block join."""
    sets = [np.frombuffer(r[7], np.uint64) for r in rows]
    n, root = np.array([len(s) for s in sets]), np.unique([r[2] for r in rows], return_inverse=True)[1]
    overlaps, out = None, []
    for i, at in _partners(rows, percent):
        if not star:
            at = at[root[at] != root[i]]
        if not len(at):
            continue
        overlaps = overlaps or _Overlaps(sets)
        both = overlaps.sizes(i, at)
        for j in at[100 * both >= percent * (n[at] + n[i] - both)].tolist():
            if star or root[j] != root[i]:
                out.append((min(rows[i][1], rows[j][1]), max(rows[i][1], rows[j][1])))
                if not star:
                    root[root == root[j]] = root[i]
    return out


PLACE = ("block", "key", "rep", "component", "half")


def _each_block(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """(block, its rows of ``columns`` after the first) of a partition sorted by block and key."""
    own, rows = None, []
    for batch in batches:
        for block, *row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if (block, row[0]) != own:
                if len(rows) > 1:
                    yield own[0], rows
                own, rows = (block, row[0]), []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield own[0], rows


def block_links(placed: DataFrame, sets: DataFrame, percent: int, star: bool) -> DataFrame:
    """Links (a, b) inside the blocks of ``placed`` (PLACE).

    The sketches of all members meet first; only members with a likely partner send
    their full sets, once for each block.  What leaves a block is at most a row for each
    member both times, however many pairs it has.
    """
    own = (*PLACE, "n", "long", "bands")

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _each_block(batches, own):
            if found := _likely(rows, percent, star):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(found), pa.int64())} | {c: pa.array([rows[i][k] for i in found], pa.int64()) for k, c in enumerate(PLACE[1:])})

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _each_block(batches, (*own, "items")):
            if found := _confirmed(rows, percent, star):
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*found)], ["a", "b"])

    def together(placed: DataFrame, *more: str) -> DataFrame:
        given = sets.withColumn("bands", F.lit(None).cast("binary")) if star else sets
        rows = small(placed).join(given.select("rep", "n", "long", "bands", *more), "rep").select(*own, *more)
        return rows.repartition("block").sortWithinPartitions("block", "key")

    could = cut(together(cut(placed)).mapInArrow(likely, ", ".join(f"{c} long" for c in PLACE)))
    return cut(together(could, "items").mapInArrow(confirm, "a long, b long"))


def _stars(members: DataFrame) -> DataFrame:
    """PLACE of each bucket's members with its leader, in chunks; the leader is in all of them."""
    star = members.where("rep <> leader").select("leader", "rep", "weight").distinct()
    chunks = star.groupBy("leader").agg(F.ceil(F.sum("weight") / BLOCK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks"))
    star = star.join(chunks, "leader").select(F.xxhash64("leader", chunk).alias("block"), "leader", "rep")

    def side(rep: str, number: int) -> DataFrame:
        return star.select("block", F.col("leader").alias("key"), F.col(rep).alias("rep"), F.lit(number).cast("long").alias("component"), F.lit(number).cast("long").alias("half"))

    return side("rep", 1).union(side("leader", 0).distinct())


def _blocks(placed: DataFrame) -> DataFrame:
    """``placed`` (key, rep, component) of the buckets with several components, dealt into
    blocks: (block, key, rep, component, half).

    Members weigh 1 and more for large sets.  A bucket of up to BLOCK is one block.  In a larger one the members outside its
    largest component are the others; every chunk of them meets every chunk of the largest
    component and every chunk of others.  Copies so grow with members times others, not
    with the square of the members.  Rows of one half (from 0 on) are not compared.
    """
    parts = placed.groupBy("key", "component").agg(F.sum("weight").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("key", F.col("largest.component").alias("main"), "members", (F.col("members") - F.col("largest.n")).alias("others"))
    chunks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = placed.drop("members").join(mixed, "key").withColumns({"n_main": chunks(F.col("members") - F.col("others")), "n_others": chunks(F.col("others"))})
    is_main = F.col("component") == F.col("main")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.when(is_main, F.col("n_main")).otherwise(F.col("n_others"))).cast("int"))
    own = F.col("chunk")

    def block(kind: int, i: Column, j: Column, half: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("block"), half.cast("long").alias("half"))

    def each(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    across = F.transform(each("n_main"), lambda c: block(1, c, own, F.lit(1)))
    among = F.transform(each("n_others"), lambda j: block(0, F.least(own, j), F.greatest(own, j), F.when(own == j, -1).otherwise(own)))
    dealt = (
        F.when(F.col("members") <= BLOCK, F.array(block(2, F.lit(0), F.lit(0), F.lit(-1))))
        .when(is_main, F.transform(each("n_others"), lambda i: block(1, own, i, F.lit(0))))
        .otherwise(F.concat(across, among))
    )
    return rows.select("key", "rep", "component", F.inline(dealt))


def grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``docs``, and (digest, n_docs, first, root) of each class of equal
    sets: its first row and that of its component, as (no_id, doc_id, row_key)."""
    signed = cut(signatures(docs))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "bands")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min(row).alias("least"), F.count("*").alias("n_docs"), (1 + F.floor(F.max("n_shingles") / HEAVY_SET)).alias("weight"))
    first = F.struct("least.no_id", "least.doc_id", "least.row_key").alias("first")
    classes = cut(classes.select("digest", "n_docs", first, F.monotonically_increasing_id().alias("rep"), "weight", F.col("least.bands").alias("bands")))
    keys = classes.select("rep", "weight", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).where("members > 1")
    members = cut(keys.join(buckets, "key"))
    # One text for each class: that of its first row, of whose repeats any one serves.
    wanted = cut(classes.join(members.select("rep").distinct(), "rep").select(F.col("first.row_key").alias("row_key"), "rep"))
    texts = docs.select(row_key().alias("row_key"), "text").join(small(wanted), "row_key").dropDuplicates(["row_key"])
    sets = cut(full_sets(texts))

    links = block_links(_stars(members), sets, percent, star=True)
    component = small(connected_components(links)).withColumnRenamed("node", "rep")

    placed = members.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    links = links.union(block_links(_blocks(placed), sets, percent, star=False))

    final = small(connected_components(links)).withColumnRenamed("node", "rep")
    roots = cut(final.join(classes.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("root")))
    named = small(cut(final.join(small(roots), "component").select("rep", "root")))
    return signed, cut(classes.join(named, "rep", "left").select("digest", "n_docs", "first", F.coalesce("root", "first").alias("root")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if their shingle sets overlap by ``percent`` of the union or
    more; component_id is the smallest doc_id reachable, kept is doc_id = component_id.
    Texts that are null, empty or white space have no shingles and are linked with
    nothing.  Fewer than five words are one shingle.  Different texts of one doc_id are
    documents of their own, and so are those of null doc_ids; component_id is null where
    no other doc_id is reachable, and kept then holds.  Repeated rows give repeated rows,
    an empty table an empty one; other columns are ignored.
    """
    signed, found = grouped(docs, percent)
    found = found.select("digest", "n_docs", F.col("root.doc_id").alias("component_id"))
    # Hot classes are few, by their share; the others are joined by digest.
    total = max(1, signed.count())
    hot = F.broadcast(found.where(F.col("n_docs") * HOT_SHARE >= total).select("digest", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    rest = found.where(F.col("n_docs") * HOT_SHARE < total).select(F.col("digest").alias("key"), "component_id")
    out = signed.drop("bands", "row_key").join(hot, "digest", "left")
    alone = (F.col("n_shingles") == 0) | F.col("is_hot").isNotNull()
    out = out.withColumn("key", F.when(alone, F.concat(F.col("digest"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary"))).otherwise(F.col("digest"))).join(rest, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("hot_id", "component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: exactly one of each component.

    It has the component's smallest doc_id, a null one only if there is no other; of
    several texts of that doc_id, and of repeated rows, any one stays.  Texts without
    shingles are linked with nothing: one row of each such doc_id and text stays.  An
    empty table gives an empty table.
    """
    signed, found = grouped(docs, percent)
    kept = found.where(F.col("root.row_key") == F.col("first.row_key")).select(F.col("first.row_key").alias("key"))
    alone = signed.where("n_shingles = 0").select(F.col("row_key").alias("key")).distinct()
    return one_row_each(docs, row_key(), kept.union(alone))
