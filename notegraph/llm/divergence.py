"""How far the sources of a language differ in their words.

The terms of a language are dealt by hash into blocks and numbered within their block.  In
a block every group (language, source) has a segment tree over the term numbers whose
leaves are its counts.  Trees are hash-consed bottom-up, one level at a time for all
groups: equal pairs of children are one node, whoever has them, so a subtree that two
groups share, such as one without occurrences, exists once.

Two trees are priced against each other by walking both from the root.  At each level
the pairs of nodes met are kept once, with the number of times they are met, so a pair of
equal subtrees is walked once however often it occurs; at the leaves a pair of counts is
priced once and multiplied.  Prices depend on the groups' totals, so pairs of nodes are
shared within a pair of groups.  All pairs of groups of a block are walked together, in
portions.

Blocks are sized by cells (terms x groups), so a task's memory does not follow the corpus,
the vocabulary or the number of sources.  Prices add up over blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

SCALE = 1_000_000_000
LEAST_DOCS, TOP_TERMS = 3, 200
#: Cells of a block, terms it has at most, and pairs of nodes walked together.
CELLS, MOST_TERMS, PORTION = 1 << 20, 1 << 12, 1 << 20
#: Entries of a task's table of counts; it is given out and emptied when full.
ENTRIES = 1_000_000
_SMALL = 1 << 30  # numbers whose products by SCALE fit 64 bits

_WORDS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) of ``docs``, nulls as '', summed within tasks alone."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter, defaultdict

        groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, n_docs) in groups.items():
                k = len(n)
                if k:
                    columns = [pa.array([lang] * k), pa.array([source] * k), pa.array(n, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(n_docs.__getitem__, n), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "n_docs"])
            groups.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                words = (text.as_py() or b"").translate(_WORDS).split()
                n, n_docs = groups[lang, source]
                n.update(words)
                n_docs.update(set(words))
            if sum(len(n) for n, _ in groups.values()) > ENTRIES:
                yield from flush()
        yield from flush()

    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")


def _share(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    if total + terms < _SMALL:
        return 1 + SCALE * (counts + 1) // (total + terms)
    return np.array([1 + SCALE * (int(c) + 1) // (total + terms) for c in counts], np.int64)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so squares fit 64 bits."""
    return (p - q) ** 2 // q


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Segment trees over the rows of ``counts`` (groups x a power of two), equal subtrees
    being one node: the root of each group, the children of each level's nodes from the
    root down, and the counts of the leaf nodes."""
    leaves, nodes = np.unique(counts, return_inverse=True)
    nodes, levels = nodes.reshape(counts.shape).astype(np.int64), []
    while nodes.shape[1] > 1:
        pairs = (nodes[:, 0::2] << 32) | nodes[:, 1::2]
        made, own = np.unique(pairs, return_inverse=True)
        levels.append(np.stack([made >> 32, made & 0xFFFFFFFF], axis=1))
        nodes = own.reshape(pairs.shape).astype(np.int64)
    return nodes[:, 0], levels[::-1], leaves


def met_leaves(levels: list[np.ndarray], pair: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, leaf of a, leaf of b, times met) of the simultaneous walk from the roots ``a``
    and ``b`` of each ``pair`` of groups; pairs of nodes are walked once each."""
    times = np.ones(len(pair), np.int64)
    for children in levels:
        pair = np.concatenate([pair, pair])
        a, b, times = np.concatenate([children[a, 0], children[a, 1]]), np.concatenate([children[b, 0], children[b, 1]]), np.concatenate([times, times])
        order = np.lexsort((b, a, pair))
        pair, a, b, times = pair[order], a[order], b[order], times[order]
        first = np.flatnonzero(np.r_[True, (np.diff(pair) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)])
        pair, a, b, times = pair[first], a[first], b[first], np.add.reduceat(times, first)
    return pair, a, b, times


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group (lang, source) of ``docs`` the
    other sources of its language by how far its words lie from theirs (part ``pair``),
    and the ``top_terms`` terms that it has more often than its language (``term``).

    A language keeps the terms that at least ``least_docs`` of its documents have.  Null
    text, lang and source are ''; an empty text has no terms and its group still counts.
    Repeated rows are documents of their own.  An empty table gives an empty one; other
    columns are ignored.
    """
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    # One shuffle by term serves the sums of a group's rows and the test over the language.
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    own = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"in_docs": F.sum("n_docs").over(own), "first": (F.row_number().over(own.orderBy("source")) == 1).cast("long")})
    kept = cut(counts.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "first"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("terms"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("n_terms"), F.count("*").alias("n_groups"))
    width = F.greatest(F.lit(1), F.least(F.lit(MOST_TERMS), F.floor(cells / F.col("n_groups"))))
    langs = cut(langs.withColumn("blocks", F.ceil(F.col("n_terms") / width).cast("long")))
    groups = cut(groups.select("lang", "source", "total").join(small(langs), "lang"))

    dealt = kept.join(small(langs.select("lang", "blocks")), "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), "blocks").alias("block"))
    heads = groups.where("blocks > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def price(key: tuple, rows: pa.Table, head: pa.Table) -> Iterator[pa.RecordBatch]:
        lang = key[0].as_py()
        sources, totals = zip(*sorted(zip(head.column("source").to_pylist(), head.column("total").to_pylist())))
        lang_total, n_terms = head.column("lang_total")[0].as_py(), head.column("n_terms")[0].as_py()
        terms = rows.column("term").combine_chunks().dictionary_encode()
        names, at = terms.dictionary.to_pylist(), terms.indices.to_numpy()
        if not names:
            return
        place = {s: i for i, s in enumerate(sources)}
        who = np.fromiter(map(place.__getitem__, rows.column("source").to_pylist()), np.int64, rows.num_rows)
        # Terms with alike counts stand together, so that more subtrees are equal.
        weight = np.bincount(at, rows.column("n").to_numpy(), len(names))
        order = np.argsort(weight, kind="stable")
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        size = 1 << (len(names) - 1).bit_length()
        table = np.zeros((len(sources), size), np.int64)
        table[who, number[at]] = rows.column("n").to_numpy()
        # Places beyond the terms have a count of their own, which costs nothing.
        table[:, len(names) :] = -1
        whole = np.where(table[0] < 0, -1, table.sum(axis=0))

        roots, levels, leaves = consed(table)
        shares = np.stack([_share(leaves, t, n_terms) for t in totals])
        n = len(sources)
        firsts = max(1, PORTION // (n * size))
        for begin in range(0, n, firsts):
            a, b = np.divmod(np.arange(begin * n, min(n, begin + firsts) * n), n)
            a, b = a[a != b], b[a != b]
            if not len(a):
                continue
            pair, x, y, times = met_leaves(levels, np.arange(len(a)), roots[a], roots[b])
            real = leaves[x] >= 0
            pair, x, y, times = pair[real], x[real], y[real], times[real]
            values = np.zeros(len(a), np.int64)
            np.add.at(values, pair, times * _gap(shares[a[pair], x], shares[b[pair], y]))
            yield _result(lang, [sources[i] for i in a], "pair", [sources[i] for i in b], values)
        q = _share(whole[: len(names)], lang_total, n_terms)
        texts = [names[i] for i in order]
        for i, source in enumerate(sources):
            own = table[i, : len(names)]
            p = _share(own, totals[i], n_terms)
            more = np.flatnonzero((own > 0) & (p > q))
            value = _gap(p[more], q[more])
            if len(more) > top_terms:
                best = value >= np.partition(value, len(value) - top_terms)[len(value) - top_terms]  # ties stay
                more, value = more[best], value[best]
            if len(more):
                yield _result(lang, [source] * len(more), "term", [texts[j] for j in more], value)

    found = dealt.groupBy("lang", "block").cogroup(heads.groupBy("lang", "block")).applyInArrow(_whole(price), "lang string, source string, part string, item string, value long")
    found = cut(found)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Languages without terms have no block: their pairs are 0.
    bare = groups.where("blocks = 0").select("lang", "source")
    more = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(more).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return ranked.unionByName(terms)


def _result(lang: str, source: list[str], part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
    n = len(source)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def _whole(parts):
    """The function of a group that Spark takes, from one that gives batches."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(key: tuple, rows: pa.Table, head: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(parts(key, rows, head)), schema)

    return run


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS doc FROM documents),
w AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY 1),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS own, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.n + v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
      FROM totals t JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE own > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 200"""
