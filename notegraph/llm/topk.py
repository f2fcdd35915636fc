"""Exact top-k search by MaxScore over integer vectors.

The dimensions of a vector are its terms.  Candidates are dealt by hash into shards of
about SHARD_ROWS, queries into blocks of about BLOCK_QUERIES; every block meets every
shard once, so no task holds more than one of each.  In a shard, a query's terms are
ordered by how far apart their score bounds lie.  The first ones are essential: their
postings are traversed for all candidates.  The others are only probed for candidates
that the bounds of the terms still to come leave competitive.  The best k of each
shard are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, SCALE, EVERY = 10, 1024, 100
#: Either side is copied once for each block of the other, so both are of one size.
SHARD_ROWS, BLOCK_QUERIES, STEP = 8192, 8192, 16
#: Sums of products below this are exact in 64-bit floats, which multiply faster.
EXACT = 2**53


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(ids) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def max_score(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a shard; ``low`` and ``high`` bound its columns."""
    upper = np.maximum(query * low, query * high)
    order = np.argsort(np.minimum(query * low, query * high) - upper, kind="stable")
    live = np.flatnonzero(ids != query_id)
    partial = np.zeros(len(live), vectors.dtype)
    threshold = None
    for start in range(0, len(order), STEP):
        terms = order[start : start + STEP]
        partial += vectors[np.ix_(live, terms)] @ query[terms]
        rest = order[start + STEP :]
        if len(live) <= k or not len(rest):
            continue
        top = np.argpartition(partial, len(live) - k)[len(live) - k :]
        full = (partial[top] + vectors[np.ix_(live[top], rest)] @ query[rest]).min()
        threshold = full if threshold is None else max(full, threshold)
        keep = partial + upper[rest].sum() >= threshold
        live, partial = live[keep], partial[keep]
    at = best(ids[live], partial, k)
    return ids[live][at], partial[at]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    rows = table.column("q").to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return ids, out


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query.

    ``vectors`` has vec_id and embedding.  Components x become floor(scale * x).  The
    queries are the rows whose vec_id is divisible by ``every``; candidates are all rows
    with another vec_id.  Rows with a null vec_id, a null vector, or a null or
    non-finite component take no part; a shorter vector counts as ending in zeros.  A
    vec_id that repeats is as many candidates, but one query (its smallest vector).  An
    empty table gives an empty table; other columns are ignored.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))
    rows = cut(vectors.where(usable).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q")))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    shards = -(-max(1, rows.count()) // SHARD_ROWS)
    blocks = -(-max(1, asked.count()) // BLOCK_QUERIES)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return df.select("vec_id", "q", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int").alias(own), each)

    def search(key: tuple, own: pa.Table, questions: pa.Table) -> pa.Table:
        ids, matrix = _matrix(own)
        names, queries = _matrix(questions)
        width = max(matrix.shape[1], queries.shape[1])
        matrix, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (matrix, queries))
        out = []
        largest = int(np.abs(matrix).max(initial=0)) * int(np.abs(queries).max(initial=0)) * width
        if largest < EXACT:
            matrix, queries = matrix.astype(float), queries.astype(float)
        if len(ids):
            low, high = matrix.min(axis=0), matrix.max(axis=0)
            out = [(name, *max_score(ids, matrix, name, query, low, high, k)) for name, query in zip(names, queries)]
        found = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in ([np.full(len(i), n) for n, i, _ in out], [i for _, i, _ in out], [s for _, _, s in out])]
        return pa.table([pa.array(x.astype(np.int64)) for x in found], names=["query_id", "vec_id", "score"])

    candidates = dealt(rows, "shard", shards, "block", blocks).groupBy("shard", "block")
    questions = dealt(asked, "block", blocks, "shard", shards).select("vec_id", "q", "shard", "block").groupBy("shard", "block")
    found = candidates.cogroup(questions).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
