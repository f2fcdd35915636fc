"""Cosine search by brute force: every question against every vector, in blocks.

Vectors stay where they are.  A task multiplies them with blocks of questions and passes on
the best n of each question alone.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import ranked
from .lineage import Best, cut

#: Questions of one matrix product, and of one pass over the vectors.
BLOCK_QUERIES, PASS_QUERIES = 512, 4096


def normalised(vec: Column) -> Column:
    """To unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(F.transform(vec, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)


def embed_texts(pending: DataFrame, model: str, provider: Callable[[list[str]], list[list[float]]], batch: int = 16, retries: int = 0, wait: float = 1.0) -> DataFrame:
    """(text_hash, model, dim, vec) of ``pending`` (text_hash, embed_text).

    ``provider`` maps up to ``batch`` texts to as many vectors of one dimension; they are
    brought to unit length.  It runs inside tasks, so it must be picklable.  A call that
    fails is made again up to ``retries`` times, after ``wait`` seconds and twice as long
    each time.
    """

    def asked(texts: list[str]) -> list[list[float]]:
        for k in range(retries):
            try:
                return provider(texts)
            except Exception:  # whatever the service raises; the last call's error is the task's
                time.sleep(wait * 2**k)
        return provider(texts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                got = np.asarray(asked(part.column("embed_text").to_pylist()), np.float32)
                if got.ndim != 2 or len(got) != part.num_rows:
                    raise ValueError(f"{part.num_rows} texts gave vectors of shape {got.shape}")
                norm = np.linalg.norm(got, axis=1, keepdims=True)
                got = got / np.where(norm > 0, norm, 1)
                columns = [part.column("text_hash"), pa.array([model] * len(got)), pa.array([got.shape[1]] * len(got), pa.int32()), pa.array(list(got), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["text_hash", "model", "dim", "vec"])

    return pending.select("text_hash", "embed_text").mapInArrow(run, "text_hash string, model string, dim int, vec array<float>")


def check_dimensions(vectors: DataFrame) -> int:
    """The one dimension of all vectors; an error if models were mixed."""
    low, high = vectors.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if low != high:
        raise ValueError(f"vectors have {low} to {high} dimensions; rebuild the index with one model")
    return low or 0


def vector_topk(vectors: DataFrame, questions: DataFrame, n: int = 50, floor: float = 0.0) -> DataFrame:
    """(query_id, rank, chunk_id, score): dot products of unit vectors, best first.

    ``vectors`` has (chunk_id, vec), ``questions`` (query_id, vec), all of one dimension.
    Scores under ``floor`` are left out.  More than PASS_QUERIES questions take several passes.
    """
    asked = cut(questions.select("query_id", F.col("vec").cast("array<double>").alias("vec")))
    passes = -(-max(1, asked.count()) // PASS_QUERIES)
    parts = [_best(vectors, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k), n, floor) for k in range(passes)]
    return cut(ranked(functools.reduce(DataFrame.unionByName, parts), n))


def _matrix(vec: pa.ListArray, dim: int) -> np.ndarray:
    sizes = np.diff(vec.offsets.to_numpy())
    if (sizes != dim).any():
        raise ValueError(f"vectors have {min(dim, sizes.min())} to {max(dim, sizes.max())} dimensions; rebuild the index with one model")
    return vec.flatten().to_numpy().reshape(-1, dim)


def _best(vectors: DataFrame, asked: DataFrame, n: int, floor: float) -> DataFrame:
    """(query_id, chunk_id, score) of at least the n best of each question of ``asked``."""
    own = asked.toArrow()  # about PASS_QUERIES rows
    names, vec = own.column("query_id").to_pylist(), own.column("vec").combine_chunks()
    dim = len(vec[0]) if names else 0
    queries = _matrix(vec, dim) if names else np.zeros((0, 0))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(n)
        for batch in batches if names else ():
            ids, matrix = batch.column("chunk_id").to_numpy(), _matrix(batch.column("vec"), dim)
            for start in range(0, len(names), BLOCK_QUERIES):
                for name, scores in zip(names[start:], queries[start : start + BLOCK_QUERIES] @ matrix.T):
                    at = np.flatnonzero(scores >= max(floor, found.least(name)))
                    found.add(name, ids[at], scores[at])
        yield found.table()

    return vectors.select("chunk_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(best, "query_id long, chunk_id long, score double")
