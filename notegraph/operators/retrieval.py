"""From two ranked lists to hits: fusion, date filter, link boost, selection, context.

Every relation carries query_id; one question is the case of one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchOptions
from ..functions.text import query_terms
from .bm25 import KeywordIndex, bm25_topk
from .lineage import cut, small
from .vectors import vector_topk


def fuse(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, retriever, rank, chunk_id).

    Returns (query_id, chunk_id, score, bm25_rank, vector_rank, ranks): ranks maps the name
    of each retriever that has the chunk, of any number, to its rank.  A retriever without
    a weight counts 1.
    """
    weight: Column = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("retriever") == name, float(value)).otherwise(weight)
    return lists.groupBy("query_id", "chunk_id").agg(
        F.sum(weight / (F.lit(k) + F.col("rank"))).alias("score"),
        F.min(F.when(F.col("retriever") == "bm25", F.col("rank"))).alias("bm25_rank"),
        F.min(F.when(F.col("retriever") == "vector", F.col("rank"))).alias("vector_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "rank")))).alias("ranks"),
    )


def in_range(date: Column, since: str | None, until: str | None) -> Column:
    """Both ends included; an undated note fails any filter."""
    keep = F.lit(True)
    if since:
        keep = keep & (date >= F.lit(since).cast("date"))
    if until:
        keep = keep & (date <= F.lit(until).cast("date"))
    return F.coalesce(keep, F.lit(False)) if since or until else F.lit(True)


def neighbourhood(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, path): notes one hop from the seeds (query_id, path), either way, that
    are no seeds themselves."""
    edges = links.where("dst IS NOT NULL").select("src", "dst")
    own = cut(seeds.select("query_id", "path").distinct())
    asked = small(own)
    ways = [asked.join(edges.toDF(*ends), "path").select("query_id", F.col("near").alias("path")) for ends in (("path", "near"), ("near", "path"))]
    return ways[0].unionByName(ways[1]).distinct().join(own, ["query_id", "path"], "left_anti")


def of_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` with the other columns of their chunks, which are read without a shuffle."""
    return small(cut(hits)).join(chunks, "chunk_id")


def link_boost(fused: DataFrame, links: DataFrame, boost: float, k: int = 60, seeds: int = 5) -> DataFrame:
    """``fused`` (with path) with scores raised for notes linked to the first ``seeds``
    distinct notes, and the flag boosted.  The bonus is a fraction of one first place."""
    if not boost:
        return fused.withColumn("boosted", F.lit(False))
    fused = cut(fused)  # at most two lists a question, read for the seeds and for the scores
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"))
    placed = fused.withColumn("place", F.row_number().over(order))
    first = placed.groupBy("query_id", "path").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    chosen = first.withColumn("n", rank).where(F.col("n") <= seeds).select("query_id", "path")
    near = neighbourhood(chosen, links).withColumn("boosted", F.lit(True))
    out = fused.join(near, ["query_id", "path"], "left").withColumn("boosted", F.coalesce("boosted", F.lit(False)))
    return out.withColumn("score", F.when(F.col("boosted"), F.col("score") + boost / (k + 1)).otherwise(F.col("score")))


def select_capped(candidates: DataFrame, top_k: int, per_note: int) -> DataFrame:
    """The first ``top_k`` of each question with at most ``per_note`` of a note: the
    selection when near-duplicates are let through, as two row numbers."""
    order = [F.desc(F.round("score", 9)), "path", "ord"]
    own = F.row_number().over(Window.partitionBy("query_id", "path").orderBy(*order))
    capped = candidates.withColumn("_own", own).where(F.col("_own") <= per_note).drop("_own")
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top_k)


def select_diverse(candidates: DataFrame, vectors: DataFrame, top_k: int, per_note: int, dedupe: float) -> DataFrame:
    """Walk the candidates of a question by (score, path, ord) and take one unless its
    note has ``per_note`` hits already or its vector is within ``dedupe`` of a hit's.

    A chunk without a vector is never a duplicate.  The walk depends on what was taken
    before, so a question is one group, of at most two lists' worth of candidates; what
    each is to each other is one matrix product before the walk.
    """
    if dedupe >= 1.0:
        return select_capped(candidates, top_k, per_note)

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        ids, paths = rows.column("chunk_id").to_pylist(), rows.column("path").to_pylist()
        known = [v for v in rows.column("vec").to_pylist() if v is not None]
        matrix = np.array([v if v is not None else [0.0] * len(known[0]) for v in rows.column("vec").to_pylist()]) if known else np.zeros((len(ids), 1))
        near = matrix @ matrix.T >= dedupe
        near &= np.outer(*[rows.column("vec").is_valid().to_numpy()] * 2)
        taken: list[int] = []
        order = zip(rows.column("key").to_pylist(), paths, rows.column("ord").to_pylist(), range(len(ids)))
        for *_, i in sorted(order):
            if len(taken) == top_k:
                break
            if sum(paths[j] == paths[i] for j in taken) < per_note and not near[i, taken].any():
                taken.append(i)
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(taken), pa.int64()), "chunk_id": pa.array([ids[i] for i in taken], pa.int64()), "rank": pa.array(range(1, len(taken) + 1), pa.int32())})

    candidates = cut(candidates)  # read for the walk and for its result
    wanted = small(candidates.select("chunk_id").distinct())
    vec = vectors.join(wanted, "chunk_id", "left_semi").select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))
    lists = candidates.select("query_id", (-F.round("score", 9)).alias("key"), "path", "ord", "chunk_id").join(vec, "chunk_id", "left")
    chosen = lists.groupBy("query_id").applyInArrow(walk, "query_id long, chunk_id long, rank int")
    return candidates.join(chosen, ["query_id", "chunk_id"])


def neighbour_context(hits: DataFrame, chunks: DataFrame, span: int) -> DataFrame:
    """(query_id, chunk_id, ord, near_id, body): chunks up to ``span`` before and after
    each hit in its note, other hits of the question left out."""
    near = chunks.select(F.col("path"), F.col("ord").alias("near_ord"), F.col("chunk_id").alias("near_id"), F.col("body").alias("near_body"))
    hits = cut(hits.select("query_id", "chunk_id", "path", "ord"))
    steps = F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("step")
    wanted = hits.select("query_id", "chunk_id", "path", "ord", steps).where("step <> 0").withColumn("near_ord", (F.col("ord") + F.col("step")).cast("int"))
    found = small(wanted).join(near, ["path", "near_ord"])  # an equi-join: the band has 2 * span places
    others = hits.select("query_id", F.col("chunk_id").alias("near_id"))
    return found.join(others, ["query_id", "near_id"], "left_anti").select("query_id", "chunk_id", F.col("near_ord").alias("ord"), "near_id", F.col("near_body").alias("body"))


def with_context(hits: DataFrame, chunks: DataFrame, span: int) -> DataFrame:
    """``hits`` plus context: array<struct<ord, body>> of ``neighbour_context`` in note
    order, empty where a hit has none; at most 2 * span entries."""
    entries = F.array_sort(F.collect_list(F.struct("ord", "body"))).alias("context")
    near = neighbour_context(hits, chunks, span).groupBy("query_id", "chunk_id").agg(entries)
    none = F.array().cast(near.schema["context"].dataType)
    return hits.join(near, ["query_id", "chunk_id"], "left").withColumn("context", F.coalesce("context", none))


def why(bm25_rank: Column, vector_rank: Column, boosted: Column) -> Column:
    """Which retriever found a hit, as in ``b3 v11 link``."""
    return F.concat_ws(" ", F.concat(F.lit("b"), bm25_rank.cast("string")), F.concat(F.lit("v"), vector_rank.cast("string")), F.when(boosted, "link"))


def why_all(ranks: Column, boosted: Column) -> Column:
    """``why`` over any retrievers: the first letter of each with its rank, in order."""
    places = F.array_sort(F.transform(F.map_entries(ranks), lambda e: F.concat(F.substring(e["key"], 1, 1), e["value"].cast("string"))))
    return F.concat_ws(" ", places, F.when(boosted, "link"))


def citation(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"))


class Searcher:
    """Search over one index: chunks (chunk_id, path, ord, date, breadcrumb, meta, body[,
    start_line]), vectors (chunk_id, vec) and links (src, dst), the last two optional.
    Without start_line every chunk is one line of its note.  ``keywords`` are stored
    postings of the chunks; without them each search makes those of its terms."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, links: DataFrame | None = None, keywords: KeywordIndex | None = None):
        own = chunks if "start_line" in chunks.columns else chunks.withColumn("start_line", F.col("ord") + 1)
        self.chunks, self.vectors, self.links = own, vectors, links
        self.keywords = keywords or KeywordIndex(own)

    def ranked_lists(self, questions: DataFrame, options: SearchOptions, question_vectors: DataFrame | None = None) -> DataFrame:
        """(query_id, retriever, rank, chunk_id) before fusion."""
        asked = questions.where(F.size(query_terms(F.col("q"))) > 0)
        lists = []
        if options.use_bm25:
            lists.append(bm25_topk(self.keywords, asked, options.candidates, options.column_weights).withColumn("retriever", F.lit("bm25")))
        if options.use_vector and self.vectors is not None and question_vectors is not None:
            own = question_vectors.join(asked.select("query_id"), "query_id", "left_semi")
            lists.append(vector_topk(self.vectors, own, options.candidates, options.min_score).withColumn("retriever", F.lit("vector")))
        if not lists:
            raise ValueError("neither keyword nor vector search is possible")
        out = lists[0]
        for more in lists[1:]:
            out = out.unionByName(more)
        return out.select("query_id", "retriever", "rank", "chunk_id")

    def candidates(self, questions: DataFrame, options: SearchOptions, question_vectors: DataFrame | None = None) -> DataFrame:
        """Fused, filtered and boosted, not yet selected."""
        fused = fuse(self.ranked_lists(questions, options, question_vectors), options.rrf_k, options.weights)
        rows = of_chunks(fused, self.chunks.select("chunk_id", "path", "ord", "start_line", "date")).where(in_range(F.col("date"), options.since, options.until))
        if self.links is None:
            return rows.withColumn("boosted", F.lit(False))
        return link_boost(rows, self.links, options.link_boost, options.rrf_k, options.link_seeds)

    def search(self, questions: DataFrame, options: SearchOptions = SearchOptions(), question_vectors: DataFrame | None = None) -> DataFrame:
        """Hits (query_id, rank, chunk_id, path, ord, start_line, date, score, ranks, boosted,
        breadcrumb, body); with ``neighbours`` also context, as ``with_context`` gives it."""
        found = self.candidates(questions, options, question_vectors)
        if self.vectors is None:
            hits = select_capped(found, options.top_k, options.per_note)
        else:
            hits = select_diverse(found, self.vectors, options.top_k, options.per_note, options.dedupe)
        hits = of_chunks(hits, self.chunks.select("chunk_id", "breadcrumb", "body"))
        return with_context(hits, self.chunks, options.neighbours) if options.neighbours > 0 else hits

    def explain(self, questions: DataFrame, options: SearchOptions = SearchOptions(), question_vectors: DataFrame | None = None) -> DataFrame:
        """Both lists of each question and whether the other has the chunk as well."""
        lists = self.ranked_lists(questions, options, question_vectors)
        both = F.count("*").over(Window.partitionBy("query_id", "chunk_id")) > 1
        return lists.withColumn("in_both", both)


def hits_json(hits: DataFrame) -> DataFrame:
    """(query_id, json) of each hit; context is empty where the search attached none."""
    cite = citation(F.col("path"), F.col("start_line"))
    context = F.transform("context", lambda c: c["body"]) if "context" in hits.columns else F.array().cast("array<string>")
    ranks = F.struct(F.col("bm25_rank").alias("bm25"), F.col("vector_rank").alias("vector"))
    fields = F.struct("rank", cite.alias("citation"), "path", F.col("start_line").alias("line"), "breadcrumb", F.col("date").cast("string").alias("date"), F.round("score", 6).alias("score"), ranks.alias("ranks"), "boosted", "body", context.alias("context"))
    return hits.select("query_id", F.to_json(fields).alias("json"))
