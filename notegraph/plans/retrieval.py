"""Retrieval queries over the views, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchOptions
from ..functions import text as T
from ..operators import bm25, graph, retrieval, vectors
from ..operators.lineage import cut
from . import views

_ACCENTED, _PLAIN = T.latin_folding()


def _tokens(column: str) -> str:
    return f"regexp_extract_all(regexp_replace(translate(lower({column}), '{_ACCENTED}ς', '{_PLAIN}σ'), '[\\x{{300}}-\\x{{36F}}]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


BM25_SQL = f"""
terms AS (SELECT DISTINCT query_id, term, {_tokens("term")}[1] AS token FROM (SELECT query_id, unnest(terms) AS term FROM questions)),
tok AS (SELECT chunk_id, 2.0 AS w, unnest({_tokens("breadcrumb")}) AS token FROM chunks
        UNION ALL SELECT chunk_id, 1.0, unnest({_tokens("body")}) FROM chunks
        UNION ALL SELECT chunk_id, 1.5, unnest({_tokens("meta")}) FROM chunks),
lengths AS (SELECT chunk_id, count(*) AS n_tokens FROM tok GROUP BY 1),
stats AS (SELECT count(*) AS n, avg(n_tokens) AS mean FROM lengths),
hits AS (SELECT token, chunk_id, sum(w)::DOUBLE AS tf FROM tok WHERE token IN (SELECT token FROM terms) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM hits GROUP BY 1),
idf AS (SELECT token, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, stats),
bm25 AS (SELECT query_id, chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean))) AS score
         FROM terms JOIN hits USING (token) JOIN idf USING (token) JOIN lengths USING (chunk_id), stats GROUP BY 1, 2),
bm25_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 50)"""
VECTOR_SQL = """
dots AS (SELECT query_id, chunk_id, list_inner_product(c.vec, q.vec) AS score FROM question_vectors q, chunk_vectors c),
vector_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dots WHERE score >= 0) WHERE rank <= 50)"""
FUSED_SQL = """
fused AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(CASE WHEN r = 'bm25' THEN rank END) AS bm25_rank, min(CASE WHEN r = 'vector' THEN rank END) AS vector_rank
          FROM (SELECT query_id, chunk_id, rank, 'bm25' AS r FROM bm25_top UNION ALL SELECT query_id, chunk_id, rank, 'vector' FROM vector_top) GROUP BY 1, 2),
cand AS (SELECT f.*, path, ord, date FROM fused f JOIN chunks USING (chunk_id))"""
_BASE = ("notes", "chunks", "questions")
_VEC = (*_BASE, "vectors", "chunk_vectors", "question_vectors")
_KEYWORD = views.with_views(*_BASE) + "," + BM25_SQL
_HYBRID = views.with_views(*_VEC) + "," + BM25_SQL + "," + VECTOR_SQL + "," + FUSED_SQL


def _percap(source: str, top: int = 8) -> str:
    """Selection with at most three of a note."""
    return f"""capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY round(score, 9) DESC, path, ord) AS own FROM {source}) WHERE own <= 3),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, ord) AS rank FROM capped) WHERE rank <= {top})"""


def searcher(spark: SparkSession, sf_dir: str, linked: bool = False) -> retrieval.Searcher:
    return retrieval.Searcher(views.chunks(spark, sf_dir), views.chunk_vectors(spark, sf_dir), resolved(spark, sf_dir) if linked else None, views.keywords(spark, sf_dir))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_links(views.raw_links(spark, sf_dir), views.aliases(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.questions(spark, sf_dir), views.question_vectors(spark, sf_dir)


def _out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"), *columns)


def tokenize_terms(spark, sf_dir):
    q = views.table(spark, sf_dir, "benchmark")
    return q.select("item_id", F.posexplode(T.query_terms(F.col("text"))).alias("place", "term")).withColumn("place", F.col("place").cast("long"))


def fts_match_string(spark, sf_dir):
    return views.questions(spark, sf_dir).select("query_id", T.match_string(F.col("q")).alias("match"))


def token_df(spark, sf_dir):
    hits = bm25.occurrences(views.chunks(spark, sf_dir), bm25.phrases(views.questions(spark, sf_dir)))
    return bm25.document_frequencies(hits)


def doc_lengths(spark, sf_dir):
    return bm25.doc_lengths(views.chunks(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(views.chunks(spark, sf_dir)).select("n_chunks", F.round("avg_tokens", 6).alias("avg_tokens"))


def bm25_topk(spark, sf_dir):
    return _out(bm25.bm25_topk(views.keywords(spark, sf_dir), views.questions(spark, sf_dir), 50))


def phrase_questions(spark, sf_dir):
    q = views.questions(spark, sf_dir)
    return q.select("query_id", F.regexp_replace("q", r"^(\S+) (\S+).*$", "$1'$2").alias("q"))


def bm25_phrase(spark, sf_dir):
    """Places of the first two terms of each passage as one apostrophe phrase."""
    hits = bm25.occurrences(views.chunks(spark, sf_dir), bm25.phrases(phrase_questions(spark, sf_dir)))
    return hits.select("term", "chunk_id", F.col("tf_body").cast("long").alias("tf_body"))


def vector_topk(spark, sf_dir):
    _, v = _asked(spark, sf_dir)
    return _out(vectors.vector_topk(views.chunk_vectors(spark, sf_dir), v, 50))


def vector_floor(spark, sf_dir):
    _, v = _asked(spark, sf_dir)
    return _out(vectors.vector_topk(views.chunk_vectors(spark, sf_dir), v, 50, 0.3))


def normalize_vectors(spark, sf_dir):
    v = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5)).alias("vec"))
    unit = vectors.normalised(F.col("vec"))
    return v.select("vec_id", F.round(F.aggregate(F.transform(unit, lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 6).alias("squares"), F.round(unit[0], 6).alias("first"))


def rrf_fusion(spark, sf_dir):
    q, v = _asked(spark, sf_dir)
    f = retrieval.fuse(searcher(spark, sf_dir).ranked_lists(q, SearchOptions(), v))
    return f.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.col("vector_rank").cast("long").alias("vector_rank"))


def hybrid_search(spark, sf_dir):
    q, v = _asked(spark, sf_dir)
    return _out(searcher(spark, sf_dir).search(q, SearchOptions(dedupe=1.0), v), "path")


def hybrid_dated(spark, sf_dir):
    q, v = _asked(spark, sf_dir)
    return _out(searcher(spark, sf_dir).search(q, SearchOptions(dedupe=1.0, since="2024-06-01", until="2025-06-30"), v), "path")


def percap_selection(spark, sf_dir):
    q, v = _asked(spark, sf_dir)
    return _out(retrieval.select_capped(searcher(spark, sf_dir).candidates(q, SearchOptions(), v), 20, 1), "path")


def diversified_selection(spark, sf_dir):
    """The walk past near-duplicates, each choice depending on those before."""
    q, v = _asked(spark, sf_dir)
    return _out(searcher(spark, sf_dir).search(q, SearchOptions(), v), "path")


def link_neighbourhood(spark, sf_dir):
    seeds = bm25.bm25_topk(views.keywords(spark, sf_dir), views.questions(spark, sf_dir), 3)
    seeds = retrieval.of_chunks(seeds, views.chunks(spark, sf_dir).select("chunk_id", "path")).select("query_id", "path").distinct()
    return retrieval.neighbourhood(seeds, resolved(spark, sf_dir))


def link_boost(spark, sf_dir):
    q, v = _asked(spark, sf_dir)
    found = searcher(spark, sf_dir, linked=True).candidates(q, SearchOptions(link_boost=0.5), v)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "boosted")


def neighbour_context(spark, sf_dir):
    chunks = views.chunks(spark, sf_dir)
    hits = retrieval.of_chunks(bm25.bm25_topk(views.keywords(spark, sf_dir), views.questions(spark, sf_dir), 8), chunks.select("chunk_id", "path", "ord"))
    return retrieval.neighbour_context(hits, chunks, 2)


def explain_overlap(spark, sf_dir):
    q, v = _asked(spark, sf_dir)
    e = searcher(spark, sf_dir).explain(q, SearchOptions(), v)
    return e.groupBy("query_id").agg(F.count_if(F.col("retriever") == "bm25").alias("n_bm25"), F.count_if(F.col("retriever") == "vector").alias("n_vector"), F.count_if(F.col("in_both") & (F.col("retriever") == "bm25")).alias("n_both"))


def snippets(spark, sf_dir):
    chunks, q = views.chunks(spark, sf_dir), views.questions(spark, sf_dir)
    hits = retrieval.of_chunks(bm25.bm25_topk(views.keywords(spark, sf_dir), q, 8), chunks.select("chunk_id", "body")).join(q, "query_id")
    return hits.select("query_id", "chunk_id", T.snippet(F.col("body"), T.query_terms(F.col("q")), 60).alias("snippet"))


def ranks_of_three(spark, sf_dir):
    """Three lists fused, the third being the vector list upside down, with every list's rank."""
    q, v = _asked(spark, sf_dir)
    lists = cut(searcher(spark, sf_dir).ranked_lists(q, SearchOptions(), v))
    third = lists.where("retriever = 'vector'").select("query_id", F.lit("reversed").alias("retriever"), (51 - F.col("rank")).alias("rank"), "chunk_id")
    fused = retrieval.fuse(lists.unionByName(third), weights={"reversed": 0.5})
    return fused.select("query_id", "chunk_id", F.round("score", 6).alias("score"), retrieval.why_all(F.col("ranks"), F.lit(False)).alias("why"))


def why_citation(spark, sf_dir):
    q, v = _asked(spark, sf_dir)
    hits = searcher(spark, sf_dir).search(q, SearchOptions(dedupe=1.0), v)
    return hits.select("query_id", "chunk_id", retrieval.why(F.col("bm25_rank"), F.col("vector_rank"), F.col("boosted")).alias("why"), retrieval.citation(F.col("path"), F.col("start_line")).alias("citation"))


def hits_json(spark, sf_dir):
    q = views.questions(spark, sf_dir)
    return retrieval.hits_json(retrieval.Searcher(views.chunks(spark, sf_dir), keywords=views.keywords(spark, sf_dir)).search(q, SearchOptions(use_vector=False))).select("query_id", F.get_json_object("json", "$.rank").cast("long").alias("rank"), F.get_json_object("json", "$.citation").alias("citation"))


def queries():
    return {
        f.__name__: f
        for f in (
            tokenize_terms, fts_match_string, token_df, doc_lengths, corpus_stats, bm25_topk, bm25_phrase, vector_topk, vector_floor, normalize_vectors, rrf_fusion, hybrid_search,
            hybrid_dated, percap_selection, diversified_selection, link_neighbourhood, link_boost, neighbour_context, explain_overlap, snippets, ranks_of_three, why_citation, hits_json,
        )
    }


_BOTH = ("notes", "aliases", "raw_links")


def oracle_sql():
    picked = "SELECT query_id, rank, chunk_id, round(score, 6) AS score, path FROM picked"
    linked = _HYBRID.replace(views.SQL["notes"], views.SQL["notes"] + ",\n" + views.SQL["raw_links"] + ",\n" + views.SQL["aliases"] + ",\n" + graph.RESOLVE_SQL)
    near = """edges AS (SELECT DISTINCT src AS path, dst AS near FROM resolved WHERE dst IS NOT NULL UNION SELECT dst, src FROM resolved WHERE dst IS NOT NULL),
near AS (SELECT DISTINCT query_id, near AS path FROM seeds JOIN edges USING (path) EXCEPT SELECT query_id, path FROM seeds)"""
    return {
        "tokenize_terms": """SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY p) - 1)::BIGINT AS place, w AS term FROM (
            SELECT item_id, w, min(p) AS p FROM (SELECT item_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM (
              SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*') AS t FROM benchmark)) GROUP BY 1, 2) QUALIFY place < 32""",
        "fts_match_string": views.with_views("questions") + """ SELECT query_id, '"' || replace(q, ' ', '" OR "') || '"' AS match FROM questions""",
        "token_df": _KEYWORD + " SELECT term, df AS n_chunks FROM (SELECT DISTINCT term, token FROM terms) JOIN df USING (token)",
        "doc_lengths": _KEYWORD + " SELECT chunk_id, n_tokens FROM lengths",
        "corpus_stats": _KEYWORD + " SELECT n AS n_chunks, round(mean, 6) AS avg_tokens FROM stats",
        "bm25_topk": _KEYWORD + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm25_top",
        "bm25_phrase": views.with_views(*_BASE)
        + f""", p AS (SELECT DISTINCT terms[1] || '''' || terms[2] AS term, ' ' || array_to_string({_tokens("terms[1]")}, '  ') || '  ' || array_to_string({_tokens("terms[2]")}, '  ') || ' ' AS own FROM questions),
            c AS (SELECT chunk_id, ' ' || array_to_string({_tokens("body")}, '  ') || ' ' AS body FROM chunks)
            SELECT term, chunk_id, ((length(body) - length(replace(body, own, ''))) / length(own))::BIGINT AS tf_body FROM c JOIN p ON contains(body, own)""",
        "vector_topk": views.with_views(*_VEC) + "," + VECTOR_SQL + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM vector_top",
        "vector_floor": views.with_views(*_VEC) + "," + VECTOR_SQL + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM vector_top WHERE score >= 0.3",
        "normalize_vectors": """SELECT vec_id, round(list_inner_product(v, v) / (n * n), 6) AS squares, round(v[1] / n, 6) AS first FROM (
            SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT vec_id, [x::DOUBLE * (1 + vec_id % 5) FOR x IN embedding] AS v FROM embeddings))""",
        "rrf_fusion": _HYBRID + " SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank, vector_rank FROM fused",
        "hybrid_search": _HYBRID + "," + _percap("cand") + picked,
        "hybrid_dated": _HYBRID + ", dated AS (SELECT * FROM cand WHERE date BETWEEN DATE '2024-06-01' AND DATE '2025-06-30')," + _percap("dated") + picked,
        "percap_selection": _HYBRID + "," + _percap("cand", 20).replace("own <= 3", "own <= 1") + picked,
        "diversified_selection": _HYBRID.replace("WITH ", "WITH RECURSIVE ", 1)
        + """, ordered AS (SELECT query_id, chunk_id, path, score, vec, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, ord) AS pos FROM cand LEFT JOIN chunk_vectors USING (chunk_id)),
            walk AS (SELECT DISTINCT query_id, 0::BIGINT AS pos, []::STRUCT(chunk_id BIGINT, path VARCHAR, vec DOUBLE[])[] AS taken FROM ordered
              UNION ALL SELECT w.query_id, o.pos, CASE WHEN len(taken) >= 8 OR len([t FOR t IN taken IF t.path = o.path]) >= 3 OR len([t FOR t IN taken IF list_inner_product(t.vec, o.vec) >= 0.95]) > 0 THEN taken
                ELSE list_append(taken, {'chunk_id': o.chunk_id, 'path': o.path, 'vec': o.vec}) END FROM walk w JOIN ordered o ON o.query_id = w.query_id AND o.pos = w.pos + 1),
            done AS (SELECT query_id, unnest([t.chunk_id FOR t IN taken]) AS chunk_id, unnest(range(1, len(taken) + 1)) AS rank FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) = 1)
            SELECT query_id, rank, chunk_id, round(score, 6) AS score, path FROM done JOIN ordered USING (query_id, chunk_id)""",
        "ranks_of_three": _HYBRID
        + """, lists AS (SELECT query_id, chunk_id, rank, 'b' AS r, 1.0 AS w FROM bm25_top UNION ALL SELECT query_id, chunk_id, rank, 'v', 1.0 FROM vector_top UNION ALL SELECT query_id, chunk_id, 51 - rank, 'r', 0.5 FROM vector_top)
            SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 6) AS score, string_agg(r || rank, ' ' ORDER BY r || rank) AS why FROM lists GROUP BY 1, 2""",
        "link_neighbourhood": linked + ", seeds AS (SELECT DISTINCT query_id, path FROM bm25_top JOIN chunks USING (chunk_id) WHERE rank <= 3)," + near + " SELECT query_id, path FROM near",
        "link_boost": linked
        + """, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST) AS place FROM cand),
            seeds AS (SELECT query_id, path FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY min(place)) AS n FROM placed GROUP BY 1, 2) WHERE n <= 5),"""
        + near
        + " SELECT query_id, chunk_id, round(score + CASE WHEN near.path IS NULL THEN 0 ELSE 0.5 / 61 END, 6) AS score, near.path IS NOT NULL AS boosted FROM cand LEFT JOIN near USING (query_id, path)",
        "neighbour_context": _KEYWORD
        + """, h AS (SELECT query_id, chunk_id, path, ord FROM bm25_top JOIN chunks USING (chunk_id) WHERE rank <= 8)
            SELECT h.query_id, h.chunk_id, c.ord, c.chunk_id AS near_id, c.body FROM h JOIN chunks c ON c.path = h.path AND c.ord BETWEEN h.ord - 2 AND h.ord + 2
            WHERE (h.query_id, c.chunk_id) NOT IN (SELECT query_id, chunk_id FROM h)""",
        "explain_overlap": _HYBRID
        + " SELECT query_id, count(bm25_rank) AS n_bm25, count(vector_rank) AS n_vector, count(*) FILTER (WHERE bm25_rank IS NOT NULL AND vector_rank IS NOT NULL) AS n_both FROM fused GROUP BY 1",
        "snippets": _KEYWORD
        + """, h AS (SELECT query_id, chunk_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS flat, terms FROM bm25_top JOIN chunks USING (chunk_id) JOIN questions USING (query_id) WHERE rank <= 8),
            p AS (SELECT *, greatest(0, coalesce(list_min([instr(lower(flat), t) FOR t IN terms IF instr(lower(flat), t) > 0]) - 21, 0)) AS s FROM h)
            SELECT query_id, chunk_id, CASE WHEN length(flat) <= 60 THEN flat ELSE CASE WHEN s > 0 THEN '... ' ELSE '' END || substr(flat, s + 1, 60) || CASE WHEN s + 60 < length(flat) THEN ' ...' ELSE '' END END AS snippet FROM p""",
        "why_citation": _HYBRID + "," + _percap("cand") + " SELECT query_id, chunk_id, concat_ws(' ', 'b' || bm25_rank, 'v' || vector_rank) AS why, path || ':' || (ord + 1) AS citation FROM picked",
        "hits_json": _KEYWORD + ", cand AS (SELECT b.query_id, b.chunk_id, 1.0 / (60 + b.rank) AS score, path, ord FROM bm25_top b JOIN chunks USING (chunk_id))," + _percap("cand") + " SELECT query_id, rank, path || ':' || (ord + 1) AS citation FROM picked",
    }
