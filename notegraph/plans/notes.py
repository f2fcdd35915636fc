"""Queries for dates, links, maintenance, markdown, chunks, answers and evaluation,
with the SQL each is compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnswerOptions, EngineConfig, SearchOptions
from ..functions import chunking, dates, markdown
from ..functions import text as T
from ..operators import answer, bm25, evaluate, graph, maintain, retrieval
from ..operators.lineage import checkpoint_dir, cut, small, spread
from ..sources import generated, vault
from ..streaming import think
from . import retrieval as plans
from . import views

MODES = {"hybrid": SearchOptions(dedupe=1.0), "bm25 only": SearchOptions(dedupe=1.0, use_vector=False), "vector only": SearchOptions(dedupe=1.0, use_bm25=False)}


# ---- dates


def find_date_filename(spark, sf_dir):
    """Order dates written in five ways, found again."""
    o = spread(views.table(spark, sf_dir, "orders"))
    form = ["yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy", "dd-MM-yy", "d.M.yy"]
    name = F.concat(F.lit("Meeting_"), *[F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", f)).otherwise("") for i, f in enumerate(form)], F.lit(" notes"))
    return o.select("o_orderkey", dates.find_date(name).alias("found"))


def find_date_rejects(spark, sf_dir):
    """Version numbers, mixed separators and days that don't exist are no dates."""
    o = views.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "dd")
    bad = F.array(F.concat(F.lit("v"), day, F.lit(".2.26")), F.concat(day, F.lit("-08.2026")), F.concat(F.lit("31-02-20"), day), F.concat(F.lit("2025-13-"), day))
    return o.select("o_orderkey", dates.find_date(F.element_at(bad, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("found"))


def note_date_precedence(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int"))
    i = F.col("doc_id")
    path = F.concat(F.lit("daily/"), F.when(i % 3 == 0, day.cast("string")).otherwise("note"), F.lit(".md"))
    value = lambda when: F.when(when, F.array(F.date_format(day, "dd.MM.yyyy"))).otherwise(F.array(F.lit("soon")))
    front = F.create_map(F.lit("date"), value(i % 3 == 1), F.lit("created"), value(i % 4 == 0))
    found = dates.note_date(path, front)
    return d.select("doc_id", found["date"].alias("date"), found["source"].alias("source"))


def dates_report(spark, sf_dir):
    return maintain.dates_report(views.notes(spark, sf_dir))


def latest_notes(spark, sf_dir):
    return maintain.latest_notes(views.notes(spark, sf_dir))


# ---- links


def resolve_links(spark, sf_dir):
    return plans.resolved(spark, sf_dir)


def backlinks(spark, sf_dir):
    return graph.backlinks(plans.resolved(spark, sf_dir))


def outlinks(spark, sf_dir):
    return graph.outlinks(plans.resolved(spark, sf_dir))


def link_stats(spark, sf_dir):
    return graph.link_stats(plans.resolved(spark, sf_dir))


def most_linked(spark, sf_dir):
    return graph.most_linked(plans.resolved(spark, sf_dir))


def unwritten_concepts(spark, sf_dir):
    return graph.unwritten(plans.resolved(spark, sf_dir))


# ---- maintenance


def change_detection(spark, sf_dir):
    n = views.notes(spark, sf_dir)
    known = n.where("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 4 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return maintain.changes(n.where("doc_id % 13 <> 0"), known)


def _hashed(spark, sf_dir):
    return views.chunks(spark, sf_dir).select("chunk_id", "doc_id", "path", "body", F.sha2("body", 256).alias("text_hash"), F.col("body").alias("embed_text"))


def pending_vectors(spark, sf_dir):
    c = _hashed(spark, sf_dir)
    have = c.where("doc_id % 3 = 0").select("text_hash", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("model")).distinct()
    return maintain.pending_vectors(c, have, "a").select("text_hash")


def put_vectors(spark, sf_dir):
    v = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("text_hash"), F.lit("a").alias("model"), F.col("label"))
    fresh = v.where("label % 2 = 0").withColumn("label", F.col("label") + 100)
    return maintain.put_vectors(v, fresh)


def cascade_delete(spark, sf_dir):
    gone = views.notes(spark, sf_dir).where("doc_id % 9 = 0").select("path")
    return maintain.without_notes(views.chunks(spark, sf_dir), gone).select("chunk_id", "path")


def upsert_snapshot(spark, sf_dir):
    c = _hashed(spark, sf_dir).select("path", "chunk_id", "text_hash")
    fresh = c.where("chunk_id % 200000 < 100000").select("path", "chunk_id", F.lit("new").alias("text_hash"))
    return maintain.upsert(c, fresh)


def index_stats(spark, sf_dir):
    return maintain.index_stats(views.notes(spark, sf_dir), views.chunks(spark, sf_dir), views.raw_links(spark, sf_dir), views.vectors(spark, sf_dir))


def chunk_size_stats(spark, sf_dir):
    return maintain.chunk_size_stats(views.chunks(spark, sf_dir))


# ---- sources


def _odd_paths(spark, sf_dir):
    """Paths of every kind that is skipped, and good ones."""
    c = views.table(spark, sf_dir, "customer")
    kinds = ["notes/{}.md", ".obsidian/{}.md", "a/.git/{}.md", "a/.x/{}.md", "a/.{}.md", "a/{}.png", "a/{}.sync-conflict-2024.md", "a/{} (conflicted copy 2).MD", "a/{} (Ann's conflicted copy).md", "a/{}-desk-pc.md", "a/~${}.md", "a/{}.MD"]
    parts = F.array(*[F.lit(k) for k in kinds])
    return c.select("c_custkey", F.replace(F.element_at(parts, (F.col("c_custkey") % len(kinds) + 1).cast("int")), F.lit("{}"), F.col("c_name")).alias("path"))


def conflict_names(spark, sf_dir):
    return _odd_paths(spark, sf_dir).select("c_custkey", vault.is_conflict_name(F.substring_index("path", "/", -1)).alias("conflict"))


def skip_report(spark, sf_dir):
    return _odd_paths(spark, sf_dir).select("path", vault.skip_reason(F.col("path")).alias("skip_reason"))


def newline_normalise(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    end = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")
    content = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), end)).cast("binary")
    return d.select("doc_id", F.sha2(markdown.normalised_text(content), 256).alias("text_sha256"))


def content_hash(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


# ---- markdown

_NOTE = (
    "---\ntitle: {name}\naliases: [Part {key}, \"P {key}\"]\ntags:\n  - {brand}\n  - '#Made'\n---\nLead #size{size} with [[Nation {n}|the nation]] and ![[Other {o}]] ![[x.png]].\n\n"
    "# {type}\n\n> [!note] Price\n> is {price}\n\n```sql\n# no heading [[x]]\n```\n%%hidden%%\n## Size #\n=={size}==[^1] [list](lists/l{o}.md) #made\n"
)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(views.table(spark, sf_dir, "part"))
    fill = {"name": F.col("p_name"), "key": F.col("p_partkey"), "brand": F.regexp_replace("p_brand", "#", ""), "size": F.col("p_size"), "type": F.col("p_type"), "n": F.col("p_partkey") % 25, "o": F.col("p_partkey") % 7, "price": F.col("p_size") * 3}
    text = F.lit(_NOTE)
    for k, v in fill.items():
        text = F.replace(text, F.lit("{" + k + "}"), v.cast("string"))
    return p.select("p_partkey", F.concat(F.lit("parts/kind-"), (F.col("p_partkey") % 25).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


def _joined(column: str):
    return F.array_join(column, "|").alias(column)


def note_metadata(spark, sf_dir):
    p = markdown.parse_notes(_notes(spark, sf_dir))
    return p.select("p_partkey", "title", *[_joined(c) for c in ("aliases", "tags", "links", "embeds")])


def section_split(spark, sf_dir):
    p = markdown.section_rows(markdown.parse_notes(_notes(spark, sf_dir)), "p_partkey")
    return p.select("p_partkey", F.col("n").cast("long").alias("n"), F.col("level").cast("long").alias("level"), "heading", F.array_join("trail", " > ").alias("trail"), F.col("start_line").cast("long").alias("start_line"), "body")


def fence_lines(spark, sf_dir):
    masked = markdown.fence_mask(markdown.lines(F.col("text")))
    rows = _notes(spark, sf_dir).select("p_partkey", F.posexplode(masked).alias("n", "r"))
    return rows.where("r.inside").select("p_partkey", F.col("n").cast("long").alias("n"), "r.lang")


def chunk_notes(spark, sf_dir):
    c = chunking.chunk_notes(markdown.parse_notes(_notes(spark, sf_dir)), EngineConfig())
    return c.select("path", F.col("ord").cast("long").alias("ord"), "breadcrumb", "heading", F.col("start_line").cast("long").alias("start_line"), "body", "meta_text", "text_hash")


def _varied(spark, sf_dir):
    """Notes of five kinds for the keys of ``part``."""
    return generated.notes(spread(views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))))


def varied_metadata(spark, sf_dir):
    p = markdown.parse_notes(_varied(spark, sf_dir))
    return p.select("id", "path", "title", *[_joined(c) for c in ("aliases", "tags", "links", "embeds")])


def varied_sections(spark, sf_dir):
    p = markdown.section_rows(markdown.parse_notes(_varied(spark, sf_dir)), "id")
    return p.select("id", F.col("n").cast("long").alias("n"), F.col("level").cast("long").alias("level"), "heading", F.array_join("trail", " > ").alias("trail"), F.col("start_line").cast("long").alias("start_line"), "body")


def varied_fences(spark, sf_dir):
    rows = _varied(spark, sf_dir).select("id", F.inline(F.transform(markdown.fence_mask(markdown.lines(F.col("text"))), lambda r, i: F.struct(i.cast("long").alias("n"), r["inside"].alias("inside"), r["lang"].alias("lang")))))
    return rows.where("inside").select("id", "n", "lang")


def varied_dates(spark, sf_dir):
    """The day of each note: that of its name, or else of its frontmatter."""
    p = markdown.parse_notes(_varied(spark, sf_dir))
    found = dates.note_date(F.col("path"), F.transform_values("frontmatter", lambda _, v: v["vals"]))
    return p.select("id", found["date"].alias("date"), found["source"].alias("source"))


def paragraphs(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    p = chunking.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n \n")))
    return d.select("doc_id", F.posexplode(p).alias("n", "para")).select("doc_id", F.col("n").cast("long").alias("n"), "para")


def pack_units(spark, sf_dir):
    """Lines of documents as paragraphs, packed; the SQL walks from each cut to the next."""
    d = views.table(spark, sf_dir, "documents")
    units = chunking.pack_paragraphs(chunking.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))), EngineConfig())
    return d.select("doc_id", F.posexplode(units).alias("n", "unit")).select("doc_id", F.col("n").cast("long").alias("n"), F.length("unit").cast("long").alias("n_chars"))


# ---- answers


def estimate_tokens(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def context_budget(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 5) * 2048).alias("n_ctx"))
    return c.select("c_custkey", answer.context_budget(F.col("n_ctx")).alias("budget"))


def _hits(spark, sf_dir):
    chunks = views.chunks(spark, sf_dir)
    return retrieval.of_chunks(bm25.bm25_topk(views.keywords(spark, sf_dir), views.questions(spark, sf_dir), 8), chunks).withColumn("rank", F.col("rank").cast("long"))


def pack_sources(spark, sf_dir):
    offered = answer.offers(_hits(spark, sf_dir), views.chunks(spark, sf_dir), None)
    return answer.pack_sources(offered, 300).select("query_id", "n", "path", F.length("body").cast("long").alias("n_chars"), "dropped")


def pack_sources_transcluded(spark, sf_dir):
    """Each hit transcludes the note after its own, which is offered if the hit was taken."""
    n = views.note_count(spark, sf_dir)
    hits = cut(_hits(spark, sf_dir)).withColumn("body", F.concat("body", F.lit(" [embeds: "), (F.col("doc_id") % n).cast("string"), F.lit("]")))
    links = hits.select(F.col("path").alias("src"), F.concat(F.lit("x/"), (F.col("doc_id") % n).cast("string")).alias("raw"), F.lit("embed").alias("kind"), F.col("path").alias("dst")).distinct()
    moved = small(cut(links)).join(views.notes(spark, sf_dir).select(F.col("path").alias("dst"), "doc_id"), "dst").select("src", "raw", "kind", ((F.col("doc_id") + 1) % n).alias("doc_id"))
    edges = cut(small(cut(moved)).join(views.notes(spark, sf_dir).select("doc_id", F.col("path").alias("dst")), "doc_id").select("src", "raw", "kind", "dst"))
    return answer.pack_sources(answer.offers(hits, views.chunks(spark, sf_dir), edges), 900).select("query_id", "n", "path", "kind", "dropped")


def excerpts(spark, sf_dir):
    return answer.excerpts(views.chunks(spark, sf_dir), AnswerOptions.excerpt_chars)


def disambiguate(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("breadcrumb", F.substring_index("breadcrumb", " > ", 2))
    return answer.disambiguate(hits).select("query_id", "chunk_id", "label")


def prompt_text(spark, sf_dir):
    own = _hits(spark, sf_dir).withColumns({"label": F.lit(""), "kind": F.lit("hit")})
    sources = own.select("query_id", F.col("rank").alias("n"), answer.render(F.col("rank"), F.col("breadcrumb"), F.col("label"), F.col("date"), F.col("kind"), F.col("body")).alias("rendered"))
    return answer.prompts(sources, views.questions(spark, sf_dir)).select("query_id", "user", "prompt_tokens")


def _replies(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.concat("text", F.lit(" ["), (F.col("conv_id") % 9).cast("string"), F.lit("] and ["), (F.col("turn") % 4).cast("string"), F.lit("][1234]"))
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(said).alias("text"))


def check_citations(spark, sf_dir):
    cited, bogus = answer.check_citations(F.col("text"), F.lit(6))
    return _replies(spark, sf_dir).select("conv_id", "turn", F.array_join(cited, ",").alias("cited"), F.array_join(bogus, ",").alias("bogus"))


def _pieces(spark, sf_dir):
    """Conversations as pieces of seven characters, with reasoning put around every third turn."""
    c = views.table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<think>"), "text", F.lit("</think>"))).otherwise(F.col("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))), lambda t: t["said"]), "")
    rows = c.groupBy(F.col("conv_id").cast("string").alias("session")).agg(whole.alias("whole"))
    cut = F.when(F.col("whole") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("whole", F.lit("(?s).{1,7}"), F.lit(0)))
    return rows.select("session", F.posexplode(cut).alias("seq", "piece"))


def think_filter(spark, sf_dir):
    return think.visible_batch(_pieces(spark, sf_dir))


def think_stream(spark, sf_dir):
    """The same by the stateful stream, whose state is stored and taken up half-way."""
    return think.visible_stream(_pieces(spark, sf_dir), f"{checkpoint_dir(spark).rstrip('/')}/think-{uuid.uuid4().hex}")


def answer_warnings(spark, sf_dir):
    """Warnings of each reply as an answer to six sources, of which one in seven lost some."""
    r = _replies(spark, sf_dir)
    cited, bogus = answer.check_citations(F.col("text"), F.lit(6))
    own = r.select("conv_id", "turn", "text", cited.alias("cited"), bogus.alias("bogus"))
    found = answer.warnings(F.col("text"), F.col("cited"), F.col("bogus"), (F.col("conv_id") % 7 == 0).cast("int"))
    return own.select("conv_id", "turn", F.array_join(found, ",").alias("warnings"))


def source_listing(spark, sf_dir):
    """The sources, of six, that each reply cites, and how many it leaves unmentioned."""
    r = _replies(spark, sf_dir)
    cited, _ = answer.check_citations(F.col("text"), F.lit(6))
    answers = r.select(F.struct("conv_id", "turn").alias("query_id"), cited.alias("cited"))
    sources = answers.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
    return answer.listing(answers, sources).select("query_id.conv_id", "query_id.turn", F.col("n").cast("long").alias("n"), "hidden")


def sse_decode(spark, sf_dir):
    pieces = _pieces(spark, sf_dir)
    data = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("piece").alias("content")).alias("delta"))).alias("choices")))
    lines = pieces.select("session", F.col("seq"), F.concat(F.lit("data: "), data).alias("line")).unionByName(pieces.where("seq % 5 = 0").select("session", "seq", F.lit(": keep-alive").alias("line")))
    got = answer.sse_pieces(lines)
    return got.groupBy("session").agg(F.count("*").alias("n"), F.sum(F.length("piece")).alias("n_chars"))


# ---- evaluation


def _ranks(spark, sf_dir):
    s, v = plans.searcher(spark, sf_dir), views.question_vectors(spark, sf_dir)
    q = views.questions(spark, sf_dir)
    lists = cut(s.ranked_lists(q, SearchOptions(), v))  # all modes fuse the same lists
    places = small(cut(retrieval.of_chunks(lists.select("chunk_id").distinct(), s.chunks.select("chunk_id", "path", "ord", "date"))))
    hits = None
    for label, o in MODES.items():
        own = lists if o.use_bm25 and o.use_vector else lists.where(F.col("retriever") == ("bm25" if o.use_bm25 else "vector"))
        found = retrieval.select_capped(retrieval.fuse(own).join(places, "chunk_id"), o.top_k, o.per_note).select(F.lit(label).alias("label"), "query_id", "rank", "path")
        hits = found if hits is None else hits.unionByName(found)
    return evaluate.first_ranks(hits, cut(views.expected(spark, sf_dir)), list(MODES))


def first_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


def recall_and_mrr(spark, sf_dir):
    return evaluate.scores(_ranks(spark, sf_dir))


def verdict(spark, sf_dir):
    return evaluate.verdict(evaluate.scores(_ranks(spark, sf_dir)))


def baseline_delta(spark, sf_dir):
    now = evaluate.long_form(evaluate.scores(_ranks(spark, sf_dir)))
    before = now.withColumn("value", F.when(F.col("metric") == "mrr", F.col("value") - 0.25).otherwise(F.col("value") + 0.00005))
    return evaluate.delta(now, before)


def answer_tally(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rows = d.select(
        F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(i.cast("string"))).alias("expect"), F.when(i % 3 == 0, F.array(i.cast("string"))).otherwise(F.array(F.lit("x"))).alias("cited_paths"),
        (i % 5).alias("n_cited"), (i % 7).alias("n_bogus"),
    )
    return evaluate.answer_tally(rows)


def bad_expected_paths(spark, sf_dir):
    n = views.notes(spark, sf_dir)
    wanted = n.select(F.when(F.col("doc_id") % 6 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.col("doc_id").alias("query_id"))
    return evaluate.bad_paths(wanted, n).select("query_id", "path")


def expected_notes(spark, sf_dir):
    return views.expected(spark, sf_dir)


_ALL = (
    find_date_filename, find_date_rejects, note_date_precedence, dates_report, latest_notes, resolve_links, backlinks, outlinks, link_stats, most_linked, unwritten_concepts, change_detection, pending_vectors, put_vectors,
    cascade_delete, upsert_snapshot, index_stats, chunk_size_stats, conflict_names, skip_report, newline_normalise, content_hash, note_metadata, section_split, fence_lines, chunk_notes, varied_metadata, varied_sections, varied_fences, varied_dates, paragraphs, pack_units,
    estimate_tokens, context_budget, pack_sources, pack_sources_transcluded, excerpts, disambiguate, prompt_text, check_citations, think_filter, think_stream, answer_warnings, source_listing, sse_decode, first_ranks, recall_and_mrr, verdict, baseline_delta,
    answer_tally, bad_expected_paths, expected_notes,
)


def queries():
    return {f.__name__: f for f in _ALL}


_TOKENS_SQL = "(floor((length({0}) - length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g'))) / 3.5 + length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) / 1.6) + 1)::BIGINT"
_RULE_TOKENS = int(len(answer.RULES) / 3.5) + 1
_PARTS_SQL = """p AS (SELECT p_partkey AS k, p_name, replace(p_brand, '#', '') AS brand, p_size AS size, p_type, p_partkey % 25 AS n, p_partkey % 7 AS o, p_size * 3 AS price,
    'parts/kind-' || p_partkey % 25 || '/' || p_partkey || '.md' AS path FROM part),
s AS (SELECT k, path, p_name, 0 AS n, 0 AS level, p_name AS heading, '' AS trail, 8 AS start_line, 'Lead size' || size || ' with the nation and [embeds: Other ' || o || '] .' AS body, brand, size FROM p
  UNION ALL SELECT k, path, p_name, 1, 1, p_type, '', 10, 'Note: Price' || chr(10) || 'is ' || price || chr(10) || chr(10) || '```sql' || chr(10) || '# no heading [[x]]' || chr(10) || '```', brand, size FROM p
  UNION ALL SELECT k, path, p_name, 2, 2, 'Size', p_type, 19, size || ' list made', brand, size FROM p)"""
_EVAL_SQL = (
    plans._HYBRID
    + ","
    + views.SQL["expected"]
    + """,
modes AS (SELECT 'hybrid' AS label, query_id, chunk_id, score FROM fused
  UNION ALL SELECT 'bm25 only', query_id, chunk_id, 1.0 / (60 + rank) FROM bm25_top UNION ALL SELECT 'vector only', query_id, chunk_id, 1.0 / (60 + rank) FROM vector_top),
own AS (SELECT *, row_number() OVER (PARTITION BY label, query_id, path ORDER BY round(score, 9) DESC, ord) AS own FROM modes JOIN chunks USING (chunk_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY round(score, 9) DESC, path, ord) AS rank FROM own WHERE own <= 3) WHERE rank <= 8),
ranks AS (SELECT label, e.query_id, min(rank) AS rank FROM (SELECT DISTINCT query_id FROM expected) e CROSS JOIN (SELECT DISTINCT label FROM top)
  LEFT JOIN (SELECT label, query_id, rank FROM top SEMI JOIN expected USING (query_id, path)) USING (label, query_id) GROUP BY 1, 2),
scores AS (SELECT label, count(*) AS n, round(avg(coalesce(1 / rank, 0)), 4) AS mrr, round(avg((coalesce(rank, 99) <= 1)::INT), 4) AS r_at_1, round(avg((coalesce(rank, 99) <= 3)::INT), 4) AS r_at_3,
  round(avg((coalesce(rank, 99) <= 8)::INT), 4) AS r_at_8 FROM ranks GROUP BY 1)"""
)


def oracle_sql():
    links = views.with_views("notes", "raw_links", "aliases") + "," + graph.RESOLVE_SQL
    chunks = views.with_views("notes", "chunks")
    hit = plans._KEYWORD + ", hit AS (SELECT * FROM bm25_top JOIN chunks USING (chunk_id) WHERE rank <= 8)"
    excerpts_sql = """t AS (SELECT *, sum(length(body)) OVER w AS total, row_number() OVER w AS n FROM chunks WINDOW w AS (PARTITION BY path ORDER BY ord)),
            excerpts AS (SELECT path, substr(string_agg(body, chr(10) || chr(10) ORDER BY ord), 1, 1200) AS excerpt FROM t WHERE n = 1 OR total <= 1200 GROUP BY 1)"""
    varied = "WITH " + generated.expected_sql("part", "p_partkey")
    kinds = "['notes/{}.md', '.obsidian/{}.md', 'a/.git/{}.md', 'a/.x/{}.md', 'a/.{}.md', 'a/{}.png', 'a/{}.sync-conflict-2024.md', 'a/{} (conflicted copy 2).MD', 'a/{} (Ann''s conflicted copy).md', 'a/{}-desk-pc.md', 'a/~${}.md', 'a/{}.MD']"
    think_sql = """w AS (SELECT conv_id::VARCHAR AS session, string_agg(CASE WHEN turn % 3 = 1 THEN '<think>' || text || '</think>' ELSE text END, '' ORDER BY turn) AS whole,
        coalesce(string_agg(CASE WHEN turn % 3 = 1 THEN NULL ELSE text END, '' ORDER BY turn), '') AS shown FROM conversations GROUP BY 1)"""
    return {
        "find_date_filename": "SELECT o_orderkey, o_orderdate::DATE AS found FROM orders",
        "find_date_rejects": "SELECT o_orderkey, NULL::DATE AS found FROM orders",
        "note_date_precedence": """SELECT doc_id, CASE WHEN doc_id % 3 < 2 OR doc_id % 4 = 0 THEN DATE '2020-01-01' + (doc_id % 2000)::INT END AS date,
            CASE WHEN doc_id % 3 = 0 THEN 'filename' WHEN doc_id % 3 = 1 THEN 'frontmatter:date' WHEN doc_id % 4 = 0 THEN 'frontmatter:created' ELSE '' END AS source FROM documents""",
        "dates_report": views.with_views("notes") + " SELECT date_source, count(*) AS n, count(date) AS dated FROM notes GROUP BY 1",
        "latest_notes": views.with_views("notes") + " SELECT path, date, date_source FROM notes WHERE date IS NOT NULL ORDER BY date DESC, path LIMIT 25",
        "resolve_links": links + " SELECT src, dst, raw, kind FROM resolved",
        "backlinks": links + " SELECT DISTINCT dst AS path, src FROM resolved WHERE dst IS NOT NULL",
        "outlinks": links + " SELECT DISTINCT src AS path, dst FROM resolved WHERE dst IS NOT NULL",
        "link_stats": links + " SELECT count(*) AS edges, count(dst) AS resolved, count(*) - count(dst) AS unresolved FROM resolved",
        "most_linked": links + " SELECT dst, count(DISTINCT src) AS n FROM resolved WHERE dst IS NOT NULL GROUP BY 1 ORDER BY n DESC, dst LIMIT 15",
        "unwritten_concepts": links + " SELECT min(raw) AS raw, count(*) AS n FROM resolved WHERE dst IS NULL GROUP BY lower(raw) ORDER BY n DESC, raw LIMIT 20",
        "change_detection": views.with_views("notes") + """ SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 13 = 0 THEN 'deleted' WHEN doc_id % 4 = 0 THEN 'changed' ELSE 'same' END AS status
            FROM notes WHERE doc_id % 10 <> 0 OR doc_id % 13 <> 0""",
        "pending_vectors": chunks + " SELECT DISTINCT sha256(body) AS text_hash FROM chunks WHERE sha256(body) NOT IN (SELECT sha256(body) FROM chunks WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)",
        "put_vectors": "SELECT vec_id::VARCHAR AS text_hash, 'a' AS model, CASE WHEN label % 2 = 0 THEN label + 100 ELSE label END AS label FROM embeddings",
        "cascade_delete": chunks + " SELECT chunk_id, path FROM chunks WHERE doc_id % 9 <> 0",
        "upsert_snapshot": chunks + " SELECT path, chunk_id, CASE WHEN chunk_id % 200000 < 100000 THEN 'new' ELSE sha256(body) END AS text_hash FROM chunks",
        "index_stats": chunks + """ SELECT 'notes' AS name, count(*) AS n FROM notes UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'links', 2 * count(*) FROM notes UNION ALL SELECT 'vectors', count(*) FROM embeddings""",
        "chunk_size_stats": chunks + " SELECT min(length(body)) AS least, floor(median(length(body)))::BIGINT AS median, floor(avg(length(body)))::BIGINT AS mean, max(length(body)) AS most, count(*) AS n FROM chunks",
        "conflict_names": "SELECT c_custkey, c_custkey % 12 IN (6, 7, 8, 9, 10) AS conflict FROM customer",
        "skip_report": f"""SELECT replace({kinds}[c_custkey % 12 + 1], '{{}}', c_name) AS path,
            ['', 'folder', 'folder', 'hidden', 'hidden', 'suffix', 'conflict', 'conflict', 'conflict', 'conflict', 'conflict', ''][c_custkey % 12 + 1] AS skip_reason FROM customer""".replace("[c_custkey % 12 + 1] AS skip_reason", "[c_custkey % 12 + 1] AS r").join(["SELECT path, nullif(r, '') AS skip_reason FROM (", ")"]),
        "newline_normalise": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
        "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
        "note_metadata": "WITH " + _PARTS_SQL + """ SELECT k AS p_partkey, p_name AS title, 'Part ' || k || '|P ' || k AS aliases, brand || '|Made|size' || size AS tags, 'Nation ' || n || '|lists/l' || o || '.md' AS links, 'Other ' || o AS embeds FROM p""",
        "section_split": "WITH " + _PARTS_SQL + " SELECT k AS p_partkey, n::BIGINT AS n, level::BIGINT AS level, heading, trail, start_line::BIGINT AS start_line, body FROM s",
        "fence_lines": "SELECT p_partkey, unnest([14, 15, 16])::BIGINT AS n, 'sql' AS lang FROM part",
        "chunk_notes": "WITH " + _PARTS_SQL + """, c AS (
            SELECT a.k, a.path, a.p_name, a.brand, a.size, a.body || chr(10) || chr(10) || '# ' || b.heading || chr(10) || chr(10) || b.body AS body, 0 AS ord, a.heading, a.start_line, NULL AS trail FROM s a JOIN s b ON a.k = b.k AND a.n = 0 AND b.n = 1
            UNION ALL SELECT k, path, p_name, brand, size, '## Size' || chr(10) || chr(10) || body, 1, heading, start_line, trail FROM s WHERE n = 2),
            d AS (SELECT *, 'parts > kind-' || k % 25 || ' > ' || p_name || CASE WHEN ord = 1 THEN ' > ' || trail || ' > Size' ELSE '' END AS breadcrumb FROM c)
            SELECT path, ord::BIGINT AS ord, breadcrumb, heading, start_line::BIGINT AS start_line, body, translate(path, '/-_', '   ') || '  Part ' || k || ' P ' || k || '  ' || brand || ' Made size' || size AS meta_text,
              sha256(breadcrumb || chr(10) || 'aliases: Part ' || k || ', P ' || k || chr(10) || 'tags: ' || brand || ', Made, size' || size || chr(10) || chr(10) || body) AS text_hash FROM d""",
        "paragraphs": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS para FROM l WHERE regexp_matches(line, '\\S')""",
        "varied_metadata": varied + " SELECT id, path, title, aliases, tags, links, embeds FROM g_meta",
        "varied_sections": varied + " SELECT id, n::BIGINT AS n, level::BIGINT AS level, heading, trail, start_line::BIGINT AS start_line, body FROM g_sections",
        "varied_fences": varied + " SELECT id, n::BIGINT AS n, lang FROM g_fences",
        "varied_dates": varied + " SELECT id, CASE WHEN id % 5 IN (0, 3, 4) THEN date::DATE END AS date, CASE WHEN id % 5 IN (3, 4) THEN 'filename' WHEN id % 5 = 0 THEN 'frontmatter:created' ELSE '' END AS source FROM g",
        # Between two cuts the sizes add up; a cut takes the last paragraph along if it is short.
        "pack_units": """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
            p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS len FROM l WHERE regexp_matches(line, '\\S')),
            walk AS (SELECT doc_id, k, 0 AS unit, len + 2 AS size, len AS chars, len AS final FROM p WHERE k = 1
              UNION ALL SELECT p.doc_id, p.k, w.unit + (w.size + p.len > 1200)::INT, CASE WHEN w.size + p.len <= 1200 THEN w.size + p.len + 2 WHEN w.final > 600 THEN p.len + 2 ELSE w.final + p.len + 4 END,
                CASE WHEN w.size + p.len <= 1200 THEN w.chars + p.len + 2 WHEN w.final > 600 THEN p.len ELSE w.final + p.len + 2 END, p.len
              FROM walk w JOIN p ON p.doc_id = w.doc_id AND p.k = w.k + 1)
            SELECT doc_id, unit::BIGINT AS n, max(chars)::BIGINT AS n_chars FROM walk GROUP BY 1, 2""",
        "estimate_tokens": f"SELECT doc_id, {_TOKENS_SQL.format('text')} AS tokens FROM documents",
        "context_budget": f"SELECT c_custkey, greatest(256, CASE WHEN c_custkey % 5 = 0 THEN 8192 ELSE c_custkey % 5 * 2048 END - 800 - 320 - {_RULE_TOKENS})::BIGINT AS budget FROM customer",
        "pack_sources": hit.replace("WITH", "WITH RECURSIVE", 1)
        + f""", o AS (SELECT query_id, rank, path, body, {_TOKENS_SQL.format("body")} + 8 AS cost FROM hit),
            walk AS (SELECT query_id, rank, path, body, CASE WHEN cost <= 300 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 300 THEN 1 ELSE 0 END AS n, cost <= 300 AS taken, CASE WHEN cost <= 300 THEN 0 ELSE 1 END AS dropped FROM o WHERE rank = 1
              UNION ALL SELECT o.query_id, o.rank, o.path, o.body, CASE WHEN used + cost <= 300 THEN used + cost ELSE used END, CASE WHEN used + cost <= 300 THEN n + 1 ELSE n END, used + cost <= 300, CASE WHEN used + cost <= 300 THEN dropped ELSE dropped + 1 END
              FROM walk w JOIN o ON o.query_id = w.query_id AND o.rank = w.rank + 1)
            SELECT query_id, n::BIGINT AS n, path, length(body) AS n_chars, max(dropped) OVER (PARTITION BY query_id)::BIGINT AS dropped FROM walk QUALIFY taken""",
        "pack_sources_transcluded": hit.replace("WITH", "WITH RECURSIVE", 1)
        + f""", n_docs AS (SELECT greatest(count(*), 1) AS n FROM documents), {excerpts_sql},
            offered AS (SELECT query_id, rank, 0 AS part, path, 'hit' AS kind, body || ' [embeds: ' || doc_id % n || ']' AS body FROM hit, n_docs
              UNION ALL SELECT query_id, rank, 1, excerpts.path, 'transclusion', excerpt FROM hit h CROSS JOIN n_docs JOIN notes t ON t.doc_id = (h.doc_id + 1) % n JOIN excerpts ON excerpts.path = t.path),
            o AS (SELECT query_id, rank, part, path, kind, {_TOKENS_SQL.format("body")} + 8 AS cost, row_number() OVER (PARTITION BY query_id ORDER BY rank, part) AS k FROM offered),
            asked AS (SELECT DISTINCT query_id FROM o),
            walk AS (SELECT query_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS open, []::VARCHAR[] AS paths, 0::BIGINT AS dropped, false AS taken, NULL::VARCHAR AS kind FROM asked
              UNION ALL SELECT query_id, k, CASE WHEN verdict = 'take' THEN used + cost ELSE used END, CASE WHEN verdict = 'take' AND part = 0 THEN rank ELSE open END, CASE WHEN verdict = 'take' THEN list_append(paths, path) ELSE paths END,
                dropped + (verdict = 'drop')::BIGINT, verdict = 'take', kind
              FROM (SELECT o.*, w.used, w.open, w.paths, w.dropped, CASE WHEN part > 0 AND (open <> rank OR list_contains(paths, path)) THEN 'skip' WHEN used + cost <= 900 THEN 'take' ELSE 'drop' END AS verdict
                FROM walk w JOIN o ON o.query_id = w.query_id AND o.k = w.k + 1))
            SELECT query_id, len(paths)::BIGINT AS n, paths[-1] AS path, kind, max(dropped) OVER (PARTITION BY query_id)::BIGINT AS dropped FROM walk QUALIFY taken""",
        "excerpts": chunks + ", " + excerpts_sql + " SELECT path, excerpt FROM excerpts",
        "disambiguate": hit + """ SELECT query_id, chunk_id, CASE WHEN count(*) OVER (PARTITION BY query_id, split_part(breadcrumb, ' > ', 1) || ' > ' || split_part(breadcrumb, ' > ', 2)) > 1 THEN doc_id::VARCHAR ELSE '' END AS label FROM hit""",
        "prompt_text": hit + f""", r AS (SELECT query_id, string_agg('[' || rank || '] ' || breadcrumb || coalesce('  (' || date || ')', '') || chr(10) || regexp_replace(body, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank) AS b FROM hit GROUP BY 1),
            u AS (SELECT q.query_id, 'SOURCES' || chr(10) || '=======' || chr(10) || chr(10) || coalesce(b, '') || chr(10) || chr(10) || 'QUESTION' || chr(10) || '========' || chr(10) || chr(10) || q AS usr FROM questions q LEFT JOIN r USING (query_id))
            SELECT query_id, usr AS "user", {_RULE_TOKENS} + {_TOKENS_SQL.format("usr")} AS prompt_tokens FROM u""",
        "check_citations": """WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN [] ELSE list_sort(list_distinct([(conv_id % 9)::INT, (turn % 4)::INT])) END AS used FROM conversations WHERE role = 'assistant')
            SELECT conv_id, turn, array_to_string([x FOR x IN used IF x BETWEEN 1 AND 6], ',') AS cited, array_to_string([x FOR x IN used IF x NOT BETWEEN 1 AND 6], ',') AS bogus FROM r""",
        "think_filter": "WITH " + think_sql + " SELECT session, shown AS visible FROM w",
        "think_stream": "WITH " + think_sql + " SELECT session, shown AS visible FROM w",
        "answer_warnings": """WITH r AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 3 = 0 THEN [] ELSE list_distinct([(conv_id % 9)::INT, (turn % 4)::INT]) END AS used FROM conversations WHERE role = 'assistant')
            SELECT conv_id, turn, concat_ws(',', CASE WHEN len([x FOR x IN used IF x NOT BETWEEN 1 AND 6]) > 0 THEN 'bogus' END,
              CASE WHEN regexp_matches(text, '\\S') AND len([x FOR x IN used IF x BETWEEN 1 AND 6]) = 0 OR conv_id % 3 > 0 AND len([x FOR x IN used IF x BETWEEN 1 AND 6]) = 0 THEN 'uncited' END,
              CASE WHEN conv_id % 7 = 0 THEN 'dropped' END) AS warnings FROM r""",
        "source_listing": """WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN [] ELSE [x FOR x IN list_distinct([(conv_id % 9)::INT, (turn % 4)::INT]) IF x BETWEEN 1 AND 6] END AS used FROM conversations WHERE role = 'assistant')
            SELECT conv_id, turn, unnest(used)::BIGINT AS n, 6 - len(used) AS hidden FROM r""",
        "sse_decode": "WITH " + think_sql + " SELECT session, ceil(length(whole) / 7.0)::BIGINT AS n, length(whole) AS n_chars FROM w WHERE whole <> ''",
        "first_ranks": _EVAL_SQL + " SELECT label, query_id, rank FROM ranks",
        "recall_and_mrr": _EVAL_SQL + " SELECT label, n, mrr, r_at_1, r_at_3, r_at_8 FROM scores",
        "verdict": _EVAL_SQL + """, v AS (SELECT max(r_at_1) FILTER (WHERE label = 'hybrid') AS hybrid, max(r_at_1) FILTER (WHERE label <> 'hybrid') AS best_single FROM scores)
            SELECT *, CASE WHEN round(hybrid - best_single, 4) > 0.01 THEN 'better' WHEN round(hybrid - best_single, 4) < -0.01 THEN 'worse' ELSE 'equal' END AS verdict FROM v""",
        "baseline_delta": _EVAL_SQL + " SELECT label, 'mrr' AS metric, 0.25::DOUBLE AS change FROM scores",
        "answer_tally": """SELECT count(*) AS asked, count(*) FILTER (WHERE i % 5 > 0) AS cited_something, count(*) FILTER (WHERE i % 7 > 0) AS bogus, count(*) FILTER (WHERE i % 4 > 0 AND i % 3 = 0) AS expected_cited,
            count(*) FILTER (WHERE i % 4 > 0) AS answerable, count(*) FILTER (WHERE i % 4 > 0 AND i % 3 > 0 AND i % 5 = 0) AS declined_wrongly, count(*) FILTER (WHERE i % 4 = 0 AND i % 5 = 0) AS refused_correctly,
            count(*) FILTER (WHERE i % 4 = 0) AS unanswerable FROM (SELECT doc_id AS i FROM documents)""",
        "bad_expected_paths": views.with_views("notes") + " SELECT doc_id AS query_id, path || 'x' AS path FROM notes WHERE doc_id % 6 = 0",
        "expected_notes": views.with_views("notes", "expected") + " SELECT query_id, path FROM expected",
    }
