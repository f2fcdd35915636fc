"""Answers: sources within a token budget, prompts, citations, hidden reasoning."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AnswerOptions
from ..functions.dates import stem
from ..functions.text import estimate_tokens, squeeze
from .lineage import cut, small

RULES = (
    "Answer from the numbered sources alone. After each statement, give the number of its source in square brackets, like [2]. "
    "If the sources hold no answer, say so in one sentence. Where they disagree, say so and give both. Keep the notes' own names, "
    "answer in the language of the question, and be brief."
)
# Tokens of a source's header, and the mark of an embedded note.
HEADER_TOKENS = 8
EMBED_MARK = r"\[embeds: ([^\]]+)\]"


def context_budget(n_ctx: Column, options: AnswerOptions = AnswerOptions()) -> Column:
    """Tokens left for sources; 0 or null stands for the default context."""
    size = F.when(F.coalesce(n_ctx, F.lit(0)) == 0, options.n_ctx).otherwise(n_ctx)
    return F.greatest(F.lit(256), size - options.max_tokens - estimate_tokens(F.lit(RULES)) - options.reserve_tokens).cast("long")


def excerpts(chunks: DataFrame, limit: int = AnswerOptions.excerpt_chars) -> DataFrame:
    """(path, excerpt): the opening chunks of each note up to ``limit`` characters; the
    first is always there, and the whole is cut at the limit."""
    until = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.select("path", "ord", "body", F.sum(F.length("body")).over(until).alias("total"), F.row_number().over(Window.partitionBy("path").orderBy("ord")).alias("n"))
    kept = rows.where((F.col("n") == 1) | (F.col("total") <= limit))
    joined = kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), "\n\n").alias("text"))
    return joined.select("path", F.substring("text", 1, limit).alias("excerpt"))


def transclusions(hits: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, rank, target): notes that a hit's body transcludes, by the link graph."""
    named = hits.select("query_id", "rank", F.col("path").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(EMBED_MARK), F.lit(1)), lambda n: F.lower(F.trim(n))))).alias("name"))
    edges = links.where("kind = 'embed' AND dst IS NOT NULL").select("src", F.lower(F.trim(F.substring_index("raw", "/", -1))).alias("name"), F.col("dst").alias("target"))
    return named.join(edges, ["src", "name"]).select("query_id", "rank", "target").distinct()


def pack_sources(offers: DataFrame, budget: int) -> DataFrame:
    """(query_id, n, path, kind, body, dropped): sources in order, skipping what no longer fits.

    ``offers`` has (query_id, rank, part, path, kind, body): part 0 is a hit, further parts
    are notes it transcludes.  Those are offered only if the hit was taken, and not
    if the note is a source already.  A fold: whether one fits depends on all before.
    """
    lists = offers.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part", "path", "kind", "body", (estimate_tokens(F.col("body")) + HEADER_TOKENS).alias("cost")))).alias("offers"))
    taken = "array<struct<path:string,kind:string,body:string>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("dropped"), F.lit(-1).cast("long").alias("open"), F.array().cast(taken).alias("out"))

    def step(acc: Column, o: Column) -> Column:
        extra = o["part"] > 0
        skipped = extra & ((acc["open"] != o["rank"]) | F.exists(acc["out"], lambda s: s["path"] == o["path"]))
        fits = acc["used"] + o["cost"] <= budget
        source = F.struct(o["path"].alias("path"), o["kind"].alias("kind"), o["body"].alias("body"))
        added = F.struct((acc["used"] + o["cost"]).alias("used"), acc["dropped"].alias("dropped"), F.when(extra, acc["open"]).otherwise(o["rank"].cast("long")).alias("open"), F.concat(acc["out"], F.array(source)).alias("out"))
        refused = F.struct(acc["used"].alias("used"), (acc["dropped"] + 1).alias("dropped"), acc["open"].alias("open"), acc["out"].alias("out"))
        return F.when(skipped, acc).when(fits, added).otherwise(refused)

    packed = lists.select("query_id", F.aggregate("offers", start, step).alias("p"))
    return packed.select("query_id", F.col("p.dropped").alias("dropped"), F.posexplode("p.out").alias("place", "s")).select("query_id", (F.col("place") + 1).cast("long").alias("n"), "s.path", "s.kind", "s.body", "dropped")


def offers(hits: DataFrame, chunks: DataFrame, links: DataFrame | None, options: AnswerOptions = AnswerOptions()) -> DataFrame:
    """Hits with the excerpts of what they transclude, as ``pack_sources`` takes them.
    A hit's context, where the search attached some, follows its body in the same source."""
    body = F.array_join(F.concat(F.array("body"), F.transform("context", lambda c: c["body"])), "\n\n") if "context" in hits.columns else F.col("body")
    own = hits.select("query_id", "rank", F.lit(0).alias("part"), "path", F.lit("hit").alias("kind"), body.alias("body"))
    if links is None or not options.expand_transclusions:
        return own
    named = cut(transclusions(hits, links))
    wanted = chunks.join(small(named.select(F.col("target").alias("path")).distinct()), "path", "left_semi")
    more = named.join(excerpts(wanted, options.excerpt_chars).withColumnRenamed("path", "target"), "target")
    part = F.row_number().over(Window.partitionBy("query_id", "rank").orderBy("target"))
    return own.unionByName(more.select("query_id", "rank", part.alias("part"), F.col("target").alias("path"), F.lit("transclusion").alias("kind"), F.col("excerpt").alias("body")))


def disambiguate(sources: DataFrame) -> DataFrame:
    """``sources`` (query_id, path, breadcrumb) with label: the file's name where a
    question has the same breadcrumb more than once, else empty."""
    n = F.count("*").over(Window.partitionBy("query_id", "breadcrumb"))
    return sources.withColumn("label", F.when(n > 1, stem(F.col("path"))).otherwise(""))


# The frame of a source and of a prompt, whose marks citations and tests rely on.
def render(n: Column, breadcrumb: Column, label: Column, date: Column, kind: Column, body: Column) -> Column:
    """What a model sees of a source; never the path."""
    return F.concat(
        F.lit("["), n.cast("string"), F.lit("] "), breadcrumb, F.when(label != "", F.concat(F.lit(" -- "), label)).otherwise(""),
        F.coalesce(F.concat(F.lit("  ("), date.cast("string"), F.lit(")")), F.lit("")), F.when(kind == "transclusion", "  (transcluded into the note above)").otherwise(""),
        F.lit("\n"), F.regexp_replace(body, r"(?U)^\s+|\s+$", ""),
    )


def prompts(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, system, user, prompt_tokens) from rendered ``sources`` (query_id, n, rendered)."""
    blocks = sources.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "rendered"))), lambda x: x["rendered"]), "\n\n").alias("blocks"))
    user = F.concat(F.lit("SOURCES\n=======\n\n"), F.coalesce("blocks", F.lit("")), F.lit("\n\nQUESTION\n========\n\n"), F.trim("q"))
    rows = questions.join(blocks, "query_id", "left").select("query_id", F.lit(RULES).alias("system"), user.alias("user"))
    return rows.withColumn("prompt_tokens", estimate_tokens(F.col("system")) + estimate_tokens(F.col("user")))


def check_citations(text: Column, count: Column) -> tuple[Column, Column]:
    """Sorted distinct source numbers an answer cites: those that exist, and the others."""
    used = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))))
    real = lambda n: (n >= 1) & (n <= count)
    return F.filter(used, real), F.filter(used, lambda n: ~real(n))


def visible(text: Column) -> Column:
    """A finished text without <think> parts; an unclosed one hides the rest."""
    return F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|\z)", "")


def sse_pieces(lines: DataFrame) -> DataFrame:
    """(session, seq, piece) of server-sent lines (session, seq, line), up to [DONE].

    Lines that are no data, or no JSON, are skipped.
    """
    data = lines.where(F.startswith("line", F.lit("data:"))).select("session", "seq", F.trim(F.substr("line", F.lit(6))).alias("data"))
    done = F.max(F.when(F.col("data") == "[DONE]", 1).otherwise(0)).over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    piece = F.get_json_object("data", "$.choices[0].delta.content")
    return data.withColumn("done", done).where("done = 0").select("session", "seq", piece.alias("piece")).where("piece IS NOT NULL AND piece <> ''")


def answer(prompts: DataFrame, sources: DataFrame, chat: Callable[[str, str], str] | None) -> DataFrame:
    """(query_id, text, n_sources, dropped, cited, bogus, warnings), a row for each prompt.

    ``sources`` has query_id and n[, dropped].  ``chat(system, user)`` is asked where there
    are sources, or nowhere if it is None, which shows what would be asked; the text is
    empty then.  What comes back is cleaned and its citations are checked."""
    dropped = F.max("dropped") if "dropped" in sources.columns else F.lit(0)
    counts = sources.groupBy("query_id").agg(F.count("*").alias("n_sources"), dropped.cast("long").alias("dropped"))
    rows = prompts.join(counts, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_sources", "dropped")})
    text = F.lit("")
    if chat is not None:

        @F.pandas_udf("string")
        def ask(system: pd.Series, user: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([chat(s, u) if k else "" for s, u, k in zip(system, user, n)], dtype=object)

        text = visible(ask("system", "user", "n_sources"))
    asked = rows.select("query_id", "n_sources", "dropped", text.alias("text"))
    cited, bogus = check_citations(F.col("text"), F.col("n_sources"))
    checked = asked.select("query_id", "text", "n_sources", "dropped", cited.alias("cited"), bogus.alias("bogus"))
    return checked.withColumn("warnings", warnings(F.col("text"), F.col("cited"), F.col("bogus"), F.col("dropped")))


def warnings(text: Column, cited: Column, bogus: Column, dropped: Column) -> Column:
    """What a reader must know of an answer: ``bogus`` if it cites what it was not given,
    ``uncited`` if it says something and cites no source, ``dropped`` if some didn't fit."""
    found = F.array(F.when(F.size(bogus) > 0, "bogus"), F.when((squeeze(text) != "") & (F.size(cited) == 0), "uncited"), F.when(dropped > 0, "dropped"))
    return F.filter(found, lambda w: w.isNotNull())


def listing(answers: DataFrame, sources: DataFrame, show_all: bool = False) -> DataFrame:
    """(query_id, n, is_cited, hidden, ...) of the ``sources`` (query_id, n, ...) that an answer
    cites, or of all; hidden is the number of the question's sources that are left out."""
    marked = sources.join(answers.select("query_id", "cited"), "query_id").withColumn("is_cited", F.array_contains("cited", F.col("n").cast("int")))
    out = marked.withColumn("hidden", F.count_if(~F.col("is_cited") & F.lit(not show_all)).over(Window.partitionBy("query_id")))
    return out.where(F.col("is_cited") | F.lit(show_all)).drop("cited")
