"""Incremental maintenance: what changed, what must go, what is still to be embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bm25 import KeywordIndex, cell, doc_lengths, postings
from .lineage import cut
from .snapshots import Tables, bucket_of


def changes(found: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status): new, changed, same or deleted, by content hash."""
    a = found.select("path", F.col("content_hash").alias("found_hash"), F.lit(True).alias("is_found"))
    b = known.select("path", F.col("content_hash").alias("known_hash"), F.lit(True).alias("is_known"))
    both = a.join(b, "path", "full_outer")
    status = F.when(F.col("is_known").isNull(), "new").when(F.col("is_found").isNull(), "deleted").when(F.col("found_hash").eqNullSafe(F.col("known_hash")), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def without_notes(table: DataFrame, gone: DataFrame) -> DataFrame:
    """``table`` without the rows of the notes in ``gone`` (path)."""
    return table.join(gone.select("path").distinct(), "path", "left_anti")


def upsert(table: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """All rows of a key in ``fresh`` replace those of the same key in ``table``."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def pending_vectors(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The distinct (text_hash, embed_text) that ``model`` has no vector for."""
    have = vectors.where(F.col("model") == model).select("text_hash")
    return chunks.select("text_hash", "embed_text").distinct().join(have, "text_hash", "left_anti")


def put_vectors(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """Last write wins for each (text_hash, model)."""
    both = vectors.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("text_hash", "model").orderBy(F.desc("_new")))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def vacuum_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors that some chunk still needs."""
    return vectors.join(chunks.select("text_hash").distinct(), "text_hash", "left_semi")


def index_stats(notes: DataFrame, chunks: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, n) of the four tables."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in (("notes", notes), ("chunks", chunks), ("links", links), ("vectors", vectors))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunk_size_stats(chunks: DataFrame) -> DataFrame:
    """One row: least, exact median, mean, most and number of body lengths."""
    size = F.length("body")
    return chunks.agg(F.min(size).cast("long").alias("least"), F.percentile(size, 0.5).cast("long").alias("median"), F.avg(size).cast("long").alias("mean"), F.max(size).cast("long").alias("most"), F.count("*").alias("n"))


def dates_report(notes: DataFrame) -> DataFrame:
    """(date_source, n, dated): where dates come from."""
    return notes.groupBy("date_source").agg(F.count("*").alias("n"), F.count("date").alias("dated"))


def latest_notes(notes: DataFrame, limit: int = 25) -> DataFrame:
    """The ``limit`` dated notes with the latest dates, then by path."""
    return notes.where("date IS NOT NULL").select("path", "date", "date_source").orderBy(F.desc("date"), "path").limit(limit)


class Index(Tables):
    """The tables of a note collection: notes, chunks, postings and lengths of the chunks by
    path, links by their source, vectors by the hash of their text."""

    KEYS = {"notes": "path", "chunks": "path", "postings": "path", "lengths": "path", "links": "src", "vectors": "text_hash"}
    COLUMNS = {
        "notes": "path content_hash title aliases tags links embeds date date_source mtime size indexed_at", "chunks": "path ord breadcrumb heading start_line body embed_text meta_text text_hash",
        "postings": "path cell term chunk_id tf_breadcrumb tf_body tf_meta n_tokens", "lengths": "path chunk_id n_tokens", "links": "src dst raw kind", "vectors": "text_hash model vec",
    }
    #: What every build writes; a snapshot without one of them is made anew.
    WHOLE = ("notes", "chunks", "postings", "lengths", "links")
    #: Postings lie in cells of terms, in the order of terms, so a search opens few of them.
    WITHIN = {"postings": "cell"}
    SORTED = {"notes": ("path",), "chunks": ("path", "ord"), "postings": ("term", "chunk_id"), "links": ("src",)}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, cells: int = 16):
        super().__init__(spark, path, buckets)
        self.cells = cells

    def vectors(self) -> DataFrame:
        """(text_hash, model, dim, vec), of all models."""
        own = self.manifest()
        return self.table("vectors") if own and "vectors" in own["schemas"] else self.spark.createDataFrame([], VECTORS)

    def stats(self) -> DataFrame:
        """(name, n) of the tables there are."""
        return index_stats(self.table("notes"), self.table("chunks"), self.table("links"), self.vectors())

    def links_report(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Edge counts, the most linked notes and the links without a note."""
        from . import graph

        edges = self.table("links")
        return graph.link_stats(edges), graph.most_linked(edges), graph.unwritten(edges)

    def dates_report(self) -> DataFrame:
        return dates_report(self.table("notes"))

    def show(self, path: str) -> DataFrame:
        """The chunks of one note in order."""
        bucket = self.spark.range(1).select(bucket_of(F.lit(path), self.buckets)).first()[0]
        return self.table("chunks", {bucket}).where(F.col("path") == path).orderBy("ord")

    def searchable(self) -> DataFrame:
        """Chunks as ``retrieval.Searcher`` takes them: numbered, with their note's date."""
        dated = self.table("notes").select("path", "date")
        return self.table("chunks").join(dated, "path").select(chunk_id(), "path", "ord", "start_line", "date", "breadcrumb", F.col("meta_text").alias("meta"), "body", "text_hash", "embed_text")

    def keywords(self) -> KeywordIndex:
        """The stored postings, for ``retrieval.Searcher`` and ``bm25_topk``."""
        return KeywordIndex(self.searchable(), self.table("postings").drop("path"), self.table("lengths").drop("path"), self.cells)

    def pending(self, model: str) -> DataFrame:
        """The texts (text_hash, embed_text) that ``model`` has no vector for."""
        return pending_vectors(self.table("chunks"), self.vectors(), model)

    def embed(self, model: str, provider, batch: int = 16, commit_texts: int = 100_000, retries: int = 2) -> int:
        """Embed what is pending for ``model`` and return how many texts that were.

        Texts go to ``provider`` in batches; about ``commit_texts`` at a time are committed,
        so a run that dies repeats no committed part.  Vectors of other models stay, under
        their own key, until ``drop_vectors``."""
        from .vectors import embed_texts

        todo = cut(self.pending(model))
        total = todo.count()
        parts = -(-total // commit_texts)
        for part in range(parts):
            own = todo.where(F.pmod(F.xxhash64("text_hash"), F.lit(parts)) == part)
            made, schema = self.write_buckets("vectors", embed_texts(own, model, provider, batch, retries))
            last = self.manifest()
            self.commit(last["files"] | {"vectors": last["files"].get("vectors", []) + made}, last["schemas"] | {"vectors": schema}, last["config"], model)
        return total

    def drop_vectors(self, model: str | None = None) -> None:
        """Drop the vectors that no chunk needs, and with ``model`` those of all others."""
        own = vacuum_vectors(self.vectors(), self.table("chunks"))
        own = own if model is None else own.where(F.col("model") == model)
        last = self.manifest()
        self.replace({"vectors": set(range(self.buckets))}, {"vectors": own}, last["config"], model or last["model"])

    def chunk_vectors(self, model: str) -> DataFrame:
        """(chunk_id, vec) for ``retrieval.Searcher``."""
        own = self.vectors().where(F.col("model") == model).select("text_hash", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
        return self.table("chunks").select(chunk_id(), "text_hash").join(own, "text_hash").select("chunk_id", "vec")


VECTORS = "text_hash string, model string, dim int, vec array<float>"


def chunk_id() -> Column:
    return F.xxhash64("path", "ord").alias("chunk_id")


def _made(found: DataFrame, config, cells: int) -> dict[str, DataFrame]:
    """notes, chunks, postings and lengths of the notes in ``found``; each note is parsed once."""
    from ..functions.chunking import chunk_notes
    from ..functions.dates import note_date
    from ..functions.markdown import parse_notes

    extra = [F.col(c).cast(t).alias(c) if c in found.columns else F.lit(None).cast(t).alias(c) for c, t in (("mtime", "timestamp"), ("size", "long"))]
    parsed = cut(parse_notes(found, config))
    front = F.transform_values("frontmatter", lambda k, v: v["vals"])
    dated = parsed.withColumn("_date", note_date(F.col("path"), front, config))
    notes = dated.select("path", "content_hash", "title", "aliases", "tags", "links", "embeds", F.col("_date.date").alias("date"), F.col("_date.source").alias("date_source"))
    notes = notes.join(found.select("path", *extra), "path").withColumn("indexed_at", F.current_timestamp())
    chunks = cut(chunk_notes(parsed, config))
    named = chunks.select("path", chunk_id(), "breadcrumb", "body", F.col("meta_text").alias("meta"))
    lengths = doc_lengths(named).join(named.select("path", "chunk_id"), "chunk_id").select("path", "chunk_id", "n_tokens")
    terms = postings(named).join(named.select("path", "chunk_id"), "chunk_id")
    return {"notes": notes, "chunks": chunks, "postings": terms.withColumn("cell", cell(F.col("term"), cells)), "lengths": lengths}


def resolved_links(notes: DataFrame) -> DataFrame:
    """(src, dst, raw, kind) of all links and embeds of ``notes``."""
    from .graph import resolve_links

    raw = notes.select(F.col("path").alias("src"), F.explode("links").alias("raw"), F.lit("link").alias("kind")).unionByName(notes.select(F.col("path").alias("src"), F.explode("embeds").alias("raw"), F.lit("embed").alias("kind")))
    return resolve_links(raw, notes)


def build(index: Index, found: DataFrame, config=None, full: bool = False, dry_run: bool = False, root: str | None = None) -> DataFrame:
    """Bring the index up to the notes in ``found`` (path, text, content_hash[, mtime, size])
    and return the changes.  A changed configuration, like ``full``, makes every note anew;
    ``full`` also does so where the index is of another schema, otherwise an error.
    Nothing is written with ``dry_run``, or where nothing changed; otherwise the buckets of
    changed notes alone, and those of links that now mean another note.  Vectors belong to
    texts and stay; ``Index.embed`` makes those that are missing.  With ``root``, the folder
    of the notes, an index inside it is an error."""
    from ..config import EngineConfig
    from ..sources.vault import assert_outside

    if root is not None:
        assert_outside(index.path, root)
    config = config or EngineConfig()
    key = repr(config)
    own = index.manifest(check=not full)
    if full and own and index.outdated(own):
        own = None  # a full build takes nothing over from such an index
    old = own is not None and not full and own["config"] == key
    known = index.table("notes") if old else found.where(F.lit(False))
    status = changes(found, known)
    if dry_run:
        return status
    status = cut(status)
    moved = status.where("status <> 'same'")
    if old and moved.isEmpty():
        return status
    old = old and all(t in own["schemas"] for t in index.WHOLE)
    fresh = found.join(status.where(F.col("status").isin("new", "changed")).select("path"), "path", "left_semi") if old else found
    made = _made(fresh, config, index.cells)
    if not old:
        made["notes"] = cut(made["notes"])
        tables = made | {"links": resolved_links(made["notes"])}
        if own and "vectors" in own["schemas"]:
            tables["vectors"] = index.vectors()
        index.write(tables, key, own["model"] if own else "")
        return status
    gone = status.where(F.col("status").isin("deleted", "changed"))
    buckets = {r[0] for r in moved.select(bucket_of(F.col("path"), index.buckets)).distinct().collect()}  # at most ``buckets`` numbers
    rows = {name: without_notes(index.table(name, buckets), gone).unionByName(df) for name, df in made.items()}
    rows["notes"] = cut(rows["notes"])
    elsewhere = index.table("notes", set(range(index.buckets)) - buckets)
    # A new name may be what an old link means, so links are resolved anew and compared.
    before, links = index.table("links"), cut(resolved_links(elsewhere.unionByName(rows["notes"])))
    sides = [(links, before), (before, links)]
    differ = [a.exceptAll(b.select(*a.columns)).select(bucket_of(F.col("src"), index.buckets).alias("b")) for a, b in sides]
    touched = {r[0] for r in differ[0].unionByName(differ[1]).distinct().collect()}
    rows["links"] = links.where(bucket_of(F.col("src"), index.buckets).isin(touched))
    index.replace({"links": touched} | dict.fromkeys(made, buckets), rows, key, own["model"])
    return status
