"""The link graph: resolution of link texts to notes, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, small

#: Links of one text that meet one copy of what it means.
LINKS_A_COPY = 100_000


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md$", "")


def _last(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def note_names(notes: DataFrame) -> DataFrame:
    """(name, path): every name a note can be linked by, in lower case: its path without
    the suffix, the last part of that, and its aliases."""
    names = F.concat(F.array(_bare(F.col("path")), _last(_bare(F.col("path")))), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = notes.select("path", F.explode(names).alias("name"))
    return rows.select(F.lower(strip(F.col("name"))).alias("name"), "path").where("name <> ''").distinct()


def resolve_links(links: DataFrame, notes: DataFrame, per_copy: int = LINKS_A_COPY) -> DataFrame:
    """(src, dst, raw, kind): ``links`` (src, raw, kind) with the note each one means.

    The whole text is looked up first, then its last part; the first that names any note
    counts.  A note never links itself.  Of several notes the one with the fewest
    folders wins, then the first by name.  dst is null where nothing is meant.
    """
    names = note_names(notes)
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    # A name needs its two best notes at most: the best one may be the link's own note.
    # The rank cuts a name that many notes share before anything is shuffled.
    order = F.row_number().over(Window.partitionBy("name").orderBy("depth", "path"))
    two = names.withColumn("depth", depth).withColumn("_n", order).where(F.col("_n") <= 2)
    best = two.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("depth", "path"))).alias("found"))
    edges = links.distinct()
    key = F.lower(_bare(strip(F.col("raw"))))
    full = best.select(F.col("name").alias("full_key"), F.col("found").alias("full"))
    last = best.select(F.col("name").alias("last_key"), F.col("found").alias("last"))
    keyed = cut(edges.withColumn("full_key", key).withColumn("last_key", _last(F.col("full_key"))))
    # Each text is looked up once, however many links have it, then meets its links again.
    # A text with many links is copied, and they are dealt over its copies.
    asked = cut(keyed.groupBy("full_key", "last_key").agg(F.ceil(F.count("*") / per_copy).cast("int").alias("copies")))
    known = asked.join(full, "full_key", "left").join(last, "last_key", "left").select("full_key", F.coalesce("full", "last").alias("found"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    popular = small(asked.where("copies > 1").select("full_key", "copies"))
    dealt = keyed.join(popular, "full_key", "left").withColumn("copy", F.pmod(F.xxhash64("src", "raw", "kind"), F.coalesce("copies", F.lit(1))).cast("int"))
    others = F.filter(F.col("found"), lambda n: n["path"] != F.col("src"))
    return dealt.join(known, ["full_key", "copy"], "left").select("src", F.get(others, F.lit(0))["path"].alias("dst"), "raw", "kind")


def backlinks(edges: DataFrame) -> DataFrame:
    """(path, src): the distinct notes that link to each note."""
    return edges.where("dst IS NOT NULL").select(F.col("dst").alias("path"), "src").distinct()


def outlinks(edges: DataFrame) -> DataFrame:
    """(path, dst): the distinct notes each note links to."""
    return edges.where("dst IS NOT NULL").select(F.col("src").alias("path"), "dst").distinct()


def link_stats(edges: DataFrame) -> DataFrame:
    """One row: edges, resolved and unresolved ones."""
    return edges.agg(F.count("*").alias("edges"), F.count("dst").alias("resolved"), (F.count("*") - F.count("dst")).alias("unresolved"))


def most_linked(edges: DataFrame, limit: int = 15) -> DataFrame:
    """The notes that most others link to."""
    return edges.where("dst IS NOT NULL").groupBy("dst").agg(F.countDistinct("src").alias("n")).orderBy(F.desc("n"), "dst").limit(limit)


def unwritten(edges: DataFrame, limit: int = 20) -> DataFrame:
    """The link texts without a note, however they are capitalised, by frequency."""
    return edges.where("dst IS NULL").groupBy(F.lower("raw").alias("key")).agg(F.count("*").alias("n"), F.min("raw").alias("raw")).select("raw", "n").orderBy(F.desc("n"), "raw").limit(limit)


RESOLVE_SQL = """names AS (
  SELECT DISTINCT lower(trim(name)) AS name, path, length(path) - length(replace(path, '/', '')) AS depth FROM (
    SELECT path, regexp_replace(path, '\\.md$', '', 'i') AS name FROM aliases
    UNION ALL SELECT path, split_part(regexp_replace(path, '\\.md$', '', 'i'), '/', -1) FROM aliases
    UNION ALL SELECT path, unnest(aliases) FROM aliases)),
keyed AS (SELECT DISTINCT src, raw, kind, lower(regexp_replace(trim(raw), '\\.md$', '', 'i')) AS key FROM raw_links),
chosen AS (SELECT *, CASE WHEN key IN (SELECT name FROM names) THEN key ELSE split_part(key, '/', -1) END AS name FROM keyed),
resolved AS (
  SELECT src, raw, kind, (SELECT arg_min(path, (depth, path)) FROM names n WHERE n.name = c.name AND n.path <> c.src) AS dst FROM chosen c)"""
