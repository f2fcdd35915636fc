"""Exact de-duplication by content sort, in DataFrame operations alone.

Rows are range-partitioned by the normalised text: the range key is its first 64
characters, then a hash of the whole, so that the splitters Spark samples stay short
however long the texts are.  Sorting inside a range (external, it spills) puts equal texts
next to each other, and neighbours are compared in full; a run of equal neighbours is a
group.  Hashes place rows and never decide: texts of one hash are told apart.

A text that a third of all rows share must not end in one task.  Keys whose rows hold more
than a range's fair share of the bytes, of which there are fewer than ranges, are found
by a count before.  Their rows get a salt as the last part of the range key, so they spread
over as many ranges as they need, and the first rows of their runs, one for each text and
salt, are sorted and compared in full once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

PREFIX_CHARS = 64
KEY = ("_prefix", "_hash", "_salt")


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_hash(norm: Column) -> Column:
    return F.xxhash64(norm)


def _ranged(rows: DataFrame) -> DataFrame:
    """``rows`` (with doc_id and text) by ranges of KEY, with _norm.  The salt is null but
    for hot keys."""
    spark = rows.sparkSession
    norm = normalised(F.col("text"))
    rows = rows.withColumns({"_prefix": F.substring(norm, 1, PREFIX_CHARS), "_hash": text_hash(norm)})
    sizes = cut(rows.groupBy("_hash").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("_bytes")))
    share = max(1, (sizes.agg(F.sum("_bytes")).first()[0] or 0) // shuffle_partitions(spark))
    hot = sizes.where(F.col("_bytes") > share).select("_hash", F.ceil(F.col("_bytes") / share).alias("_salts"))  # fewer rows than ranges
    rows = rows.join(F.broadcast(hot), "_hash", "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("_salts"))).drop("_salts")
    return rows.repartitionByRange(shuffle_partitions(spark), *KEY).withColumn("_norm", norm)


def _first_of(*keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_first()))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    ``keep_id`` is the smallest doc_id of the rows with an equal normalised text;
    nulls and empty texts are one group.  A repeated row (same doc_id and text)
    counts in group_size, and only one of the repeats is kept.  A null doc_id sorts
    before all others and can be kept.  An empty table gives an empty table; other
    columns are ignored.
    """
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("_norm", F.col("doc_id").asc_nulls_first()))
    run = Window.partitionBy(*KEY, "_norm")
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))
    rows = _ranged(docs.select("doc_id", "text")).withColumn("_at", at)
    rows = rows.withColumns({"_run": F.min("_at").over(run), "_n": F.count("*").over(run), "_least": least.over(run)})
    is_head = F.col("_at") == F.col("_run")
    rows = cut(rows.select("doc_id", *KEY, "_run", is_head.alias("_head"), "_least", "_n", F.sha2("_norm", 256).alias("text_sha256"), F.when(F.col("_salt").isNotNull() & is_head, F.col("_norm")).alias("_norm")))
    # Hot texts alone: one row for each text and salt, merged by the text itself.
    text = Window.partitionBy("_norm")
    heads = rows.where("_norm IS NOT NULL").select(*KEY, "_run", F.min("_least").over(text).alias("_all_least"), F.sum("_n").over(text).alias("_all_n"))
    merged = rows.drop("_norm").where("_salt IS NOT NULL").join(heads, [*KEY, "_run"])
    alone = rows.drop("_norm").where("_salt IS NULL").withColumns({"_all_least": F.col("_least"), "_all_n": F.col("_n")})
    keep = F.col("_all_least.doc_id")
    return merged.unionByName(alone).select(
        "doc_id", keep.alias("keep_id"), F.col("_all_n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & F.col("_head")).alias("kept"), "text_sha256",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: exactly one of each group of equal texts.

    It has the group's smallest doc_id, or a null one if the group has any; of several
    rows with that doc_id any one stays.  Other texts of the same doc_id, and of other
    null doc_ids, are groups of their own.  An empty table gives an empty table.  Each row
    is moved once, with all its columns.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = _ranged(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_others")))
    heads = rows.withColumn("_place", _first_of(*KEY, "_norm")).where("_place = 1")
    hot = heads.where("_salt IS NOT NULL").withColumn("_place", _first_of("_norm")).where("_place = 1")
    kept = heads.where("_salt IS NULL").unionByName(hot)
    return kept.select(*[F.col("_others").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
