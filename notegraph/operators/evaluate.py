"""Retrieval and answer quality, and what changed against an earlier run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEAD_BAND, LEAST_CHANGE = 0.01, 0.0001


def bad_paths(expected: DataFrame, notes: DataFrame) -> DataFrame:
    """Expected paths that no note has."""
    return expected.join(notes.select("path"), "path", "left_anti")


def first_ranks(hits: DataFrame, expected: DataFrame, labels: list[str]) -> DataFrame:
    """(label, query_id, rank): the first hit from an expected note for each answerable
    question and label; null for a miss.  ``hits`` has (label, query_id, rank, path)."""
    cases = expected.select("query_id").distinct()
    found = hits.join(expected, ["query_id", "path"]).groupBy("label", "query_id").agg(F.min("rank").alias("rank"))
    every = cases.withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    return every.join(found, ["label", "query_id"], "left")


def scores(ranks: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """(label, n, mrr, r_at_k...): misses count as 0."""
    hit = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"r_at_{k}") for k in sorted(set(cutoffs))]
    return ranks.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"), *hit)


def verdict(table: DataFrame, cutoff: int = 1) -> DataFrame:
    """One row: does fusion beat the better single retriever at the smallest cutoff?  None
    where fewer than three retrievers were compared."""
    value = F.col(f"r_at_{cutoff}")
    own = table.agg(F.max(F.when(F.col("label") == "hybrid", value)).alias("hybrid"), F.max(F.when(F.col("label") != "hybrid", value)).alias("best_single"), F.count_distinct("label").alias("labels")).where("labels >= 3")
    delta = F.round(F.col("hybrid") - F.col("best_single"), 4)
    return own.select("hybrid", "best_single", F.when(delta > DEAD_BAND, "better").when(delta < -DEAD_BAND, "worse").otherwise("equal").alias("verdict"))


def long_form(table: DataFrame) -> DataFrame:
    """(label, metric, value) of a table of scores."""
    metrics = [c for c in table.columns if c not in ("label", "n")]
    return table.unpivot("label", metrics, "metric", "value")


def save(table: DataFrame, path: str) -> None:
    """Keep a table of scores as JSON lines, for a later ``delta``."""
    table.coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(label, metric, value) of kept scores."""
    return long_form(spark.read.json(path))


def delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(label, metric, change) where both runs have a figure and it changed."""
    both = current.join(baseline.withColumnRenamed("value", "old"), ["label", "metric"])
    return both.select("label", "metric", F.round(F.col("value") - F.col("old"), 4).alias("change")).where(F.abs("change") > LEAST_CHANGE)


def answer_tally(answers: DataFrame) -> DataFrame:
    """One row of eight counts from (expect array, cited_paths array, n_cited, n_bogus)."""
    answerable = F.size("expect") > 0
    right = F.arrays_overlap("expect", "cited_paths")
    return answers.agg(
        F.count("*").alias("asked"),
        F.count_if(F.col("n_cited") > 0).alias("cited_something"),
        F.count_if(F.col("n_bogus") > 0).alias("bogus"),
        F.count_if(answerable & right).alias("expected_cited"),
        F.count_if(answerable).alias("answerable"),
        F.count_if(answerable & ~right & (F.col("n_cited") == 0)).alias("declined_wrongly"),
        F.count_if(~answerable & (F.col("n_cited") == 0)).alias("refused_correctly"),
        F.count_if(~answerable).alias("unanswerable"),
    )
