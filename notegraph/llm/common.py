"""Helpers shared by the operators: table reading and cutting of lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local session, as in tests, gets a folder of its own; a cluster
    without the setting is an error, as its executors share no local disk.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"spark-checkpoints-{os.getpid()}")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without lineage,
    so that a lost executor costs a read, not a recomputation, and so that a
    result that is used twice is made once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed(doc_id: Column, content: Column) -> Column:
    """A key of a row, never null: equal for repeated rows, null identifiers being one value."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), content)


def one_row_each(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each ``key`` that is in ``kept`` (key)."""
    rows = docs.withColumn("_row_key", key).dropDuplicates(["_row_key"])
    return rows.join(kept.select(F.col("key").alias("_row_key")), "_row_key", "left_semi").drop("_row_key")


#: Rows of a table that may be copied to every task.
SMALL_ROWS = 100_000
#: Rows of a narrow table that one task reads.
PART_ROWS = 20_000


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if a count shows that it has at most SMALL_ROWS rows;
    beyond that joins are left to Spark, which splits hot keys."""
    return F.broadcast(df) if fewer(df).limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def fewer(df: DataFrame, rows: int = 0) -> DataFrame:
    """``df``, a cut table of ``rows`` narrow rows, in no more parts than there are cores or
    than the rows need: each part of what is shuffled next costs files, however small."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
