"""Sharding of documents by longest-processing-time scheduling.

Equal texts stay together, so the units of work are groups of equal texts.  The law
is ``bytes``: units go, largest first, to the least-loaded shard through a heap.

The number of groups grows with the data, so only the large ones are scheduled one by
one: groups of at least 1/HEAVY of a shard's fair share, of which there are at most
``shards * HEAVY``.  The others are gathered by hash into ``shards * HEAVY`` buckets,
each again far smaller than a shard, and a bucket is scheduled as one unit.  The heap
so sees at most ``2 * shards * HEAVY`` units whatever the input is.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS, HEAVY = 16, 1024
#: Cells a shard's rows are numbered in; a row number never spans more than a cell.
CELLS = 1024


def least_loaded(units: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Longest-processing-time rule: ``{unit: shard}`` for (unit, size) pairs."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for unit, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[unit] = shard
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size is the UTF-8 bytes of the text plus 1; a null text has none and stays with
    empty ones (its crc32 is that of no bytes, 0).  Slots of a shard are 0, 1, ... without gaps; repeated rows
    get slots of their own.  An empty table gives an empty table; other columns are
    ignored.  grown_shard is null under the ``bytes`` law.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")))
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, total // (shards * HEAVY))
    buckets = shards * HEAVY
    # A bucket takes the numbers from 0 on, a large group its hash below 0.
    unit = F.when(F.col("size") >= least, F.bitwise_not(F.shiftrightunsigned("text_hash", 1))).otherwise(F.pmod("text_hash", F.lit(buckets)))
    units = groups.select("text_hash", unit.alias("unit"), "size")
    sizes = units.groupBy("unit").agg(F.sum("size").alias("size")).collect()  # at most 2 * shards * HEAVY rows
    plan = least_loaded([(r["unit"], r["size"]) for r in sizes], shards)
    placed = spark.createDataFrame(list(plan.items()), "unit long, shard int")
    heavy = F.broadcast(placed.where("unit < 0").toDF("h", "heavy_shard"))
    light = F.broadcast(placed.where("unit >= 0").toDF("b", "light_shard"))
    dealt = (
        rows.withColumn("h", F.bitwise_not(F.shiftrightunsigned("text_hash", 1)))
        .withColumn("b", F.pmod("text_hash", F.lit(buckets)))
        .join(heavy, "h", "left")
        .join(light, "b", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("heavy_shard", "light_shard").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell"))
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return dealt.join(base, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(own) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
