"""Streams: hiding reasoning in token streams, and picking up new notes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"
#: Sessions are dealt over so many groups with state, as a group costs milliseconds however small.
BUCKETS = 1024


def _begun(tag: str) -> re.Pattern:
    """Matches the end of a buffer that may go on to be ``tag``: its first letter, and each
    further one only behind those before it."""
    rest = ""
    for letter in reversed(tag[1:-1]):
        rest = f"(?:{re.escape(letter)}{rest})?"
    return re.compile(re.escape(tag[0]) + rest + r"\Z")


_BEGUN = {tag: _begun(tag) for tag in (OPEN, CLOSE)}


def visible_part(rest: str, inside: bool) -> tuple[str, str, bool]:
    """What of a buffer can be shown now, what must wait, and whether reasoning is open."""
    shown = ""
    while True:
        tag = CLOSE if inside else OPEN
        before, found, after = rest.partition(tag)
        if not found:
            waiting = _BEGUN[tag].search(rest)
            at = waiting.start() if waiting else len(rest)
            return shown + ("" if inside else rest[:at]), rest[at:], inside
        shown += "" if inside else before
        rest, inside = after, not inside


def _filter(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """``key`` is a bucket; its state lists (session, buffer, inside) of those that wait."""
    known = {session: (buffer, inside) for session, buffer, inside in json.loads(state.get[0])} if state.exists else {}
    rows = pd.concat(list(batches)).sort_values("seq")
    shown = []
    for session, piece, last in zip(rows["session"], rows["piece"], rows["is_last"]):
        buffer, inside = known.pop(session, ("", False))
        buffer += piece or ""
        if "<" in buffer:
            text, buffer, inside = visible_part(buffer, inside)
        else:
            text, buffer = "" if inside else buffer, ""
        if last:
            text, buffer = text + ("" if inside else buffer), ""
        if buffer or inside:
            known[session] = buffer, inside
        shown.append(text)
    if known:
        state.update((json.dumps([(session, *left) for session, left in known.items()]),))
    elif state.exists:
        state.remove()
    yield pd.DataFrame({"session": rows["session"], "seq": rows["seq"], "visible": shown})


def think_filter(pieces: DataFrame) -> DataFrame:
    """(session, seq, visible) of a stream (session, seq, piece, is_last).

    A tag may be cut anywhere.  is_last marks a session's end, where held-back text is
    shown; an unclosed tag hides the rest.  Sessions with nothing held back take no state.
    """
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(_filter, "session string, seq long, visible string", "waiting string", "append", GroupStateTimeout.NoTimeout)


def ingest(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Hand new files under ``root`` to ``handle`` in batches, once each.

    The file source never reports deletions; compare listings for those (``maintain.changes``).
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visible_batch(pieces: DataFrame) -> DataFrame:
    """(session, visible): the same for finished sessions, in one expression."""
    from ..operators.answer import visible

    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("piece", F.lit("")).alias("piece")))), lambda p: p["piece"]), "")
    return pieces.groupBy("session").agg(visible(whole).alias("visible"))


def visible_stream(pieces: DataFrame, folder: str, rounds: int = 2) -> DataFrame:
    """``visible_batch`` by the stream: ``pieces`` (session, seq, piece) arrive in ``rounds``, a
    share of each session in each, and the state of every session is taken up again from
    the checkpoint when the next round starts.  ``folder`` must be shared and new.

    The state lies in as many parts as the session has cores, if shuffles have more."""
    spark = pieces.sparkSession
    own = Window.partitionBy("session")
    rows = pieces.withColumns({"n": F.count("*").over(own), "place": F.row_number().over(own.orderBy("seq"))})
    rows = rows.select("session", F.col("seq").cast("long").alias("seq"), "piece", (F.col("place") == F.col("n")).alias("is_last"), F.floor((F.col("place") - 1) * rounds / F.col("n")).cast("int").alias("round"))
    rows.write.partitionBy("round").parquet(f"{folder}/rounds")
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    schema = "session string, seq long, piece string, is_last boolean"
    for k in range(rounds):
        session.read.schema(schema).parquet(f"{folder}/rounds/round={k}").write.mode("append").parquet(f"{folder}/in")
        shown = think_filter(session.readStream.schema(schema).parquet(f"{folder}/in"))
        query = shown.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.schema("session string, seq long, visible string").parquet(f"{folder}/out")
    return out.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "visible"))), lambda p: p["visible"]), "").alias("visible"))
