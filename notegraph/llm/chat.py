"""Chat formatting of reply trees, in DataFrame operations alone.

A tree's nodes know their parents.  Iterative self-joins enumerate the path from every
leaf to its root; a join doubles the distance covered, so a conversation of n turns
takes log2(n) rounds.  Branches of a tree are ranked by the sum of their nodes' scores,
and each chosen path is formatted as one conversation with a loss mask.

The template writes a turn as ``<|im_start|>role``, a line break, the text and
``<|im_end|>`` with a line break.  In roles and texts ``&``, ``<`` and ``[`` are
replaced by references, so no control string can stand there, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>\n"
#: What stands for a character, `&` first.
REFERENCES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
ROLE_REFERENCES = [*REFERENCES, ("\n", "&#10;")]
LEARNED_ROLE = "assistant"


def escape(text: Column, references: list[tuple[str, str]] = REFERENCES) -> Column:
    for char, reference in references:
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def unescape(text: Column, references: list[tuple[str, str]] = REFERENCES) -> Column:
    for char, reference in reversed(references):
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, height) for each node on the way from a leaf (height 0) to its root.

    ``nodes`` has node (unique) and parent (null for a root).  A parent that is no node
    ends a path like a null.  A node whose parents never end, as they form a cycle or lead
    into one, counts as having no parent.
    """
    known = nodes.select(F.col("node").alias("parent"))
    up = cut(nodes.select("node", "parent").join(known, "parent").select("node", "parent"))
    inner = up.select(F.col("parent").alias("node")).distinct()
    paths = nodes.join(inner, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    span, left = 1, up.count()
    while left:
        further = paths.join(up, "node").select("leaf", F.col("parent").alias("node"), (F.col("height") + span).alias("height"))
        paths = cut(paths.union(further))
        above = up.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        up = cut(up.join(above, "parent").select("node", F.col("above").alias("parent")))
        span *= 2
        # Nodes that still have an ancestor twice as far get fewer each time, but for cycles.
        before, left = left, up.count()
        if left == before:
            endless = up.select("node", F.lit(True).alias("_endless"))
            return leaf_paths(nodes.join(endless, "node", "left").select("node", F.when(F.col("_endless").isNull(), F.col("parent")).alias("parent")))
    return paths


def best_branches(nodes: DataFrame, paths: DataFrame, most: int = 1) -> DataFrame:
    """(leaf, node, height, tree) of the ``most`` best paths of each tree: highest sum
    of scores (null: 0), then the smallest leaf."""
    own = paths.join(nodes.select("node", "tree", "score"), "node")
    sums = own.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    chosen = sums.withColumn("rank", rank).where(F.col("rank") <= most).select("leaf")
    return own.select("leaf", "node", "height", "tree").join(chosen, "leaf", "left_semi")


def format_paths(nodes: DataFrame, branches: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_spans): a row for each chosen path.

    loss_spans has (start, length) in code points of ``formatted``, from 0, of the text
    of each assistant turn.  Null roles and texts count as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = branches.join(nodes.select("node", role.alias("role"), text.alias("text")), "node").select(
        "tree", "leaf", "height", (F.col("role") == LEARNED_ROLE).alias("learned"),
        F.concat(F.lit(START), escape(F.col("role"), ROLE_REFERENCES), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    before = Window.partitionBy("leaf").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("start", start)
    parts = F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("place"), "head", "body", "learned", "start")))
    out = placed.groupBy("leaf").agg(F.first("tree").alias("tree"), parts.alias("parts"))
    return out.select(
        "tree",
        "leaf",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["learned"]), lambda p: F.struct(p["start"].alias("start"), F.length(p["body"]).alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(head) + 2)
        return F.struct(unescape(F.substr(head, F.lit(len(START) + 1)), ROLE_REFERENCES).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each turn replies to the one before it.

    Equal turns of a conversation, and repeated rows, follow each other (by role, then
    text), so that no row is lost.  Rows with a null conv_id are one conversation.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("place", place)

    def name(at: Column) -> Column:
        return F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), at.cast("string"))

    return rows.select(
        F.col("conv_id").alias("tree"), name(F.col("place")).alias("node"), F.when(F.col("place") > 1, name(F.col("place") - 1)).alias("parent"), F.lit(1.0).alias("score"), "role", "text"
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_spans), one row for each conversation."""
    nodes = cut(conversation_nodes(conversations))
    return format_paths(nodes, best_branches(nodes, leaf_paths(nodes)))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = formatted.select("tree", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss"))
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"

ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, count(*) AS n_turns,
             sum(length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;'))
                 + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 24)::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM l
"""
