"""Sections of parsed notes to chunks, as walks over arrays that give places, and slices between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from .markdown import fence_mask, gather, let, lines, strip

_STRINGS = "array<string>"


def _none(kind: str = _STRINGS) -> Column:
    return F.array().cast(kind)


#: Places of a group in its array: from (from 0) and number of items.
_GROUP = "struct<first:int,n:int>"


def _group(first: Column, after: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), (after - first).cast("int").alias("n"))


def _joined(items: Column, groups: Column, by: str) -> Column:
    return F.transform(groups, lambda g: F.array_join(F.slice(items, g["first"] + 1, g["n"]), by))


def paragraphs(text: Column) -> Column:
    """Split at blank lines outside fences; trimmed, empty ones dropped."""

    def use(masked: Column) -> Column:
        blanks = F.filter(F.transform(masked, lambda r, i: F.when(~r["inside"] & (strip(r["line"]) == ""), i)), lambda i: i.isNotNull())
        groups = lambda cuts: F.transform(F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda c, k: _group(F.get(cuts, k) + 1, c))
        cuts = F.concat(F.array(F.lit(-1)), blanks, F.array(F.size(masked)))
        rows = F.transform(masked, lambda r: r["line"])
        return let(rows, lambda items: _joined(items, let(cuts, groups), "\n"))

    return F.filter(F.transform(let(fence_mask(lines(text)), use), strip), lambda p: p != "")


def hard_split(para: Column, limit: int) -> Column:
    """Whole lines packed up to ``limit`` characters; a longer line stays whole."""

    def step(state: Column, line: Column, i: Column) -> tuple[Column, Column]:
        over = (state["size"] + F.length(line) > limit) & (i > state["first"])
        after = F.struct(F.when(over, i).otherwise(state["first"]).alias("first"), (F.when(over, 0).otherwise(state["size"]) + F.length(line) + 1).alias("size"))
        return after, F.when(over, F.array(_group(state["first"], i))).otherwise(_none(f"array<{_GROUP}>"))

    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("size"))
    return let(lines(para), lambda rows: _joined(rows, gather(rows, start, step, _GROUP, lambda state, n: F.array(_group(state["first"], n))), "\n"))


def pack_paragraphs(paras: Column, config: EngineConfig) -> Column:
    """Paragraphs packed to the target size; the last ones are repeated across a cut if
    they are short."""
    keep = config.overlap_paras

    def use(items: Column) -> Column:
        def total(first: Column, after: Column, extra: int) -> Column:
            return F.aggregate(F.slice(items, first + 1, after - first), F.lit(0), lambda a, p: a + F.length(p) + extra)

        def step(state: Column, para: Column, i: Column) -> tuple[Column, Column]:
            over = (i > state["first"]) & (state["size"] + F.length(para) > config.target_chars)
            tail = F.greatest(state["first"], i - keep)
            carry = F.when(total(tail, i, 0) > config.target_chars // 2, i).otherwise(tail)
            fresh = let(carry, lambda c: F.struct(c.alias("first"), (total(c, i, 2) + F.length(para) + 2).alias("size")))
            after = F.when(over, fresh).otherwise(F.struct(state["first"].alias("first"), (state["size"] + F.length(para) + 2).alias("size")))
            return after, F.when(over, F.array(_group(state["first"], i))).otherwise(_none(f"array<{_GROUP}>"))

        def last(state: Column, n: Column) -> Column:
            return F.when(n > state["first"], F.array(_group(state["first"], n))).otherwise(_none(f"array<{_GROUP}>"))

        return _joined(items, gather(items, F.struct(F.lit(0).alias("first"), F.lit(0).alias("size")), step, _GROUP, last), "\n\n")

    return let(paras, use)


def section_units(section: Column, config: EngineConfig) -> Column:
    """array<struct<trail, heading, level, start_line, text>>: a section as it is, with its
    heading, or packed paragraphs where it is too long; none for an empty one."""
    def unit(text: Column) -> Column:
        return F.struct(section["trail"].alias("trail"), section["heading"].alias("heading"), section["level"].alias("level"), section["start_line"].alias("start_line"), text.alias("text"))

    def use(body: Column, prefix: Column) -> Column:
        paras = F.flatten(F.transform(paragraphs(body), lambda p: F.when(F.length(p) > config.max_chars, hard_split(p, config.max_chars)).otherwise(F.array(p))))
        texts = F.when(body == "", _none()).when(F.length(prefix) + F.length(body) <= config.max_chars, F.array(body)).otherwise(pack_paragraphs(paras, config))
        return F.transform(texts, lambda t: unit(F.concat(prefix, t)))

    prefix = F.when(section["level"] > 0, F.concat(F.repeat(F.lit("#"), section["level"]), F.lit(" "), section["heading"], F.lit("\n\n"))).otherwise("")
    return let(strip(section["body"]), lambda body: let(prefix, lambda p: use(body, p)))


def merge_small(units: Column, config: EngineConfig) -> Column:
    """Neighbouring units as groups: a group takes more until it is large enough, would be
    too large, or the next unit is no sibling or descendant of its first."""

    def use(own: Column) -> Column:
        def step(state: Column, u: Column, i: Column) -> tuple[Column, Column]:
            def cuts(head: Column) -> Column:
                below = F.concat(head["trail"], F.array(head["heading"]))
                related = (u["trail"] == head["trail"]) | (F.slice(u["trail"], F.lit(1), F.size(below)) == below)
                return (state["size"] >= config.min_chars) | (state["size"] + F.length(u["text"]) > config.max_chars) | ~related

            cut = (i > state["first"]) & let(F.get(own, state["first"]), cuts)
            after = F.struct(F.when(cut, i).otherwise(state["first"]).alias("first"), (F.when(cut, 0).otherwise(state["size"]) + F.length(u["text"]) + 2).alias("size"))
            return after, F.when(cut, F.array(_group(state["first"], i))).otherwise(_none(f"array<{_GROUP}>"))

        def last(state: Column, n: Column) -> Column:
            return F.when(n > state["first"], F.array(_group(state["first"], n))).otherwise(_none(f"array<{_GROUP}>"))

        groups = gather(own, F.struct(F.lit(0).alias("first"), F.lit(0).alias("size")), step, _GROUP, last)
        return F.transform(groups, lambda g: F.slice(own, g["first"] + 1, g["n"]))

    return let(units, use)


def breadcrumb(path: Column, title: Column, trail: Column, level: Column, heading: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Folders, title, headings above and heading, each once, joined by `` > ``."""
    parts = F.concat(F.array(title), trail, F.when(level > 0, F.array(heading)).otherwise(_none()))
    if config.folder_in_breadcrumb:
        folders = F.split(path, "/")
        parts = F.concat(F.slice(folders, F.lit(1), F.size(folders) - 1), parts)
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " > ")


def meta_text(path: Column, aliases: Column, tags: Column) -> Column:
    """What is matched but not shown: path words, aliases and tags."""
    return F.concat_ws("  ", F.translate(path, "/-_", "   "), F.when(F.size(aliases) > 0, F.array_join(aliases, " ")), F.when(F.size(tags) > 0, F.array_join(tags, " ")))


def chunk_notes(parsed: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, ord, breadcrumb, heading, start_line, body, embed_text, meta_text, text_hash)
    of the result of ``parse_notes``; no row leaves its partition."""
    units = F.flatten(F.transform("sections", lambda s: section_units(s, config)))
    # Folds use their input more than once, so units are a column of their own first.
    parsed = parsed.withColumn("_units", units)
    rows = parsed.select("path", "title", "aliases", "tags", F.posexplode(merge_small(F.col("_units"), config)).alias("ord", "group"))
    head = F.col("group")[0]
    crumb = breadcrumb(F.col("path"), F.col("title"), head["trail"], head["level"], head["heading"], config)
    rows = rows.select(
        "path", "ord", crumb.alias("breadcrumb"), head["heading"].alias("heading"), head["start_line"].alias("start_line"),
        strip(F.array_join(F.transform("group", lambda u: u["text"]), "\n\n")).alias("body"), "aliases", "tags",
    )
    header = F.col("breadcrumb")
    if config.meta_in_embedding:
        header = F.concat_ws("\n", header, F.when(F.size("aliases") > 0, F.concat(F.lit("aliases: "), F.array_join("aliases", ", "))), F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", ", "))))
    rows = rows.withColumn("embed_text", F.concat(header, F.lit("\n\n"), F.col("body")))
    return rows.select("path", "ord", "breadcrumb", "heading", "start_line", "body", "embed_text", meta_text(F.col("path"), F.col("aliases"), F.col("tags")).alias("meta_text"), F.sha2("embed_text", 256).alias("text_hash"))
