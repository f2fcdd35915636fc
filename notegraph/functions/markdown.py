"""Markdown notes to structure, as column expressions over arrays of lines.

Nothing here shuffles: a note is one row, and its lines are an array in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig

# The patterns of the markdown forms; (?U) makes word characters and white
# space those of Unicode.
FENCE = r"(?U)^ {0,3}(`{3,}|~{3,})\s*(\S*)"
#: A fenced block from its first to its last line; an unclosed one runs to the end.
BLOCK = r"(?dmU)^ {0,3}(?:(`{3,}+)[^\n]*+(?:(?s:.*?)\n {0,3}\1`*+[^\S\n]*+$|(?s:.*)\z)|(~{3,}+)[^\n]*+(?:(?s:.*?)\n {0,3}\2~*+[^\S\n]*+$|(?s:.*)\z))"
HEADING = r"(?U)^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
KEY_VALUE = r"(?U)^(\w[\w .-]*?)\s*:\s*(.*)$"
LIST_ITEM = r"(?U)^\s*-\s+(.*)$"
WIKILINK = r"(!?)\[\[([^\[\]|#]*?)(#[^\[\]|]*?)?(?:\|([^\[\]]*?))?\]\]"
MARKDOWN_LINK = r"(?U)(!?)\[([^\[\]]*?)\]\(([^()\s]+)(?:\s+\"[^\"]*\")?\)"
QUOTE = r"(?U)^\s{0,3}>+\s?"
CALLOUT = r"(?U)^\s*\[!(\w+)\]([+-])?\s*(.*)$"
TAG = r"(?mU)(?:(?<=^)|(?<=\s))#([A-Za-z][\w/-]*)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Items that ``gather`` appends to before it starts a new run.
RUN = 256


def gather(rows: Column, state: Column, step: Callable[[Column, Column, Column], tuple[Column, Column]], kind: str, last: Callable[[Column, Column], Column] | None = None) -> Column:
    """The items that a walk over ``rows`` gives, an array of ``kind``.

    ``step(state, row, i)`` is the next state and an array of the items of row i; ``last(state,
    n)`` an array of those after the end.  Items are held in runs of RUN, so that adding one
    copies a run and not all that came before.
    """
    none, runs = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    start = F.struct(state.alias("state"), F.lit(0).alias("i"), none.alias("now"), runs.alias("done"))

    def one(acc: Column, row: Column) -> Column:
        after, items = step(acc["state"], row, acc["i"])
        full = F.size(acc["now"]) >= RUN
        now = F.concat(F.when(full, none).otherwise(acc["now"]), items)
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(after.alias("state"), (acc["i"] + 1).alias("i"), now.alias("now"), done.alias("done"))

    def end(acc: Column) -> Column:
        rest = F.concat(acc["now"], last(acc["state"], acc["i"])) if last else acc["now"]
        return F.flatten(F.concat(acc["done"], F.array(rest)))

    return F.aggregate(rows, start, one, end)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def normalised_text(content: Column) -> Column:
    """Bytes to text: invalid UTF-8 replaced, byte-order marks dropped, line ends to LF."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿+", ""), "\r\n?", "\n")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def frontmatter_end(rows: Column) -> Column:
    """Index (from 0) of the line that closes the frontmatter, -1 without one."""
    flags = F.transform(rows, lambda x: strip(x).isin("---", "..."))
    close = F.array_position(F.slice(flags, 2, F.greatest(F.size(flags), F.lit(1))), True)
    return F.when((strip(rows[0]) == "---") & (close > 0), close.cast("int")).otherwise(F.lit(-1))


def unquote(text: Column) -> Column:
    bare = strip(text)
    same = (F.length(bare) >= 2) & (F.substring(bare, 1, 1) == F.substring(bare, -1, 1)) & F.substring(bare, 1, 1).isin('"', "'")
    return F.when(same, F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def parse_frontmatter(rows: Column) -> Column:
    """map<string, struct<is_list, vals>> of flat ``key: value``, ``key: [a, b]`` and block lists.

    Of repeated keys the last counts; items after a single value are ignored.
    """
    kept = F.filter(rows, lambda x: (strip(x) != "") & ~strip(x).startswith("#"))
    empty = F.struct(F.lit(None).cast("string").alias("key"), F.create_map().cast("map<string,struct<is_list:boolean,vals:array<string>>>").alias("map"))
    none = F.array().cast("array<string>")

    def put(acc: Column, key: Column, value: Column) -> Column:
        others = F.map_filter(acc["map"], lambda k, v: k != key)
        return F.struct(key.alias("key"), F.map_concat(others, F.map_from_arrays(F.array(key), F.array(value))).alias("map"))

    def entry(is_list: bool, vals: Column) -> Column:
        return F.struct(F.lit(is_list).alias("is_list"), vals.alias("vals"))

    def step(acc: Column, line: Column) -> Column:
        is_item = line.rlike(LIST_ITEM) & acc["key"].isNotNull()
        item = unquote(F.regexp_extract(line, LIST_ITEM, 1))
        key, value = strip(F.regexp_extract(line, KEY_VALUE, 1)), strip(F.regexp_extract(line, KEY_VALUE, 2))
        current = F.try_element_at(acc["map"], acc["key"])
        grown = F.when(current["is_list"], put(acc, acc["key"], entry(True, F.concat(current["vals"], F.array(item))))).otherwise(acc)
        inner = F.regexp_extract(value, r"(?s)^\[(.*)\]$", 1)
        listed = F.transform(F.filter(F.split(inner, ","), lambda v: strip(v) != ""), unquote)
        made = F.when(value == "", entry(True, none)).when(value.rlike(r"(?s)^\[.*\]$"), entry(True, listed)).otherwise(entry(False, F.array(unquote(value))))
        return F.when(is_item, grown).when(line.rlike(KEY_VALUE), put(acc, key, made)).otherwise(acc)

    return F.aggregate(kept, empty, step, lambda acc: acc["map"])


def as_list(entry: Column) -> Column:
    """A frontmatter value as bare words: lists trimmed, single values split at commas and
    white space, leading # dropped."""
    bare = F.when(entry["is_list"], F.transform(entry["vals"], strip)).otherwise(F.split(strip(entry["vals"][0]), r"(?U)[,\s]+"))
    words = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.regexp_replace(x, "^#+", ""))
    return F.coalesce(words, F.array().cast("array<string>"))


def dedupe(items: Column) -> Column:
    """Distinct whatever the case; the first spelling and the order stay."""
    return let(F.transform(items, lambda x: F.lower(x)), lambda low: F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))


def _blocks(text: Column) -> Column:
    """struct<parts, blocks>: the fenced blocks of a text and what stands before each and
    after the last."""
    return F.struct(F.split(text, BLOCK, -1).alias("parts"), F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)).alias("blocks"))


def _lang(block: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(block, "\n", 1), FENCE, 2))


def fence_mask(rows: Column) -> Column:
    """array<struct<line, inside, lang>>: which lines stand in a fenced block, fences
    included.  A fence is closed by one of the same character, as long or longer, that
    names no language; an unclosed one runs to the end."""
    none = F.array().cast("array<struct<line:string,inside:boolean,lang:string>>")

    def marked(text: Column, inside: bool, lang: Column) -> Column:
        return F.transform(lines(text), lambda x: F.struct(x.alias("line"), F.lit(inside).alias("inside"), lang.alias("lang")))

    def outside(part: Column, i: Column, n: Column) -> Column:
        # A part holds the line ends towards the blocks beside it; a single one between two, or nothing at an end, is no line.
        ends = F.when(i > 0, 1).otherwise(0) + F.when(i < n, 1).otherwise(0)
        bare = F.substr(part, F.when(i > 0, 2).otherwise(1), F.length(part) - ends)
        return F.when(F.length(part) < ends, none).otherwise(marked(bare, False, F.lit("")))

    def use(found: Column) -> Column:
        n = F.size(found["blocks"])
        around = F.transform(found["parts"], lambda part, i: outside(part, i, n))
        blocks = F.transform(found["blocks"], lambda b: let(_lang(b), lambda lang: marked(b, True, lang)))
        return F.flatten(F.zip_with(around, F.concat(blocks, F.array(none)), lambda a, b: F.concat(a, b)))

    return F.when(F.size(rows) == 0, none).otherwise(let(_blocks(F.array_join(rows, "\n")), use))


def headings(masked: Column) -> Column:
    """array<struct<i, level, heading>> of the lines outside fences that are headings."""

    def read(row: Column, i: Column) -> Column:
        own = F.struct(i.alias("i"), F.length(F.regexp_extract(row["line"], HEADING, 1)).alias("level"), strip(F.regexp_extract(row["line"], HEADING, 2)).alias("heading"))
        return F.when(~row["inside"] & F.startswith(F.ltrim(row["line"]), F.lit("#")) & row["line"].rlike(HEADING), own)

    return F.filter(F.transform(masked, read), lambda h: h.isNotNull())


def sections(masked: Column, heads: Column, first_line: Column, title: Column) -> Column:
    """array<struct<level, heading, trail, start_line, lines>> of a note's body: the part
    before the first heading (level 0), then one for each of its ``headings``."""
    none = F.array().cast("array<string>")
    above = "array<struct<level:int,heading:string>>"

    def step(stack: Column, head: Column, _: Column) -> tuple[Column, Column]:
        # A heading closes those of its level and deeper: what is left is strictly rising.
        left = F.filter(stack, lambda s: s["level"] < head["level"])
        return F.concat(left, F.array(F.struct(head["level"].alias("level"), head["heading"].alias("heading")))), F.array(F.transform(left, lambda s: s["heading"]))

    def use(trails: Column, rows: Column) -> Column:
        def section(level, heading, trail, line, first, after) -> Column:
            return F.struct(level.cast("int").alias("level"), heading.alias("heading"), trail.alias("trail"), line.cast("int").alias("start_line"), F.slice(rows, first + 1, after - first).alias("lines"))

        def until(k: Column) -> Column:
            return F.coalesce(F.get(heads, k)["i"], F.size(rows))

        lead = section(F.lit(0), title, none, first_line, F.lit(0), until(F.lit(0)))
        rest = F.transform(heads, lambda h, k: section(h["level"], h["heading"], F.get(trails, k), first_line + h["i"], h["i"] + 1, until(k + 1)))
        return F.concat(F.array(lead), rest)

    trails = gather(heads, F.array().cast(above), step, "array<string>")
    return let(trails, lambda t: let(F.transform(masked, lambda r: r["line"]), lambda rows: use(t, rows)))


def first_h1(heads: Column) -> Column:
    """The first heading of level 1, empty without one."""
    return F.coalesce(_first(F.filter(heads, lambda h: h["level"] == 1))["heading"], F.lit(""))


def strip_callouts(text: Column) -> Column:
    """Quote marks dropped; the head of a callout becomes ``Kind: title``.  Only the first
    quote line since the last blank line can be a head."""

    def step(quoted: Column, line: Column, _: Column) -> tuple[Column, Column]:
        quote = line.rlike(QUOTE)

        def bare(body: Column) -> Column:
            kind, title = F.regexp_extract(body, CALLOUT, 1), F.regexp_extract(body, CALLOUT, 3)
            spoken = strip(F.regexp_replace(strip(F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substr(kind, F.lit(2))), F.lit(": "), title)), ":+$", ""))
            return F.when(~quoted & body.rlike(CALLOUT), spoken).otherwise(body)

        new = F.when(quote, let(F.regexp_replace(line, QUOTE, ""), bare)).otherwise(line)
        return F.when(quote, True).when(strip(line) == "", False).otherwise(quoted), F.array(new)

    walked = F.array_join(gather(lines(text), F.lit(False), step, "string"), "\n")
    return F.when(F.contains(text, F.lit(">")), walked).otherwise(text)


def _is_attachment(name: Column, config: EngineConfig) -> Column:
    return F.lower(F.regexp_extract(name, r"(?s)(?<=[^.])(\.[^.]+)$", 1)).isin(*config.attachment_suffixes)


def _name(target: Column) -> Column:
    return F.substring_index(F.regexp_replace(target, "/+$", ""), "/", -1)


def link_matches(text: Column) -> Column:
    """array<struct<bang, target, heading, alias, whole>> of the wikilinks of a text."""
    groups = {n: F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(g)).alias(n) for n, g in (("bang", 1), ("target", 2), ("heading", 3), ("alias", 4), ("whole", 0))}
    zipped = F.arrays_zip(*groups.values())
    return F.transform(zipped, lambda m: F.struct(m["bang"].alias("bang"), strip(m["target"]).alias("target"), strip(F.regexp_replace(m["heading"], "^#+", "")).alias("heading"), m["alias"].alias("alias"), m["whole"].alias("whole")))


def wikilinks(text: Column, config: EngineConfig = EngineConfig()) -> Column:
    """struct<text, links, embeds>: wikilinks as words, and the targets of links and embeds."""

    def words(m: Column) -> Column:
        name = _name(m["target"])
        embedded = F.when(_is_attachment(name, config), "").when(name != "", F.concat(F.lit("[embeds: "), name, F.lit("]"))).otherwise(m["heading"])
        plain = F.when(m["alias"] != "", strip(m["alias"])).when(m["target"] == "", m["heading"]).when(m["heading"] != "", strip(F.concat_ws(" ", name, m["heading"]))).otherwise(name)
        return F.when(m["bang"] == "!", embedded).otherwise(plain)

    def use(matches: Column) -> Column:
        said = F.concat(F.transform(matches, words), F.array(F.lit("")))
        out = F.array_join(F.zip_with(F.split(text, WIKILINK, -1), said, lambda part, word: F.concat(part, word)), "")
        links = F.transform(F.filter(matches, lambda m: (m["bang"] == "") & (m["target"] != "")), lambda m: m["target"])
        embeds = F.transform(F.filter(matches, lambda m: (m["bang"] == "!") & (_name(m["target"]) != "") & ~_is_attachment(_name(m["target"]), config)), lambda m: m["target"])
        return F.struct(out.alias("text"), links.alias("links"), embeds.alias("embeds"))

    return let(link_matches(text), use)


def markdown_links(text: Column) -> Column:
    """struct<text, links>: images dropped, links as their labels; the targets that are notes."""
    bang, href = (F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(g)) for g in (1, 3))
    notes = F.transform(F.filter(F.arrays_zip(bang.alias("b"), href.alias("h")), lambda z: (z["b"] == "") & F.lower(z["h"]).endswith(".md")), lambda z: z["h"])
    no_images = F.regexp_replace(text, MARKDOWN_LINK.replace("(!?)", "!", 1), "")
    bare = F.regexp_replace(no_images, r"(?U)\[\]\(([^()\s]+)(?:\s+\"[^\"]*\")?\)", "$1")
    return F.struct(F.regexp_replace(bare, MARKDOWN_LINK.replace("(!?)", "", 1), "$1").alias("text"), notes.alias("links"))


def clean_prose(text: Column, config: EngineConfig = EngineConfig()) -> Column:
    """struct<text, links, embeds, tags> of a text outside fenced blocks."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?s)%%.*?%%", ""), r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(strip_callouts(out), r"(?s)==(.+?)==", "$1")
    out = F.regexp_replace(out, r"(?U)\[\^[^\]\s]+\]:?", "")

    def finish(wiki: Column, plain: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(plain["text"], TAG, "$1"), r"(?mU)\s\^[A-Za-z0-9-]{1,32}\s*$", "")
        tags = F.regexp_extract_all(plain["text"], F.lit(TAG), F.lit(1))
        return F.struct(body.alias("text"), F.concat(wiki["links"], plain["links"]).alias("links"), wiki["embeds"].alias("embeds"), tags.alias("tags"))

    return let(out, lambda o: let(wikilinks(o, config), lambda wiki: let(markdown_links(wiki["text"]), lambda plain: finish(wiki, plain))))


def parse_notes(notes: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``notes`` (path, text) with title, aliases, tags, links, embeds, frontmatter and
    sections (each with its cleaned ``body``).

    Fenced blocks are shielded from cleaning by a mark for each; blocks in the language
    of a plugin's query are dropped, and adjacent blocks count as one.
    """
    rows = notes.withColumn("_lines", lines(F.col("text"))).withColumn("_end", frontmatter_end(F.col("_lines")))
    front = F.when(F.col("_end") > 0, parse_frontmatter(F.slice("_lines", 2, F.greatest(F.col("_end") - 1, F.lit(0))))).otherwise(parse_frontmatter(F.array().cast("array<string>")))
    body = F.slice("_lines", F.col("_end") + 2, F.greatest(F.size("_lines") - F.col("_end") - 1, F.lit(0)))
    rows = rows.withColumn("frontmatter", front).withColumn("_masked", fence_mask(body))
    rows = rows.withColumn("_heads", headings(F.col("_masked")))
    own = F.col("frontmatter")
    given = strip(F.array_join(own["title"]["vals"], ", "))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    title = F.coalesce(F.nullif(given, F.lit("")), F.nullif(first_h1(F.col("_heads")), F.lit("")), stem)
    rows = rows.withColumn("title", title).withColumn("_sections", sections(F.col("_masked"), F.col("_heads"), F.col("_end") + 2, F.col("title")))

    def words(*keys: str) -> Column:
        lists = [F.when(F.size(as_list(own[k])) > 0, as_list(own[k])) for k in keys]
        return F.coalesce(*lists, F.array().cast("array<string>"))

    def cleaned(section: Column) -> Column:
        def finish(shielded: Column, prose: Column) -> Column:
            body = strip(F.regexp_replace(_restore(prose["text"], shielded["blocks"], config), r"\n{3,}", "\n\n"))
            return F.struct(*[section[c].alias(c) for c in ("level", "heading", "trail", "start_line")], body.alias("body"), *[prose[c].alias(c) for c in ("links", "embeds", "tags")])

        return let(_shield(F.array_join(section["lines"], "\n")), lambda sh: let(clean_prose(sh["out"], config), lambda pr: finish(sh, pr)))

    rows = rows.withColumn("sections", F.transform("_sections", cleaned))
    gather = lambda c: F.flatten(F.transform("sections", lambda s: s[c]))
    return rows.select(
        *notes.columns, "title", dedupe(words("aliases", "alias")).alias("aliases"), dedupe(F.concat(words("tags", "tag"), gather("tags"))).alias("tags"),
        dedupe(gather("links")).alias("links"), dedupe(gather("embeds")).alias("embeds"), "frontmatter",
        F.transform("sections", lambda s: F.struct(*[s[c].alias(c) for c in ("level", "heading", "trail", "start_line", "body")])).alias("sections"),
    )


#: Marks of fenced blocks: F for the first of a run of adjacent blocks, G for the others.
_MARKS = r"\x00F\d{9}\x00(?:\n\x00G\d{9}\x00)*+"


def _shield(text: Column) -> Column:
    """struct<out, blocks>: a text with each fenced block as one mark, and the blocks."""

    def use(found: Column) -> Column:
        def mark(i: Column) -> Column:
            follows = (i > 0) & (F.get(found["parts"], i) == "\n")
            return F.concat(F.when(follows, "\0G").otherwise("\0F"), F.lpad(i.cast("string"), 9, "0"), F.lit("\0"))

        marks = F.concat(F.transform(found["blocks"], lambda _, i: mark(i)), F.array(F.lit("")))
        return F.struct(F.array_join(F.zip_with(found["parts"], marks, lambda part, m: F.concat(part, m)), "").alias("out"), found["blocks"].alias("blocks"))

    return let(_blocks(text), use)


def _restore(text: Column, blocks: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The blocks in place of their marks; a run whose first language is a plugin's query is dropped."""

    def run(marks: Column) -> Column:
        def use(own: Column) -> Column:
            lang = F.get(F.filter(F.transform(own, _lang), lambda x: x != ""), F.lit(0))
            return F.when(lang.isin(*config.drop_fence_langs), "").otherwise(F.array_join(own, "\n"))

        numbers = F.transform(F.split(marks, "\n"), lambda m: F.get(blocks, F.substring(m, 3, 9).cast("int")))
        return let(numbers, use)

    runs = F.concat(F.transform(F.regexp_extract_all(text, F.lit(_MARKS), F.lit(0)), run), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, _MARKS, -1), runs, lambda part, r: F.concat(part, r)), "")


def section_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row for each section of the result of ``parse_notes``: ``keys``, its place n and
    its fields.  ``inline`` rather than a posexplode: reading fields of an exploded struct
    makes Spark compute the whole array once for each field."""
    fields = ("level", "heading", "trail", "start_line", "body")
    placed = F.transform("sections", lambda s, i: F.struct(i.alias("n"), *[s[c].alias(c) for c in fields]))
    return parsed.select(*keys, F.inline(placed))
