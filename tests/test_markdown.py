import random

import pytest
from pyspark.sql import functions as F

from notegraph.config import EngineConfig
from notegraph.functions import chunking, markdown

NOTE = """---
title: My Note
aliases: [Foo, "Bar B", foo]
tags:
  - x
  - '#y'
date: 2024-05-06
date: 2024-05-07
---
intro [[People/Ann|Ann A]] and [[Runbook#Setup]] ![[img.PNG]] ![[Runbook]] #tag1 [lab](other/n.md) ![i](x.png) [[#Here]] ==hi== [^1] text ^abc

# One
> [!warning]- Take care
> of it
> [!note] not a head

```python
# not a heading
x == [[y]]
```
%% hidden
comment %%
## Two ##
%% a
# Three %% b
```dataview
list
```
~~~
open
"""


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("proj/my-note.md", NOTE), ("b/plain.md", "no frontmatter\n# Head\nbody"), ("c/u.md", "---\nunterminated"), ("e.md", "")]
    return markdown.parse_notes(spark.createDataFrame(rows, "path string, text string")).persist()


def test_metadata(parsed):
    r = {x.path: x for x in parsed.collect()}
    n = r["proj/my-note.md"]
    assert (n.title, n.aliases, n.tags) == ("My Note", ["Foo", "Bar B"], ["x", "y", "tag1"])
    assert (n.links, n.embeds) == (["People/Ann", "Runbook", "other/n.md"], ["Runbook"])
    assert n.frontmatter["date"].vals == ["2024-05-07"]
    assert [r[p].title for p in ("b/plain.md", "c/u.md", "e.md")] == ["Head", "u", "e"]


def test_sections(parsed):
    s = {x.path: x.sections for x in parsed.collect()}
    assert [(x.level, x.heading, x.trail, x.start_line) for x in s["proj/my-note.md"]] == [(0, "My Note", [], 10), (1, "One", [], 12), (2, "Two", ["One"], 23), (1, "Three %% b", [], 25)]
    bodies = [x.body for x in s["proj/my-note.md"]]
    assert bodies[0] == "intro Ann A and Runbook Setup  [embeds: Runbook] tag1 lab  Here hi  text"
    assert bodies[1] == "Warning: Take care\nof it\n[!note] not a head\n\n```python\n# not a heading\nx == [[y]]\n```"
    assert bodies[2] == "%% a"
    assert bodies[3] == ""  # both fences are one block, whose first language is a query
    assert [x.body for x in s["c/u.md"]] == ["---\nunterminated"]


def test_chunks(spark, parsed):
    c = chunking.chunk_notes(parsed).where("path = 'proj/my-note.md'").orderBy("ord").collect()
    assert [(x.ord, x.breadcrumb, x.heading, x.start_line) for x in c] == [(0, "proj > My Note", "My Note", 10), (1, "proj > My Note > One > Two", "Two", 23)]
    assert c[0].meta_text == "proj my note.md  Foo Bar B  x y tag1"
    assert c[0].embed_text.startswith("proj > My Note\naliases: Foo, Bar B\ntags: x, y, tag1\n\nintro ")
    assert chunking.chunk_notes(parsed).where("path = 'e.md'").count() == 0


def plain_pack(paras, config):
    out, now, size = [], [], 0
    for p in paras:
        if now and size + len(p) > config.target_chars:
            out.append("\n\n".join(now))
            now = now[-config.overlap_paras :]
            if sum(map(len, now)) > config.target_chars // 2:
                now = []
            size = sum(len(x) + 2 for x in now)
        now = [*now, p]
        size += len(p) + 2
    return out + ["\n\n".join(now)] * bool(now)


def test_packing_equals_a_plain_loop(spark):
    rng = random.Random(3)
    config = EngineConfig(target_chars=100, max_chars=150, min_chars=40)
    cases = [["x" * rng.randint(1, 120) for _ in range(rng.randint(0, 12))] for _ in range(60)] + [["a" * 100, "b" * 100, "c"], ["a" * 99, "b"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, paras array<string>")
    got = {r.i: r.u for r in df.select("i", chunking.pack_paragraphs(F.col("paras"), config).alias("u")).collect()}
    assert got == {i: plain_pack(c, config) for i, c in enumerate(cases)}


def test_paragraphs_and_hard_split(spark):
    df = spark.createDataFrame([("a\nb\n\n```\nc\n\nd\n```\n \n e ",)], "t string")
    assert df.select(chunking.paragraphs(F.col("t"))).first()[0] == ["a\nb", "```\nc\n\nd\n```", "e"]
    df = spark.createDataFrame([("aaa\nbbb\ncccccccccc\nd",)], "t string")
    assert df.select(chunking.hard_split(F.col("t"), 7)).first()[0] == ["aaa\nbbb", "cccccccccc", "d"]


def test_fence_needs_its_own_character_and_length(spark):
    df = spark.createDataFrame([("````\n```\n~~~~\n````\nout\n~~~ x",)], "t string")
    masked = df.select(markdown.fence_mask(markdown.lines(F.col("t")))).first()[0]
    assert [r.inside for r in masked] == [True, True, True, True, False, True]


def test_letters_and_white_space_beyond_ascii(spark):
    from notegraph.sources import vault

    text = "---\ntítulo: Año nuevo\ntags:\u00a0[niño, Größe]\n---\n#año/niño y #Größe\u00a0\n\n##\u00a0Título\u00a0\n> [!información] Día\n"
    r = markdown.parse_notes(spark.createDataFrame([("n.md", text)], "path string, text string")).first()
    assert r.frontmatter["título"].vals == ["Año nuevo"] and r.tags == ["niño", "Größe", "año/niño"]
    assert [x.heading for x in r.sections] == ["n", "Título"] and r.sections[0].body == "año/niño y Größe" and r.sections[1].body == "Información: Día"
    names = spark.createDataFrame([("Nota (José's conflicted copy).md",), ("n-Büro-PC.md",), ("Nota.md",)], "name string")
    assert [x[0] for x in names.select(vault.is_conflict_name(F.col("name"))).collect()] == [True, True, False]


def plain_mask(rows):
    """Line by line: (inside, lang)."""
    import re

    opener, lang, out = None, "", []
    for line in rows:
        found = re.match(r" {0,3}(`{3,}|~{3,})\s*(\S*)", line)
        if opener is not None:
            out.append((True, lang))
            if found and found[1][0] == opener[0] and len(found[1]) >= len(opener) and not found[2]:
                opener = None
        elif found:
            opener, lang = found[1], found[2].lower()
            out.append((True, lang))
        else:
            out.append((False, ""))
    return out


def plain_callouts(rows):
    import re

    quoted, out = False, []
    for line in rows:
        if re.match(r"\s{0,3}>+\s?", line):
            body = re.sub(r"^\s{0,3}>+\s?", "", line)
            head = re.match(r"\s*\[!(\w+)\]([+-])?\s*(.*)$", body)
            out.append(re.sub(":+$", "", f"{head[1].capitalize()}: {head[3]}".strip()).strip() if head and not quoted else body)
            quoted = True
        else:
            quoted = quoted and line.strip() != ""
            out.append(line)
    return out


def test_fences_callouts_and_paragraphs_equal_plain_loops(spark):
    rng = random.Random(11)
    kinds = ["```", "````", "  ```sql", "~~~", "~~~~ Py x", "```~~", "    ```", "``` ", "text", "", " ", "> quote", ">> [!note]- Two: ", "> [!tip] T", "# h", "``` "]
    cases = [[rng.choice(kinds) for _ in range(rng.randint(1, 14))] for _ in range(400)] + [["```"], ["", "```", "x", "```", "```", "y", "```", ""], ["~~~", "~~~", ""], [""], [">" * 3] * 600]
    df = spark.createDataFrame([(i, "\n".join(c)) for i, c in enumerate(cases)], "i int, t string").repartition(4)
    got = df.select("i", markdown.fence_mask(markdown.lines(F.col("t"))).alias("m"), markdown.strip_callouts(F.col("t")).alias("c"), chunking.paragraphs(F.col("t")).alias("p")).collect()
    for r in got:
        mask = plain_mask(cases[r.i])
        assert [(x.line, x.inside, x.lang) for x in r.m] == [(line, *m) for line, m in zip(cases[r.i], mask)], cases[r.i]
        assert r.c.split("\n") == plain_callouts(cases[r.i]), cases[r.i]
        paras, now = [], []
        for line, (inside, _) in [*zip(cases[r.i], mask), ("", (False, ""))]:
            if line.strip() or inside:
                now.append(line)
            elif now:
                paras.append("\n".join(now).strip())
                now = []
        assert r.p == [p for p in paras if p], cases[r.i]
    assert df.where("i < 0").select(markdown.fence_mask(F.array().cast("array<string>"))).count() == 0
    assert spark.range(1).select(markdown.fence_mask(F.array().cast("array<string>"))).first()[0] == []


def test_small_units_are_merged_as_in_a_plain_loop(spark):
    rng = random.Random(5)
    config = EngineConfig(target_chars=60, max_chars=90, min_chars=30)
    trails = [[], ["a"], ["a", "b"], ["c"]]
    cases = [[(rng.choice(trails), rng.choice("abc"), 1, k, "x" * rng.randint(1, 50)) for k in range(rng.randint(0, 12))] for _ in range(80)] + [[([], "a", 1, k, "x" * 31) for k in range(700)]]
    kind = "array<struct<trail:array<string>,heading:string,level:int,start_line:int,text:string>>"
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, u {kind}")
    for r in df.select("i", chunking.merge_small(F.col("u"), config).alias("g")).collect():
        want, now, size = [], [], 0
        for u in cases[r.i]:
            related = now and (u[0] == now[0][0] or u[0][: len(now[0][0]) + 1] == [*now[0][0], now[0][1]])
            if now and (size >= config.min_chars or size + len(u[4]) > config.max_chars or not related):
                want.append(now)
                now, size = [], 0
            now, size = [*now, u], size + len(u[4]) + 2
        assert [[tuple(u) for u in g] for g in r.g] == want + [now] * bool(now)


def test_adjacent_blocks_are_one_and_long_notes_take_linear_time(spark):
    import time

    text = "```\na\n```\n```dataview\nb\n```\n\n```x\nc\n```\n^id\n```dataview\nd\n```\nend"
    r = markdown.parse_notes(spark.createDataFrame([("n.md", text)], "path string, text string")).first()
    assert r.sections[0].body == "```x\nc\n```\n\nend"  # the removed line between leaves two blocks
    began = time.time()
    kinds = ["# Head {}", "text [[Note {}|it]] #tag", "> [!note] {}", "", "```sql", "select {}", "```", "- item {}"]
    text = "\n".join(kinds[i % 8].format(i) for i in range(100_000))
    notes = markdown.parse_notes(spark.createDataFrame([("n.md", text)], "path string, text string"))
    chunks = chunking.chunk_notes(notes).select("start_line", "body").collect()
    assert sum(c.body.count("select ") for c in chunks) == 12_500 and time.time() - began < 60


def test_generated_notes_do_not_depend_on_partitions(spark):
    from notegraph.sources import generated, vault

    one, many = (sorted(map(tuple, generated.notes(spark.range(0, 200, 1, k), 3).collect())) for k in (1, 7))
    assert one == many and len({r[1] for r in one}) == 200
    assert [r[2] for r in one] != [r[2] for r in sorted(map(tuple, generated.notes(spark.range(200), 4).collect()))]
    files = generated.vault(spark, 50)
    reasons = files.select(vault.skip_reason(F.col("path")).alias("r")).where("r IS NOT NULL").collect()
    assert files.count() == 53 and sorted(r.r for r in reasons) == ["conflict", "folder", "suffix"]
