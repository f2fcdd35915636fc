"""License scans by ordered signature rules, in DataFrame operations alone.

A text becomes its lower-case words, joined by single spaces.  The rules of
``license_rules`` are regular expressions over that form.  One prefilter of all keywords
tells the texts that can hold a detection; in those a rule is tried where its keyword
stands.  Of overlapping detections, one that lies inside another of the same or a higher
priority is suppressed; the labels of the others are reported, with the base labels.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import rules

#: The base phrases and their labels; each holds a keyword of the rules.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: What stands for a match while a text is taken apart; no word holds it.
MARK = "\x01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefilter() -> str:
    """A pattern for any keyword at the start of a word, by first letters."""
    keys = sorted({key for _, key, *_ in rules()})
    parts = [f"{first}(?:{'|'.join(k[1:] for k in own)})" for first, own in itertools.groupby(keys, key=lambda k: k[0])]
    return f" (?:{'|'.join(parts)})"


def _sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks of about the root of their
    number, so that many matches in one text stay far from quadratic."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def within(size: Column, blocks: Column) -> Column:
        starts = F.transform(blocks, lambda x, k: total(F.slice(blocks, F.lit(1), k)))
        return _let(starts, lambda base: F.transform(lengths, lambda x, i: F.get(base, (i / size).cast("int")) + total(F.slice(lengths, i - i % size + 1, i % size))))

    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))
    sums = lambda s: F.transform(F.sequence(F.lit(0), ((F.size(lengths) - 1) / s).cast("int")), lambda k: total(F.slice(lengths, k * s + 1, s)))
    return _let(size, lambda s: _let(sums(s), lambda blocks: within(s, blocks)))


def _detections(m: Column) -> Column:
    """Intervals of a rule's matches, longest first where they start together."""
    lengths = F.transform(m["found"], lambda f, i: F.length(f) + F.length(F.get(m["between"], i)))

    def hit(before: Column, i: Column) -> Column:
        start = before + F.length(F.get(m["between"], i))
        end = start + F.length(F.get(m["found"], i))
        return F.struct(start.alias("start"), (-end).alias("low_end"), (-m["priority"]).alias("low_priority"), m["label"].alias("label"), m["score"].alias("score"))

    return _let(lengths, lambda own: F.transform(_sums_before(own), hit))


def _matches(words: str) -> str:
    """SQL for the rules that match in the column ``words``, an array of
    struct<label, priority, score, found, between>.  Each pattern is a constant, so it is
    compiled once; as SQL because that many nested calls take seconds to build one by one."""

    def one(label: str, priority: int, score: float, pattern: str) -> str:
        between = f"split(regexp_replace({words}, r'{pattern}', '{MARK}'), '{MARK}', -1)"
        made = f"named_struct('label', '{label}', 'priority', {priority}, 'score', {score}D, 'found', regexp_extract_all({words}, r'{pattern}', 0), 'between', {between})"
        return f"if(rlike({words}, r'{pattern}'), {made}, NULL)"

    gated = []
    for key, own in itertools.groupby(sorted(rules(), key=lambda r: r[1]), key=lambda r: r[1]):
        tried = ", ".join(one(label, priority, score, pattern) for label, _, priority, score, pattern in own)
        gated.append(f"if(contains({words}, '{key}'), array({tried}), NULL)")
    return f"array_compact(flatten(array_compact(array({', '.join(gated)}))))"


def _survivors(hits: Column) -> Column:
    """Labels and best score of the hits that no other contains, in one pass over the
    hits by start: a hit is inside an earlier one if that one's end is not before its own."""

    def step(acc: Column, hit: Column) -> Column:
        end, priority = -hit["low_end"], -hit["low_priority"]
        inside = F.greatest(*[F.when(priority <= p, acc[f"end{p}"]).otherwise(-1) for p in (1, 2, 3)]) >= end
        ends = [F.when((priority == p) & (end > acc[f"end{p}"]), end).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in (1, 2, 3)]
        labels = F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(hit["label"])))
        score = F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], hit["score"]))
        return F.struct(*ends, labels.alias("labels"), score.alias("score"))

    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in (1, 2, 3)], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    return F.aggregate(F.array_sort(hits), start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


#: Anything but digits, letters of either case and characters beyond ASCII.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def _place(phrase: str) -> str:
    """A phrase as it stands among words that have a space on either side."""
    return f" {phrase.replace(' ', '  ')} "


def _before(text: Column, at: Column) -> Column:
    """Number of words before the place ``at`` (from 1)."""
    head = F.substr(text, F.lit(1), (at - 1).cast("int"))
    return ((F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for
    every row of ``docs``.

    Words are runs of 0-9, a-z and characters beyond ASCII of the lower-cased text (null:
    empty).  The case of letters beyond ASCII makes no difference to words or base phrases.  n_base counts the places of the base phrases; first_word and last_word are
    their smallest and largest start, null without one.  Labels are distinct, sorted and
    comma-joined, empty without one.  score is the best of the detections that stay, at
    least 0.5 with a base phrase.  Repeated rows give repeated rows, an empty table an
    empty one; other columns are ignored.
    """
    said = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), NO_WORD, " "))
    rows = docs.select("doc_id", said.alias("said"))
    spaces = F.length("said") - F.length(F.replace("said", F.lit(" "), F.lit("")))
    words = F.concat(F.lit(" "), F.lower("said"), F.lit(" "))
    rows = rows.select("doc_id", F.when(F.col("said") == "", 0).otherwise(spaces + 1).cast("long").alias("n_words"), words.alias("words"))
    rows = rows.withColumn("words", F.when(F.col("words").rlike(prefilter()), F.col("words")))
    rows = rows.withColumn("spaced", F.replace("words", F.lit(" "), F.lit("  ")))
    rows = rows.withColumn("spaced", F.substr("spaced", F.lit(2), F.length("spaced") - 2))
    none = F.lit(0)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        own = _place(phrase)
        n = F.coalesce(((F.length("spaced") - F.length(F.replace("spaced", F.lit(own), F.lit("")))) / len(own)).cast("long"), none)
        at = F.locate(own, F.col("spaced"))
        back = F.locate(own[::-1], F.reverse("spaced"))
        counts.append(n)
        firsts.append(F.when(at > 0, _before(F.col("spaced"), at)))
        lasts.append(F.when(back > 0, _before(F.col("spaced"), F.length("spaced") - back - len(own) + 2)))
        labels.append(F.when(at > 0, F.lit(label)))
    hits = F.flatten(F.transform("matches", _detections))
    rows = rows.select(
        "doc_id", "n_words", functools.reduce(lambda a, b: a + b, counts).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"), F.expr(f"if(words IS NOT NULL, {_matches('words')}, NULL)").alias("matches"),
    )
    rows = rows.withColumn("hits", hits)
    rows = rows.withColumn("kept", F.when(F.size("hits") > 0, _survivors(F.col("hits"))))
    own = F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("kept.score"), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
