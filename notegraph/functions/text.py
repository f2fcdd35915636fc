"""Words, tokens and snippets as column expressions."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a word of a question, and a token of the index, is, and how many count.
#: Letters and digits without underscore; an apostrophe may stand inside a word.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
TOKEN = r"[\p{L}\p{N}]+"
MOST_TERMS = 32


@functools.cache
def latin_folding() -> tuple[str, str]:
    """Latin letters with diacritics and the plain letters they are matched as.

    Only letters whose decomposition starts with a plain letter fold: of letters with
    two marks, those that decompose in two steps stay as they are.
    """
    found = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) > 1 and not parts[0].startswith("<") and int(parts[0], 16) < 128:
            found.append((chr(code), chr(int(parts[0], 16)).lower()))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def query_terms(text: Column, limit: int = MOST_TERMS) -> Column:
    """Lower-case words, distinct, in order of appearance, at most ``limit``."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), 1, limit)


def match_string(text: Column) -> Column:
    """The terms as quoted literals joined by OR; empty without a term."""
    return F.array_join(F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def _ascii(text: Column) -> Column:
    """Whether every character is one byte; a look at two lengths, not at the characters."""
    return F.octet_length(text) == F.length(text)


def fold(text: Column) -> Column:
    """Lower case, Latin diacritics removed, final sigma as sigma; in ASCII only the case changes."""
    accented, plain = latin_folding()
    low = F.translate(F.lower(text), accented + "ς", plain + "σ")
    return F.when(_ascii(text), F.lower(text)).otherwise(F.regexp_replace(low, r"[\x{300}-\x{36F}]", ""))


def index_tokens(text: Column) -> Column:
    """What the keyword index stores of a text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


#: A character whose class is not the same in all versions of Unicode of the last ten years.
_UNSETTLED = r"[\x{530}-\x{1DFF}\x{1F00}-\x{1FFF}\x{2070}-\x{209F}\x{20D0}-\x{10FFFF}]"


def token_source(text: Column) -> Column:
    """What ``split_tokens`` makes ``index_tokens`` of: the text in lower case, or its tokens with
    spaces between where it has characters beyond Latin, Greek and Cyrillic."""
    known = F.coalesce(text, F.lit(""))
    low = F.lower(known)
    return F.when(~_ascii(known) & low.rlike(_UNSETTLED), F.array_join(index_tokens(known), " ")).otherwise(low)


@functools.cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point what it is folded to, -1 for marks, and whether it is part of a token."""
    accented, plain = latin_folding()
    fold, part = np.arange(0x110000, dtype=np.int32), np.ones(0x110000, bool)
    fold[[*map(ord, accented + "ς")]] = [*map(ord, plain + "σ")]
    fold[0x300:0x370] = -1
    for code in [*range(0x530), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0x20A0, 0x20D0)]:
        part[code] = unicodedata.category(chr(code))[0] in "LN"
    return fold, part


def split_tokens(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The tokens of all texts (``token_source``, no nulls), and how many each has."""
    fold, part = _code_points()
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    code, bounds = raw, ends - ends[0]
    ascii_only = not len(raw) or raw.max() < 128
    if not ascii_only:
        bounds = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[bounds]
        code = fold[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.int32)]
        if (code < 0).any():
            bounds, code = np.append(0, np.cumsum(code >= 0))[bounds], code[code >= 0]
    inside = part[code]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < len(code)]
    begins[first] = inside[first]
    at, code = np.flatnonzero(begins), code[inside]
    place = np.append((np.cumsum(inside) - 1)[at], len(code))
    if ascii_only:
        data = code.tobytes()
    else:
        data = code.tobytes().decode("utf-32-le").encode()
        place = np.append(0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)))[place]
    tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(place.astype(np.int32)), pa.py_buffer(data))
    return tokens, np.diff(np.searchsorted(at, bounds))


def token_count(text: Column) -> Column:
    """The size of ``index_tokens``, without making them."""
    known = F.coalesce(text, F.lit(""))
    bare = F.when(_ascii(known), known).otherwise(F.regexp_replace(known, r"[\x{300}-\x{36F}]", ""))
    return F.regexp_count(bare, F.lit(TOKEN))


def estimate_tokens(text: Column) -> Column:
    """A model-free guess: 3.5 ASCII characters or 1.6 others to a token."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (F.floor((F.length(text) - other) / 3.5 + other / 1.6) + 1).cast("long")


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(body: Column, terms: Column, width: int = 320) -> Column:
    """A window of ``width`` characters, a third of it before the earliest term."""
    flat = squeeze(body)
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(flat), t)), lambda p: p > 0)
    start = F.coalesce(F.greatest(F.lit(0), F.array_min(places) - 1 - width // 3), F.lit(0))
    cut = F.concat(F.when(start > 0, "... ").otherwise(""), F.substr(flat, start + 1, F.lit(width)), F.when(start + width < F.length(flat), " ...").otherwise(""))
    return F.when(F.length(flat) <= width, flat).otherwise(cut)
