"""Operators over documents against plain versions, on odd and on random rows."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notegraph.llm import bpe, exact_dedup, licenses, near_dedup, packing, sharding

from ..compare import SF_DIR
from .conftest import DOCS, ODD

public = pytest.importorskip("public_tokenizers")
TEXTS = [r[1] or "" for r in ODD]


def random_docs(spark, seed, n=150):
    rng = random.Random(seed)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(300)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([2, 6, 40, 80, 200]))))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, DOCS)


# ---- packing


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 2, 7, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        plan, n = packing.best_fit_plan(dict(collections.Counter(lengths)), capacity)
        fill = collections.Counter()
        for length, _, count, first, offset in plan.tolist():
            for s in range(first, first + count):
                assert fill[s] == offset
                fill[s] += length
        assert sorted(capacity - v for v in fill.values()) == plain_best_fit(lengths, capacity) and n == len(fill)


def check_packing(rows, got, capacity):
    tokens = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    per, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        per[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(tokens.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, (start, length) in enumerate(packing.cut_points(len(ids), capacity)):
            want[doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing(spark, odd, empty):
    check_packing(ODD, packing.pack_documents(odd, 256).collect(), 256)
    rows, docs = random_docs(spark, 3)
    got = packing.pack_documents(docs, 64).collect()
    check_packing(rows, got, 64)
    assert len({r.sequence_id for r in got}) == len(plain_best_fit([r.length for r in got], 64))
    assert packing.pack_documents(empty).collect() == []


def test_byte_tokenizer_equals_the_library():
    rng = random.Random(4)
    library, own = Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.byte_tokenizer()
    cases = TEXTS + ["".join(rng.choice("ab '\n\t .1é") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["<|endoftext|>", " <|endoftext|>  x"]
    cases += ["a" + space * 2_000_000 + "b c" for space in " \n\t\r\xa0"] + [" ".join("\n x"[: i % 4] for i in range(3000))]
    for text, ids in zip(cases, own.encode_batch(cases)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:100]


def test_pieces_can_carry_ids(spark):
    r = packing.tokenize_pieces(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), with_ids=True).first()
    assert len(r.ids) == r.length and r.ids[-1] == 0


# ---- near duplicates


def plain_components(rows, percent=85):
    sets = []
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # so that buckets are compared in several blocks
    rows, docs = random_docs(spark, seed)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect())) == plain_components(rows)


def test_near_duplicates_link_through_a_later_hub(spark):
    """Copies of a hub differ from each other too much; the hub has the largest id."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[: 7 * i + 3] + [f"new{i}"] + base[7 * i + 4 :]), "en", "s", 0) for i in range(12)] + [(99, " ".join(base), "en", "s", 0)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == plain_components(rows) and {r.component_id for r in got} == {0}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    ids = {k: v for k, v in got.items() if k[0] in (None, 3, 4, 5, 6, 7)}
    assert ids == {(3, 0, 3, True): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1, (6, 1, 6, True): 2, (7, 1, 6, False): 1, (None, 1, 6, False): 1}
    assert near_dedup.near_duplicates(empty).collect() == []


def test_near_copy_stage_takes_a_similarity_of_0_8(spark):
    from corpus_pipeline import drop_near_copies

    base = [f"w{i}" for i in range(104)]  # 100 shingles; of two texts 90 are common, of 110
    texts = [base, [*base[:94], *(f"x{i}" for i in range(10))], [*(f"y{i}" for i in range(12)), *base[12:]]]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)], DOCS)
    assert plain_components([(i, " ".join(w)) for i, w in enumerate(texts)], 80) == [(0, 100, 0, True), (1, 100, 0, False), (2, 100, 2, True)]
    assert sorted(r.doc_id for r in drop_near_copies(spark, docs, "").collect()) == [0, 2]
    assert near_dedup.near_duplicates(docs).where("kept").count() == 3


def test_pairs_are_found_by_whole_band_keys_and_below_the_estimate():
    import pyarrow as pa

    long = np.zeros((2, near_dedup.LONG), np.uint8)
    long[1, : near_dedup.LONG // 4] = 1  # agrees in 0.75 of the coordinates
    key = -5
    keys = np.full((2, 32), 7, np.uint64)
    keys[1] += np.uint64(1 << 32)  # the same lower halves in every band
    keys[:, 9] = np.array([key]).view(np.uint64)
    rows = [(key, 3 + i, 3 + i, -1, 100, long[i].tobytes(), keys[i].tobytes()) for i in range(2)]
    assert [(i, at.tolist()) for i, at in near_dedup._partners(rows, 85)] in ([(0, [1])], [(1, [0])])
    assert near_dedup._likely(rows, 85, False) == [0, 1]
    # Another bucket of a later band leaves the pair to this one; so does a set that is too small.
    later = np.array([[11]], np.int64)
    keys[:, 20] = later.view(np.uint64)[0]
    assert not list(near_dedup._partners([(11, *r[1:6], keys[i].tobytes()) for i, r in enumerate(rows)], 85))
    assert not list(near_dedup._partners([(*r[:4], 100 - 16 * i, *r[5:]) for i, r in enumerate(rows)], 85))


def test_a_block_sends_rows_not_pairs():
    """Texts a little below the threshold of each other: all pairs are looked at, none is emitted."""
    rng = np.random.default_rng(3)
    core, own = rng.integers(0, 2**63, 88, dtype=np.uint64), rng.integers(0, 2**63, (120, 12), dtype=np.uint64)
    sets = [np.sort(np.append(core, o)) for o in own]
    sketch = (near_dedup.sketches(sets, near_dedup.LONG) & np.uint64(255)).astype(np.uint8)
    rows = [(0, i, i, -1, 100, sketch[i].tobytes(), None, s.tobytes()) for i, s in enumerate(sets)]
    assert sum(len(at) for _, at in near_dedup._partners(rows, 80)) > 1000  # 88 of 112 are common: 79 %
    assert len(near_dedup._likely(rows, 80, False)) <= 120 and near_dedup._confirmed(rows, 80, False) == []
    joined = near_dedup._confirmed(rows, 78, False)
    assert len(joined) == 119 and len({x for pair in joined for x in pair}) == 120
    overlaps = near_dedup._Overlaps(sets + [np.zeros(0, np.uint64), core])
    assert overlaps.sizes(0, np.array([1, 120, 121])).tolist() == [88, 0, 88]


def test_many_texts_below_the_threshold_stay_apart(spark):
    """600 texts, each 78 % like every other at a threshold of 80 %, and one pair above it."""
    words = [[f"w{i}" for i in range(300)] for _ in range(600)]
    for d, own in enumerate(words):
        for k in range(7):
            own[20 + 40 * k] = f"x{d}_{k}"
    words.append([*words[5][:-3], "a", "b", "c"])
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(words)], DOCS)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 80).collect()}
    assert got == {i: i for i in range(600)} | {600: 5}


def test_stages_keep_one_row_of_each_group(spark, odd, empty):
    base = [f"w{i}" for i in range(100)]
    a, b = " ".join(base), " ".join([*base[:99], "other"])
    c, d = a.upper().replace("W", "v"), " ".join(f"v{i}" for i in range(99)) + " other"
    more = [(20, a), (20, a), (20, d), (21, c), (None, b), (None, "none of these words"), (None, "none  of these words"), (None, "none of these words at all"), (30, "one\ttwo"), (30, "one two"), (4, "")]
    rows = ODD + [(i, t, "en", str(n), 0) for n, (i, t) in enumerate(more)]
    for own, df in ((ODD, odd), (rows, spark.createDataFrame(rows, DOCS))):
        norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in own]
        want = {t: min((i for i, u in norm if u == t), key=lambda i: (i is not None, i or 0)) for _, t in norm}
        kept = exact_dedup.kept_documents(df)
        assert kept.columns == df.columns
        got = [(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id) for r in kept.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want.items()))
        # Each row an identifier of its own, in the order of the doc_ids.
        order = sorted(own, key=lambda r: (r[0] is None, r[0] or 0))
        plain = plain_components([(i, r[1]) for i, r in enumerate(order)])
        want = collections.Counter(order[i][0] for i, n, _, k in plain if k and n) + collections.Counter(i for i, _ in {(order[i][0], order[i][1] or "") for i, n, *_ in plain if not n})
        kept = near_dedup.kept_documents(df)
        assert kept.columns == df.columns and collections.Counter(r.doc_id for r in kept.collect()) == want
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).where("n_shingles > 90 AND n_shingles < 100").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(20, 96, 20, True)] * 2 + [(20, 96, 20, True), (21, 96, 20, False), (None, 96, 20, False)], key=str)
    assert exact_dedup.kept_documents(empty).collect() == [] and near_dedup.kept_documents(empty).collect() == []


def test_sketches_estimate_and_fill():
    from notegraph.llm.shingles import sketches

    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    s = sketches([x[:900], x[100:], x[:1], x[:0]], 128)
    assert (s[:3] != ~np.uint64(0)).all() and (s[3] == ~np.uint64(0)).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


# ---- sharding


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")
def test_loads_are_those_of_plain_longest_processing_time(spark):
    """Few groups, so that nearly each is a unit: the loads of all groups scheduled one by one."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    groups = collections.Counter()
    for r in docs.select("text").collect():
        groups[r.text or ""] += len((r.text or "").encode()) + 1
    plain = collections.Counter()
    for unit, shard in sharding.least_loaded(list(enumerate(groups.values())), 16).items():
        plain[shard] += list(groups.values())[unit]
    loads = collections.Counter()
    for r in sharding.shard_documents(docs).collect():
        loads[r.shard] += r.size
    assert sorted(loads.values()) == sorted(plain.values())



def test_sharding(spark, odd, empty):
    rows, docs = random_docs(spark, 7)
    for own, df in ((rows, docs), (ODD, odd)):
        got = sharding.shard_documents(df).collect()
        want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in own)
        assert want == collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)
        slots, texts, load = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
        for r in got:
            slots[r.shard].append(r.slot)
            texts[r.text_crc32].add(r.shard)
            load[r.shard] += r.size
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in texts.values())
        assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and set(load) <= set(range(16))
    assert sharding.shard_documents(empty).collect() == []


def test_least_loaded_is_longest_first():
    assert sharding.least_loaded([(1, 5), (2, 4), (3, 3), (4, 3), (5, 3)], 2) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


# ---- exact duplicates


def test_exact_dedup(spark, odd, empty):
    rows, docs = random_docs(spark, 8)
    for own, df in ((rows + rows[:5], docs.union(spark.createDataFrame(rows[:5], DOCS))), (ODD, odd)):
        norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t, *_ in own]
        groups = collections.defaultdict(list)
        for d, t in norm:
            groups[t].append(d)
        keep = {t: min(ids, key=lambda d: (d is not None, d or 0)) for t, ids in groups.items()}
        got = exact_dedup.exact_dedup(df).collect()
        want = collections.Counter((d, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)
        assert want == collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got)
        assert sorted(r.text_sha256 for r in got if r.kept) == sorted({k[3] for k in want})
    assert exact_dedup.exact_dedup(empty).collect() == []


@pytest.mark.parametrize("hashes", ["one", "two", "own"])
def test_texts_are_told_apart_whatever_their_hashes(spark, monkeypatch, hashes):
    """Equal hashes of different texts, with and without salts, and a text of a third of all rows."""
    if hashes != "own":
        monkeypatch.setattr(exact_dedup, "text_hash", lambda norm: F.length(norm).cast("long") % {"one": 1, "two": 2}[hashes])
    rng = random.Random(12)
    prefix = "p" * exact_dedup.PREFIX_CHARS
    texts = [prefix + rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(200)] + [prefix + "hot"] * 100
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_salt": F.lit(1), "_hash": F.lit("x")}).repartition(5)
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t].append(i)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == sorted((i, min(ids), len(ids), i == min(ids)) for ids in groups.values() for i in ids)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))


# ---- tokenization automaton


def test_automaton_equals_the_library():
    rng = random.Random(5)
    library, own = Tokenizer.from_file(public.path("word_bpe_49k.json")), bpe.word_tokenizer()
    library.no_truncation()
    library.no_padding()
    alphabets = ["ab", "a", "aehtn", "abcdefghijklmnopqrstuvwxyz", "!?.-=*", "aé😀ß日 ", "lmoa' ", "A Σσ1\n"]
    cases = TEXTS + ["".join(rng.choice(a) for _ in range(rng.randint(1, 40))) for a in alphabets for _ in range(500)] + ["a<|endoftext|> b <|startoftext|>", "<|endoftext|>"]
    for text in cases:
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want)


def test_encode_documents(odd, empty):
    got = bpe.encode_documents(odd, with_tokens=True).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert bpe.encode_documents(empty).collect() == []


# ---- licences


def plain_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += own
        base |= {label} if own else set()
    s, hits = " " + " ".join(w) + " ", []
    for label, key, priority, score, pattern in licenses.rules():
        if f" {key}" in s:
            hits += [(m.start(), -m.end(), -priority, label, score) for m in re.finditer(pattern, s)]
    hits.sort()
    kept = [h for i, h in enumerate(hits) if not any(g[0] <= h[0] and g[1] <= h[1] and g[2] <= h[2] for g in hits[:i])]
    score = max([0.0, *[h[4] for h in kept], *[0.5] * bool(starts)])
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[3] for h in kept})), score


def test_license_scan(spark, odd, empty):
    rng = random.Random(9)
    parts = ["MIT License", "mit-license", "Licensed under the Apache License, Version 2.0.", "cc by", "CC BY-NC 4.0", "GNU General Public License", "version 3", "released under the", "all rights reserved", "ümit license", "SPDX-License-Identifier: GPL-2.0", "x", "\n", "public domain", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["mit license " * 300]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    for own, df in ((rows, spark.createDataFrame(rows, DOCS)), (ODD, odd)):
        got = collections.Counter(map(tuple, licenses.scan(df).collect()))
        assert got == collections.Counter((d, *plain_scan(t)) for d, t, *_ in own)
    assert licenses.scan(empty).collect() == []
    patterns = [r[4] for r in licenses.rules()]
    assert len(patterns) == len(set(patterns)) > 200


def test_license_scan_of_many_hits_is_far_from_quadratic(spark):
    text = "mit license, apache license 2.0 and cc by " * 10_000
    began = time.time()
    assert tuple(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()) == (1, 90_000, 30_000, 0, 89_998, "apache,cc-by,mit", "apache,apache-2.0,cc-by,mit", 0.9)
    assert time.time() - began < 60


def written_out(pattern):
    """Strings that a pattern matches, with each alternative and each optional part in and out."""
    from re import _constants, _parser

    def each(parsed):
        out = [""]
        for op, value in parsed:
            if op == _constants.LITERAL:
                more = [chr(value)]
            elif op == _constants.IN:
                more = [chr(value[0][1])] if value[0][0] == _constants.LITERAL else ["1"] if value[0][1] == _constants.CATEGORY_DIGIT else ["w"]
            elif op == _constants.ANY:
                more = ["x"]
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
                more = [""] * (value[0] == 0) + each(value[2])
            elif op == _constants.BRANCH:
                more = [x for branch in value[1] for x in each(branch)]
            else:
                assert op == _constants.SUBPATTERN
                more = each(value[-1])
            out = [x + y for x in out for y in more]
        return out

    return each(_parser.parse(pattern))


def test_license_keywords_are_part_of_every_match():
    gate = re.compile(licenses.prefilter())
    for _, key, *_, pattern in licenses.rules():
        for text in written_out(pattern.removeprefix("(?<= )").removesuffix("(?= )")):
            assert re.search(pattern, f" {text} ") and f" {key}" in f" {text} " and gate.search(f" {text} "), (key, text)
    for phrase, _ in licenses.BASE:
        assert gate.search(f" {phrase} ")


def test_license_scan_equals_all_rules_without_keywords(spark, monkeypatch):
    names = ["AGPL-3.0", "AGPLv3", "AGPL", "Affero GPL", "ODbL", "ODbL v1.0", "Expat License", "EULA", "MIT No Attribution", "you can redistribute it and/or modify it under the terms of the GNU General Public License"]
    texts = [f"x {before}{name}{after} y" for name in names for before in ("", "SPDX-License-Identifier: ", "licensed under the ", "released under ", "see the terms of the ") for after in ("", " or later")]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, DOCS)).collect()))
    every = [(label, "", *rest) for label, _, *rest in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: every)
    assert got == sorted((i, *plain_scan(t)) for i, t, *_ in rows)
    labels = {t: r[6] for (_, t, *_), r in zip(rows, got)}
    assert all(labels.values())
    said = {"SPDX-License-Identifier: AGPL-3.0": "agpl-3.0", "licensed under the AGPLv3": "agpl-3.0", "AGPL": "agpl", "ODbL": "odbl-1.0", "Expat License": "mit", "EULA": "commercial", "MIT No Attribution": "mit-0", "SPDX-License-Identifier: ODbL v1.0": "odbl-1.0"}
    assert {k: labels[f"x {k} y"] for k in said} == said


def test_token_files_read_heads_and_not_ids_for_the_manifest(spark, tmp_path, monkeypatch):
    """The bytes of a file that reach Python for the manifest are those of its head; widths and
    bits are as a plain loop over the values makes them."""
    import numpy as np

    from notegraph.llm import token_files

    seen = []
    plain = token_files.cut
    monkeypatch.setattr(token_files, "cut", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    token_files.write_token_files(spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string"), f"{tmp_path}/out")
    assert any("substring(content" in plan for plan in seen)
    ids = np.random.default_rng(2).integers(0, 1 << 20, 5000).astype(np.uint32) >> np.arange(5000, dtype=np.uint32) % 20
    for width in (1, 7, 8, 13):
        values = ids & np.uint32((1 << width) - 1)
        bits = "".join(f"{v:0{width}b}"[::-1] for v in values.tolist())
        assert token_files._packed(values, width) == bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8)) + bytes(8)
    assert (token_files.TokenFile(token_files.TokenFile.build(0, 0, 0, [1], [len(ids)], ids)).ids() == ids).all()
