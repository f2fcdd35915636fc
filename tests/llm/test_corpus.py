"""Token files, divergence and collocations against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notegraph.llm import collocations, divergence, token_files

from .conftest import DOCS, ODD

public = pytest.importorskip("public_tokenizers")


# ---- token files


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


def wanted_files(rows):
    tokens, at, out = library(), 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array(tokens.encode(text, add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_tokens", [7, 50, 1 << 23])
def test_files_hold_every_document_in_order(spark, odd, tmp_path, file_tokens):
    path = str(tmp_path / "files")
    token_files.write_token_files(odd, path, file_tokens=file_tokens)
    got = [tuple(r) for r in token_files.read_documents(spark, path).orderBy("start").collect()]
    assert got == wanted_files(ODD)  # the only repeated doc_id has one text
    kept = {r.start: r.ids for r in token_files.read_documents(spark, path, with_ids=True).collect()}
    every = [i for start in sorted(kept) for i in kept[start]]
    asked = spark.createDataFrame([(i,) for i in [*range(0, len(every) + 3, 2), 0, -1, None]], "position long")
    found = {r.position: r.token for r in token_files.tokens_at(spark, path, asked).collect()}
    assert found == {i: every[i] for i in range(0, len(every), 2)}


def test_a_hot_doc_id_is_dealt_over_files(spark, tmp_path):
    rows = [(5, f"word{i} again", "en", "s", 0) for i in range(400)] + [(None, "none", None, None, None)] * 50
    path = str(tmp_path / "files")
    token_files.write_token_files(spark.createDataFrame(rows, DOCS).repartition(4), path, file_tokens=300)
    files = token_files.manifest(spark, path).collect()
    assert max(f.n_tokens for f in files) <= 310 and len(files) > 5
    got = token_files.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [5] * 400 + [None] * 50
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((d, n, c) for d, _, n, c in wanted_files(rows))


def test_no_documents_give_no_files(spark, empty, tmp_path):
    assert token_files.coded_documents(empty, str(tmp_path / "files")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70000), max_size=40), min_size=1, max_size=12), st.integers(0, 3))
def test_image_gives_its_ids_back(docs, shift):
    ids = np.array([i >> 4 * shift for d in docs for i in d], np.uint32)
    file = token_files.TokenFile(token_files.TokenFile.build(3, 1, 9, list(range(len(docs))), [len(d) for d in docs], ids) + b"\n")
    assert file.ids().tolist() == ids.tolist() and (file.part, file.place, file.before, file.n_docs) == (3, 1, 9, len(docs))
    at = np.random.default_rng(1).permutation(len(ids))
    assert file.at(at).tolist() == ids[at].tolist()


def test_image_over_many_blocks_and_widths_that_pay():
    rng = np.random.default_rng(2)
    ids = np.where(rng.random(5000) < 0.9, rng.integers(0, 30, 5000), rng.integers(0, 1 << 16, 5000)).astype(np.uint32)
    image = token_files.TokenFile.build(0, 0, 0, [1], [5000], ids)
    file = token_files.TokenFile(image)
    assert file.at(np.arange(5000)).tolist() == ids.tolist() == file.ids().tolist()
    assert len(token_files.best_widths(ids)) > 1 and len(image) < 2 * 5000
    costs = {w: sum(int((ids >> b != 0).sum() if b else 5000) * (n + (k < len(w) - 1)) for k, (n, b) in enumerate(zip(w, np.cumsum([0, *w])))) for w in [(16,), (8, 8), (5, 11), (4, 4, 8), tuple(token_files.best_widths(ids))]}
    assert costs[tuple(token_files.best_widths(ids))] == min(costs.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abXYéÉßñΣσς'’.,!-_@12 \t\n\x1c\x85\xa0İıǅ日̸́½", "'s", "'T", "<|endoftext|>", "<|start"]), max_size=20).map("".join), max_size=5))
def test_batch_encoding_is_the_library_s(texts):
    words = token_files.library_words()
    assert [np.frombuffer(x, words.dtype).tolist() for x in words.encode_batch(texts)] == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


# ---- divergence


def plain_divergence(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = collections.Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in in_docs.items() if n >= least]
        count = collections.defaultdict(collections.Counter)
        for _, source, words in own:
            count[source].update(w for w in words if in_docs[w] >= least)
        whole = sum(count.values(), collections.Counter())

        def share(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for a in count:
            lists = {"pair": [(b, sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept)) for b in count if b != a]}
            lists["term"] = [(t, (p[a][t] - q[t]) ** 2 // q[t]) for t in kept if count[a][t] and p[a][t] > q[t]]
            for part, items in lists.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, item, value, rank) for rank, (item, value) in enumerate(items[: top if part == "term" else None], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [4, 64, 1 << 20])
def test_divergence_equals_plain_sums(spark, cells):
    rng = random.Random(cells)
    rows = [(i, " ".join(rng.choice(["Über", "alpha", "Beta", "x1y", "a.b", "é"]) + rng.choice("abcd") * rng.randint(0, 2) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice("stuvw") if rng.random() < 0.9 else None, 0) for i in range(120)]
    rows += [(500, "hot words here", "en", "s", 0)] * 80 + [(600, None, "fr", "a", 0), (601, "so few", "fr", "b", 0), (602, "alone", "it", None, 0)]
    got = divergence.divergence(spark.createDataFrame(rows, DOCS), top_terms=9, cells=cells)
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, top=9)


def test_divergence_of_odd_and_no_rows(odd, empty):
    assert sorted(map(tuple, divergence.divergence(odd, least_docs=1).collect())) == plain_divergence(ODD, 1)
    assert divergence.divergence(empty).count() == 0


def test_equal_subtrees_are_one_node_and_walked_once():
    table = np.tile(np.array([[1, 2, 3, 4] * 8, [1, 2, 3, 4] * 8, [0] * 32]), (1, 1))
    roots, levels, leaves = divergence.consed(table)
    assert roots[0] == roots[1] != roots[2] and max(len(x) for x in levels) <= 3
    pair, a, b, times = divergence.met_leaves(levels, np.array([0]), roots[[0]], roots[[2]])
    assert len(pair) == 4 and times.tolist() == [8] * 4 and leaves[b].tolist() == [0] * 4


def test_shares_of_counts_beyond_64_bits_are_exact():
    counts = np.array([0, 10**12, 7 * 10**13], np.int64)
    assert divergence._share(counts, 9 * 10**13, 10**6).tolist() == [1 + 10**9 * (int(c) + 1) // (9 * 10**13 + 10**6) for c in counts]


# ---- collocations


def plain_collocations(rows, least, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            inside = any(len(d) > len(p) and b >= a and any(d[i : i + len(p)] == p for i in range(len(d) - len(p) + 1)) for d, b in cand.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, " ".join(p), own[p[:k]], own[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, rank, phrase, a, left, right, n[lang], score) for rank, (score, a, phrase, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("range_bytes", [60, 2000, 8 << 20])
def test_collocations_equal_plain_counts(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 500)
    rng = random.Random(range_bytes)
    words = ["New", "york", "of", "the", "a", "é", "x\x1cy", "日本", "cat"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), "s", 0) for i in range(150)]
    rows += [(900, "the same hot line of words again", "en", "s", 0)] * 70 + [(901, None, "en", "s", 0), (902, "...", "fr", "s", 0)]
    got = collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(5), least=8, range_bytes=range_bytes)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 8)


def test_collocations_of_odd_and_no_rows(odd, empty):
    assert sorted(map(tuple, collocations.collocations(odd, least=2).collect())) == plain_collocations(ODD, 2)
    assert collocations.collocations(empty).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(10**13, 3 * 10**13, 2 * 10**13, 10**13)], "a long, n long, l long, r long")
    exact = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "alnr"}
    assert row.select(F.expr(collocations.SCORE.format(**exact))).first()[0] == 1000 * 10**13 * 3 * 10**13 // (2 * 10**13 * 10**13)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=9), max_size=8), st.integers(1, 3))
def test_union_of_automata_adds_counts(pieces, parts):
    words = [b"a", b"bb", b"c", b"d"]
    want, images = collections.Counter(), []
    for k in range(parts):
        ids = np.array([i for piece in pieces[k::parts] for i in [*piece, 0]], np.int32)
        runs = collocations._runs(ids) if len(ids) else np.zeros((0, 5), np.int32)
        want.update(tuple(words[w - 1] for w in run if w) for run in runs.tolist())
        images.append(collocations.CountAutomaton.build(words, *collocations._summed(runs, np.ones(len(runs), np.int64), 4)))
    names, runs, counts = collocations.united(images)
    got = {tuple(names[w - 1] for w in run if w): n for run, n in zip(runs.tolist(), counts.tolist())}
    assert got == want and list(got) == sorted(got)
