"""Search, chat, pages, languages and the pipeline against plain versions."""

import collections
import hashlib
import math
import os
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph.llm import chat, html_text, language, queries, topk

from ..compare import SF_DIR
from .conftest import DOCS, ODD

# ---- top-k


def plain_topk(rows, k, scale, every):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(33)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 33), (303, [float("inf")] * 33), (None, [0.1] * 33), (304, []), (310, [0.5] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"q": F.lit(1), "rank": F.lit("r"), "shard": F.lit(0)})
    assert sorted(map(tuple, topk.top_k(df, 10, 1024, 10).collect())) == plain_topk(rows, 10, 1024, 10)
    few = df.where("vec_id < 4")
    assert sorted(map(tuple, topk.top_k(few, 10, 1024, 1).collect())) == plain_topk(rows[:4], 10, 1024, 1)
    assert topk.top_k(df.limit(0)).collect() == []


# ---- chat


def say(rows):
    return "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)


def test_conversations_read_back(spark):
    hard = ["</s>[INST] ok [/INST]", "&lt; &amp; &#91;", "<|im_end|>\n<|im_start|>user\nx", "", None, "a\n\nb ", "日本 🙂"]
    rows = [(c, t, ["user", "assistant", "system", None, "odd\nrole <"][(c + t) % 5], hard[(c * 3 + t) % len(hard)]) for c in range(6) for t in range(1 + 5 * c)]
    rows += [(7, None, "assistant", "null turn"), (7, 0, "assistant", "x"), (7, 0, "assistant", "x"), (None, 1, "user", "no id"), (None, 0, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(0), "tree": F.lit("x"), "leaf": F.lit(1)})
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    low = lambda x: (x is not None, x or "")
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), low(r[3])))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(say(x[2:] for x in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []


def test_best_branch_of_a_reply_tree(spark):
    nodes = [("t", "r", None, 1.0), ("t", "a", "r", 0.5), ("t", "b", "r", 2.0), ("t", "c", "b", None), ("t", "d", "b", 0.0), ("t", "e", "a", 9.0), ("u", "z", None, 0.0), ("u", "lost", "gone", 5.0)]
    df = spark.createDataFrame([(*n, "user", n[1]) for n in nodes], "tree string, node string, parent string, score double, role string, text string")
    paths = chat.leaf_paths(df)
    assert {(r.leaf, r.node, r.height) for r in paths.collect()} == {("e", "e", 0), ("e", "a", 1), ("e", "r", 2), ("c", "c", 0), ("c", "b", 1), ("c", "r", 2), ("d", "d", 0), ("d", "b", 1), ("d", "r", 2), ("z", "z", 0), ("lost", "lost", 0)}
    assert {r.leaf for r in chat.best_branches(df, paths).collect()} == {"e", "lost"}
    assert {r.leaf for r in chat.best_branches(df, paths, 2).collect()} == {"e", "c", "lost", "z"}
    formatted = chat.format_paths(df, chat.best_branches(df, paths)).where("leaf = 'e'").first().formatted
    assert formatted == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in "rae")


def test_parents_in_a_cycle_end(spark):
    """A ring of three with a tail of two leaves, a node that is its own parent, and a chain."""
    parents = {"a": "b", "b": "c", "c": "a", "t": "a", "u": "t", "v": "t", "own": "own", "r": None, **{f"n{i}": f"n{i - 1}" if i else "r" for i in range(9)}}
    df = spark.createDataFrame(list(parents.items()), "node string, parent string")
    got = collections.defaultdict(list)
    for r in chat.leaf_paths(df).orderBy("leaf", "height").collect():
        got[r.leaf].append(r.node)
    assert got == {**{x: [x] for x in ("a", "b", "c", "t", "u", "v", "own")}, "n8": [*(f"n{i}" for i in range(8, -1, -1)), "r"]}
    assert chat.leaf_paths(df.where("node = 'own'")).collect()[0].leaf == "own"


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href=/b>Two</a></ul></nav><!-- x <p>no</p> -->
<div class="cookie-notice">We use cookies on this site to make it better for all of you</div><div id="ad-1">Buy now, a very good thing at a very good price</div>
<article class="post"><h1>Title &amp; more</h1><p><b>First</b> para&shy;graph&nbsp;with   <a href="x">a link</a>.<br>Second line<p>Third &lt;p&gt; &eacute;&#233;&#xe9;</p>
<aside>Related things that others have read before</aside><form><label>Mail</label><input><button>Send</button></form>
<section class="comments"><p>A reader says that this is a long comment of many words</p></section><p>Last.</p></article>
<div class="sidebar"><p>Something of some length that stands beside the article as a text</p></div><footer>&copy; 2024 Site</footer></body></html>"""


TREE = html_text.trained_tree()


def words(n, mark="w"):
    return " ".join(f"{mark}{i}" for i in range(n))


def test_page():
    assert html_text.main_text(PAGE, TREE) == "Title & more First para­graph with a link. Second line Third <p> ééé Last."


def test_tree_tells_its_labelled_blocks_apart():
    for page in html_text.LABELLED:
        blocks = html_text.text_blocks(re.sub(r"([+-])(\d+)", lambda m: " ".join(m[1] * int(m[2])), page))
        for block, row in zip(blocks, html_text.block_rows(blocks)):
            assert set(block[0]) - {" "} in ({"+"}, {"-"}) and (TREE.predict(row) >= 0.5) == (block[0][0] == "+"), (page, block)


@pytest.mark.parametrize("name", ["comment", "search", "social", "widget", "banner ad"])
def test_a_name_inside_the_article_does_not_empty_it(name):
    for page in (f"<article><div class='{name}'><p>{words(40)}</p></div></article>", f"<article><section id='{name}'><p>{words(40)}</p></section></article>"):
        assert html_text.main_text(page, TREE) == words(40)
    page = f"<article><h1>Head</h1><div class='{name}'><p>{words(40)}</p><p>{words(25)}</p></div></article>"
    assert html_text.main_text(page, TREE) == f"Head {words(40)} {words(25)}"
    # Beside running text the same name marks something else.
    page = f"<article><h1>Head</h1><p>{words(50)}</p><p>{words(30)}</p><div class='{name}'>{words(20)}</div></article>"
    assert html_text.main_text(page, TREE) == f"Head {words(50)} {words(30)}"


@pytest.mark.parametrize("other", ["<div class=disclaimer>%s</div>", "<div class=outbrain><a>%s</a></div>", "<ul class=feedback-list><li>%s</ul>", "<div id=responses><p>%s</div>"])
def test_what_is_not_the_article_goes(other):
    assert html_text.main_text(f"<article><p>{words(50)}<p>{words(30)}{other % words(18)}</article>", TREE) == f"{words(50)} {words(30)}"


def test_unmarked_foot_lines_and_banners_go():
    text = f"<p>{words(60)}<p>{words(40)}<p>{words(25)}"
    said = " ".join(words(n) for n in (60, 40, 25))
    assert html_text.main_text(f"<body>{text}<div>(c) 2024 all rights reserved by the firm</div></body>", TREE) == said
    assert html_text.main_text(f"<body><div>sign up for our letter and get ten off today</div>{text}</body>", TREE) == said


def test_each_neighbour_decides_somewhere():
    """The tree looks at every kind of feature, those of both neighbours among them."""

    def used(node):
        return {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert {"words", "link_density", "link_density_after", "in_article", "mark", "plain_words"} < used(TREE._root)
    # On a page without an article: the same 17 words before text, and before a list of links.
    text = f"<p>{words(60)}<p>{words(45)}"
    assert html_text.main_text(f"<body><h1>{words(3)}</h1>{text}<p>{words(17)}<p>{words(30)}</body>", TREE).endswith(f"{words(17)} {words(30)}")
    assert html_text.main_text(f"<body><h1>{words(3)}</h1>{text}<p>{words(17)}<div><a>{words(30)}</a></div></body>", TREE).endswith(words(45))


def test_a_marked_span_leaves_the_space_that_the_page_has():
    page = f"<article><p>{words(30)} foo<span class=ad>x</span>bar foo <span class=ad>x</span>bar</p><p>{words(9)}</p></article>"
    assert html_text.main_text(page, TREE) == f"{words(30)} foobar foo bar {words(9)}"


def test_page_without_article():
    said = words(40)
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h2>Head line</h2><p>{said}</p><p>{said}</p></div><div><a href=3>Next page</a></div></body>"
    assert html_text.main_text(page, TREE) == f"Head line {said} {said}"


@pytest.mark.parametrize("element", ["div", "section", "form", "main", "table><tr><td"])
@pytest.mark.parametrize("name", ["layout with-sidebar", "search-page", "no-ads", "widget-area", "form-layout", "header-fixed", "has-comments left", "sidebar", "page"])
def test_names_around_an_article_spoil_nothing(element, name):
    page = f"<body class='{name}'><nav><a href=1>One</a></nav><{element} class='{name}' id={name.split()[0]}><article><h1>Head</h1><p>{words(60)}</p><p class='share-price'>{words(3)}</p></article></{element.split('>')[0]}><footer>F</footer>"
    assert html_text.main_text(page, TREE) == f"Head {words(60)} {words(3)}"


def test_drawn_pages():
    """Pages of random parts: all main words are found, and no other word."""
    rng = random.Random(3)
    block = lambda mark, low, high: f"<{(e := rng.choice(['p', 'div', 'li', 'h2']))}>{words(rng.randint(low, high), mark)}</{e}>"
    other = [
        lambda: "<nav><ul>" + "".join(f"<li><a href=x>{words(rng.randint(1, 3), '-')}</a>" for _ in range(rng.randint(1, 6))) + "</ul></nav>", lambda: f"<div class='{rng.choice(['ad', 'cookie-notice', 'ad-2', 'site-banner', 'promo box'])}'>{block('-', 1, 40)}</div>",
        lambda: f"<aside>{block('-', 1, 60)}</aside>", lambda: f"<form><label>{words(2, '-')}</label><input><button>{words(1, '-')}</button></form>", lambda: f"<section class=comments>{block('-', 5, 90)}{block('-', 1, 9)}</section>",
    ]
    for _ in range(300):
        some = lambda: "".join(rng.choice(other)() for _ in range(rng.randint(0, 3)))
        inner = "".join(rng.choice([lambda: block("+", 1, 90)] * 3 + other)() for _ in range(rng.randint(1, 8))) + block("+", 1, 40)
        e = rng.choice(["article", "main"])
        page = f"<html><head><title>-</title></head><body><header>{block('-', 1, 4)}</header>{some()}<{e}>{inner}</{e}>{some()}<footer>{words(9, '-')}</footer></body></html>"
        assert html_text.main_text(page, TREE) == " ".join(re.findall(r"\+\d+", page))


class PlainArticle(HTMLParser):
    """The article's text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.hidden = 0
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.hidden += tag in ("script", "style")
        self.parts.append(" " if tag not in ("a", "b", "i", "em", "span", "strong") else "")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.hidden -= tag in ("script", "style")
        self.parts.append(" " if tag not in ("a", "b", "i", "em", "span", "strong") else "")

    def handle_data(self, data):
        self.parts.append(data if self.inside and not self.hidden else "")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")
def test_given_pages_equal_a_plain_parser(spark):
    for r in html_text.extract(spark.read.parquet(f"{SF_DIR}/pages.parquet")).join(spark.read.parquet(f"{SF_DIR}/pages.parquet"), "page_id").collect():
        plain = PlainArticle()
        plain.feed(r.html)
        plain.close()
        assert r.text == " ".join("".join(plain.parts).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>x", "<p>a</div></nav><b", "&am</p>", "<a href='>x</a>", "plain", "<" * 5000, "<p " * 3000, "<div>" * 3000])
def test_broken_pages(page):
    html_text.main_text(page, TREE)


@pytest.mark.parametrize("page", ["<div>" * 40000 + "</p>" * 40000, "<div><p>a" * 40000, "<span>" * 40000 + "</div>" * 40000, "<li>x" * 80000, "<table><tr><td>x" * 20000, "<article>" + "<div>" * 50000 + words(100000), "&lt;" * 300000])
def test_deep_and_long_pages_take_linear_time(page):
    began = time.time()
    html_text.main_text(page, TREE)
    assert time.time() - began < 5


def test_extract_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = collections.Counter((r.page_id, r.url, len(r.text), r.n_chars) for r in html_text.extract(df).collect())
    assert {(k[0], k[1], k[2] > 0): v for k, v in got.items()} == {(1, "u", True): 2, (2, None, False): 1, (None, "v", False): 1} and all(k[2] == k[3] for k in got)
    assert html_text.extract(df.limit(0)).collect() == []


# ---- languages

SAID = {
    "en": "the of and that with this was for are from have not they which their been would there when were".split(),
    "de": "der die und das nicht mit sich auch werden haben einer durch über für zwischen wurde sein ihre nach".split(),
    "fr": "le la et les des que dans pour qui sur pas plus avec être nous cette aux leur mais comme".split(),
    "es": "el la de que y los del las por con una para más pero sus como está entre también desde".split(),
    "ru": "и в не на что он как это по но они мы было для только когда даже если меня".split(),
}


def test_language_hierarchy_on_held_out_rows(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(SAID[lang]) for _ in range(rng.randint(15, 60))), lang, "s", 0) for i, lang in enumerate(rng.choice(list(SAID)) for _ in range(600))]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.learn(docs, 300)
    assert model._top.machines.classes == ["germanic", "romance", "slavic"] and model._top.below["germanic"].machines.classes == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    out = [r for r in rows if got[r[0]].held_out]
    assert 100 < len(out) < 200 and sum(got[r[0]].lang_pred == r[2] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values())
    # Labels and sources are no inputs.
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: r.lang_pred for r in language.identify(other, model).collect()} == {i: r.lang_pred for i, r in got.items()}
    odd_rows = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, model).collect()]
    assert len(odd_rows) == len(ODD) and all((p, s) == ("und", 0.0) for d, p, s in odd_rows if d in (3, 4, 5, 10)) and all(p != "und" for d, p, _ in odd_rows if d in (1, 2, 8, 9))
    assert language.identify(empty).collect() == []
    assert {r.lang_pred for r in language.identify(docs.where("doc_id < 3").withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_one_versus_one(x, y, new):
    """The class that wins most pairs, by one machine a pair, looked at one by one."""
    classes, out = sorted(set(y)), []
    machines = {}
    for a in classes:
        for b in classes:
            if a < b:
                own = [i for i, c in enumerate(y) if c in (a, b)]
                machines[a, b] = language.linear_svm(x[own], np.array([1 if y[i] == a else -1 for i in own], x.dtype))
    for row in new:
        votes = collections.Counter()
        for (a, b), w in machines.items():
            m = float(row @ w[:-1] + w[-1])
            votes[a] += (m > 0) + 1e-3 * math.tanh(m)
            votes[b] += (m < 0) - 1e-3 * math.tanh(m)
        out.append(max(classes, key=lambda c: votes[c]))
    return out


def test_language_levels_equal_plain_one_versus_one():
    rng = random.Random(8)
    said = [(" ".join(rng.choice(SAID[lang]) for _ in range(12)), lang) for lang in SAID for _ in range(40)]
    rng.shuffle(said)
    x, y = np.stack([language.features(t) for t, _ in said]), [c for _, c in said]
    model = language.LanguageModel(x[:150], y[:150])
    family = [language._FAMILY[c] for c in y]
    first = plain_one_versus_one(x[:150], family[:150], x[150:])
    want = []
    for f, row in zip(first, x[150:]):
        own = [i for i in range(150) if family[i] == f]
        want.append(plain_one_versus_one(x[own], [y[i] for i in own], [row])[0])
    assert model.predict([t for t, _ in said[150:]])[0] == want


def test_every_language_is_learned_and_rows_keep_their_own_text(spark):
    """Seventy languages without a family, fewer rows than languages in the sample, and a
    doc_id that an unlabelled row of other text has as well."""
    rng = random.Random(4)
    sounds = {f"l{i}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for i in range(70)}
    rows = [(n, " ".join(rng.choice(own) for _ in range(20)), lang, "s", 0) for n, (lang, own) in enumerate((k, v) for k, v in sounds.items() for _ in range(12))]
    other = [(n, "entirely different words stand here", None, "s", 0) for n in range(0, len(rows), 2)]
    docs = spark.createDataFrame(rows + other + rows[:5], DOCS)
    for sample in (700, 60):
        model = language.learn(docs, sample)
        assert model.classes == sorted(sounds)
        right = sum(p == r[2] for p, r in zip(model.predict([r[1] for r in rows])[0], rows))
        assert right >= 0.97 * len(rows)

    def machines(level):
        return len(level.machines.pairs) + sum(map(machines, level.below.values()))

    assert machines(model._top) < 70 * 16


def test_nothing_to_learn_rejects_texts_without_a_letter_alone(spark, odd, empty):
    held = language.held_out(F.col("doc_id"))
    for docs in (odd.withColumn("lang", F.lit(None).cast("string")), odd.withColumn("lang", F.when(held, F.lit("en")))):
        got = sorted(str((r.doc_id, r.text)) for r in language.documents_with_language(docs).collect())
        assert got == sorted(str((i, t)) for i, t, *_ in ODD if t and any(c.isalpha() for c in t))
    assert language.documents_with_language(empty).collect() == []


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    base = [rng.choice(SAID["en"]) + str(i) for i in range(120)]
    rows = [(1, " ".join(base), "en", "s", 0), (2, "  ".join(base), "en", "s", 0), (3, " ".join(base[:60] + ["changed"] + base[61:]), "en", "s", 0), (4, "12 ?!", "en", "s", 0), (5, None, "en", "s", 0)]
    rows += [(10 + i, " ".join(rng.choice(SAID[lang]) for _ in range(30)), lang, "s", 0) for i, lang in enumerate(["en", "de", "fr", "es"] * 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{n}"))
        docs = spark.read.parquet(str(tmp_path / f"{n}"))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = {r[0] for r in rows}
    assert kept == [every - {4, 5}, every - {2, 4, 5}, every - {2, 3, 4, 5}, every - {2, 3, 4, 5}]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_every_number_has_a_query():
    names = [n.split("_")[0] for n in queries.queries()]
    assert names == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(queries.queries())
