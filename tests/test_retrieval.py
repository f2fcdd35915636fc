import json
import random

import pytest
from pyspark.sql import functions as F

from notegraph.config import SearchOptions
from notegraph.operators import answer, bm25, graph, retrieval, vectors

CHUNKS = [
    (1, "a.md", 0, None, "a", "a md", "alpha beta beta"), (2, "a.md", 1, None, "a", "a md", "beta gamma"), (3, "b.md", 0, "2024-01-05", "b beta", "b md", "delta"), (4, "c.md", 0, "2024-03-01", "c", "c md", "O'Brien said o brien"),
    (5, "d.md", 0, "2024-02-01", "d", "d md", "Café alpha"), (6, "e.md", 0, None, "e", "e md", "omega"), (7, "f.md", 0, None, "f", "f md", "psi"), (8, "g.md", 0, None, "g", "g md", "chi"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(CHUNKS, "chunk_id long, path string, ord int, d string, breadcrumb string, meta string, body string")
    return df.withColumn("date", F.col("d").cast("date")).drop("d").persist()


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, q string")


def test_bm25_phrase_folding_and_no_match(spark, chunks):
    got = bm25.bm25_topk(chunks, ask(spark, "o'brien", "cafe", "zzz ?"), 5).collect()
    assert [(r.query_id, r.chunk_id) for r in sorted(got)] == [(0, 4), (1, 5)]
    hits = bm25.occurrences(chunks, bm25.phrases(ask(spark, "o'brien"))).collect()
    assert [(h.chunk_id, h.tf_body) for h in hits] == [(4, 2)]


def test_bm25_prefers_weighted_columns(spark, chunks):
    got = bm25.bm25_topk(chunks, ask(spark, "beta"), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [3, 1, 2] and all(r.score > 0 for r in got)


def test_fusion_arithmetic(spark):
    lists = spark.createDataFrame([(0, "bm25", 1, 10), (0, "bm25", 2, 20), (0, "vector", 1, 20), (0, "vector", 3, 30)], "query_id long, retriever string, rank int, chunk_id long")
    got = {r.chunk_id: r for r in retrieval.fuse(lists, 60, {"bm25": 2.0}).collect()}
    assert got[20].score == pytest.approx(2 / 62 + 1 / 61) and (got[20].bm25_rank, got[20].vector_rank) == (2, 1)
    assert got[10].score == pytest.approx(2 / 61) and got[30].vector_rank == 3


def plain_walk(rows, vecs, top_k, per_note, dedupe):
    out = []
    for r in sorted(rows, key=lambda r: (-round(r[2], 9), r[3], r[4])):
        if len(out) >= top_k:
            break
        if sum(o[3] == r[3] for o in out) >= per_note:
            continue
        v = vecs.get(r[1])
        if v and any(o[1] in vecs and sum(a * b for a, b in zip(v, vecs[o[1]])) >= dedupe for o in out):
            continue
        out.append(r)
    return [r[1] for r in out]


def test_diverse_selection_equals_a_plain_walk(spark):
    rng = random.Random(5)
    rows, vecs = [], {}
    for q in range(12):
        for c in rng.sample(range(100), 30):
            rows.append((q, c, rng.choice([0.1, 0.2, 0.3, rng.random()]), f"n{c % 9}", c // 9))
    for c in range(0, 100, 1):
        if c % 7:
            angle = rng.choice([0.0, 0.1, 1.0, 2.0, 3.0])
            import math

            vecs[c] = [math.cos(angle), math.sin(angle)]
    cand = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, path string, ord int")
    v = spark.createDataFrame(list(vecs.items()), "chunk_id long, vec array<double>")
    got = retrieval.select_diverse(cand, v, 8, 2, 0.95).orderBy("query_id", "rank").collect()
    for q in range(12):
        assert [r.chunk_id for r in got if r.query_id == q] == plain_walk([r for r in rows if r[0] == q], vecs, 8, 2, 0.95)
    capped = retrieval.select_diverse(cand, v, 8, 2, 1.0).orderBy("query_id", "rank").collect()
    for q in range(12):
        assert [r.chunk_id for r in capped if r.query_id == q] == plain_walk([r for r in rows if r[0] == q], {}, 8, 2, 2)


def test_vector_topk_floor_ties_and_mixed_models(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "chunk_id long, vec array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    assert [r.chunk_id for r in vectors.vector_topk(v, q, 10).orderBy("rank").collect()] == [1, 2, 3]
    assert [r.chunk_id for r in vectors.vector_topk(v, q, 10, 0.5).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        vectors.check_dimensions(v.unionByName(spark.createDataFrame([(9, [1.0])], "chunk_id long, vec array<double>")))


def test_dates_filter_after_the_cut_and_drop_undated(spark, chunks):
    s = retrieval.Searcher(chunks)
    got = s.search(ask(spark, "alpha beta delta"), SearchOptions(use_vector=False, since="2024-01-31", until="2024-02-15")).collect()
    assert [r.path for r in got] == ["d.md"]


def test_context_leaves_hits_out(spark, chunks):
    hits = spark.createDataFrame([(0, 1, "a.md", 0)], "query_id long, chunk_id long, path string, ord int")
    assert [r.near_id for r in retrieval.neighbour_context(hits, chunks, 1).collect()] == [2]
    both = spark.createDataFrame([(0, 1, "a.md", 0), (0, 2, "a.md", 1)], "query_id long, chunk_id long, path string, ord int")
    assert retrieval.neighbour_context(both, chunks, 1).count() == 0


def test_search_attaches_context_and_cites_lines(spark):
    rows = [(i, "a.md", i, 10 * i + 3, None, "", "", body) for i, body in enumerate(["zero", "one alpha", "two", "three", "four alpha"])]
    own = spark.createDataFrame(rows, "chunk_id long, path string, ord int, start_line int, date date, breadcrumb string, meta string, body string")
    hits = retrieval.Searcher(own).search(ask(spark, "alpha"), SearchOptions(use_vector=False, neighbours=1))
    found = {r.chunk_id: [(c.ord, c.body) for c in r.context] for r in hits.collect()}
    assert found == {1: [(0, "zero"), (2, "two")], 4: [(3, "three")]}
    packed = {r.rank: r.body for r in answer.offers(hits, own, None).collect()}
    assert sorted(packed.values()) == ["four alpha\n\nthree", "one alpha\n\nzero\n\ntwo"]
    shown = [json.loads(r.json) for r in retrieval.hits_json(hits).collect()]
    assert {(h["citation"], h["line"], tuple(h["context"])) for h in shown} == {("a.md:13", 13, ("zero", "two")), ("a.md:43", 43, ("three",))}
    plain = retrieval.Searcher(own).search(ask(spark, "alpha"), SearchOptions(use_vector=False))
    assert all(json.loads(r.json)["context"] == [] for r in retrieval.hits_json(plain).collect())


def test_links_resolve_by_depth_name_alias_and_never_to_self(spark):
    notes = spark.createDataFrame([("x/WV.md", ["Virginia W"]), ("WV.md", []), ("y/z/Other.md", None), ("y/Self.md", ["me"])], "path string, aliases array<string>")
    links = spark.createDataFrame(
        [("q.md", "wv", "link"), ("WV.md", "wv", "link"), ("q.md", "no/such/OTHER.MD", "link"), ("q.md", " VIRGINIA w ", "embed"), ("y/Self.md", "me", "link"), ("q.md", "nothing", "link"), ("q.md", "x/wv.md", "link")],
        "src string, raw string, kind string",
    )
    got = {(r.src, r.raw): r.dst for r in graph.resolve_links(links, notes).collect()}
    assert got == {("q.md", "wv"): "WV.md", ("WV.md", "wv"): "x/WV.md", ("q.md", "no/such/OTHER.MD"): "y/z/Other.md", ("q.md", " VIRGINIA w "): "x/WV.md", ("y/Self.md", "me"): None, ("q.md", "nothing"): None, ("q.md", "x/wv.md"): "x/WV.md"}


def test_link_boost(spark):
    fused = spark.createDataFrame([(0, 1, 0.5, 1, None, "a"), (0, 2, 0.4, 2, None, "b"), (0, 3, 0.3, 3, None, "c")], "query_id long, chunk_id long, score double, bm25_rank int, vector_rank int, path string")
    links = spark.createDataFrame([("c", "a"), ("a", None)], "src string, dst string")
    got = {r.chunk_id: (round(r.score, 6), r.boosted) for r in retrieval.link_boost(fused, links, 0.5, 60, 1).collect()}
    assert got == {1: (0.5, False), 2: (0.4, False), 3: (round(0.3 + 0.5 / 61, 6), True)}


def many_chunks(spark, n=6000):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "b", "m", " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 25)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chunk_id long, breadcrumb string, meta string, body string").repartition(3)


def plain_bm25(rows, questions, n):
    """Every question against every chunk; phrases are tokens joined by an apostrophe."""
    import math

    tokens = {i: (b + " " + body + " " + m).split() for i, b, m, body in rows}
    bodies = {i: body.split() for i, _, _, body in rows}
    mean = sum(map(len, tokens.values())) / len(rows)
    out = {}
    for q, text in questions:
        scores = {}
        for term in dict.fromkeys(text.split()):
            own = term.split("'")
            tf = {i: sum(body[k : k + len(own)] == own for k in range(len(body))) for i, body in bodies.items()}
            tf = {i: x for i, x in tf.items() if x}
            idf = math.log((len(rows) - len(tf) + 0.5) / (len(tf) + 0.5))
            for i, x in tf.items():
                scores[i] = scores.get(i, 0) + (idf if idf > 0 else 1e-6) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean))
        out[q] = [i for i, _ in sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:n]]
    return out


def test_scores_past_the_bounds_equal_a_plain_search_in_one_pass_and_several(spark, monkeypatch):
    rows, chunks = many_chunks(spark)
    questions = [(0, "w0 w1 w59"), (1, "w40'w1 w2"), (2, "w0"), (3, " ".join(f"w{i}" for i in range(30))), (4, "nothing"), (5, "w1'w1 w0'w2'w0")]
    asked = spark.createDataFrame(questions, "query_id long, q string")
    want = {q: ids for q, ids in plain_bm25(rows, questions, 7).items() if ids}
    for limit in (bm25.PASS_TERMS, 9):
        monkeypatch.setattr(bm25, "PASS_TERMS", limit)
        got = {}
        for r in bm25.bm25_topk(chunks, asked, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want


def test_searches_send_no_chunk_through_a_shuffle(spark, monkeypatch):
    """Before a question's best are ranked, no posting, vector or chunk leaves its partition."""
    _, chunks = many_chunks(spark, 300)
    chunks = spark.createDataFrame(chunks.rdd, chunks.schema)
    seen = []
    for module in (bm25, vectors):
        monkeypatch.setattr(module, "ranked", lambda scores, n: seen.append(scores) or scores)
    bm25.bm25_topk(chunks, ask(spark, "w0 w5"), 3)
    v = chunks.selectExpr("chunk_id", "array(1D, double(chunk_id)) AS vec")
    vectors.vector_topk(v, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>"), 3)
    seen.append(retrieval.of_chunks(spark.createDataFrame([(0, 5)], "query_id long, chunk_id long"), chunks))
    assert len(seen) == 3 and not any("Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString() for df in seen)
