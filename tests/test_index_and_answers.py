import json
import random

import pytest
from pyspark.sql import functions as F

from notegraph.operators import answer, evaluate, maintain
from notegraph.sources import vault
from notegraph.streaming import think


def write(root, files):
    for name, content in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_scan_skips_and_normalises(spark, tmp_path):
    root = tmp_path / "vault"
    write(root, {"a/One.md": b"\xef\xbb\xbfx\r\ny\rz", "b/pic.png": b"1", "c/n.sync-conflict-2.md": "t", "Kestrel Cache.md": "k [[One]]"})
    rows = {r.path: r for r in vault.scan(spark, str(root)).collect()}
    assert {p: r.skip_reason for p, r in rows.items()} == {"a/One.md": None, "b/pic.png": "suffix", "c/n.sync-conflict-2.md": "conflict", "Kestrel Cache.md": None}
    assert rows["a/One.md"].text == "x\ny\nz"
    write(root, {"_hidden by spark.md": "u", ".obsidian/x.md": "no"})
    spark.dataSource.register(vault.VaultSource)
    assert sorted(r.path for r in spark.read.format("vault").load(str(root)).select("path").collect()) == ["Kestrel Cache.md", "_hidden by spark.md", "a/One.md", "b/pic.png", "c/n.sync-conflict-2.md"]
    with pytest.raises(ValueError):
        vault.assert_outside(str(root / "a" / "index"), str(root))
    vault.assert_outside(str(tmp_path / "index"), str(root))


def test_build_is_incremental_and_idempotent(spark, tmp_path):
    root = tmp_path / "vault"
    write(root, {"2024-01-02 One.md": "see [[Two]]", "Two.md": "---\naliases: [Second]\ndate: 3.4.2023\n---\nbody", "Three.md": "x"})
    index = maintain.Index(spark, str(tmp_path / "index"))
    status = lambda: {r.path: r.status for r in maintain.build(index, vault.notes(spark, str(root))).collect()}
    assert set(status().values()) == {"new"}
    assert [(r.src, r.dst) for r in index.table("links").collect()] == [("2024-01-02 One.md", "Two.md")]
    assert {(r.path, str(r.date), r.date_source) for r in index.table("notes").collect()} == {("2024-01-02 One.md", "2024-01-02", "filename"), ("Two.md", "2023-04-03", "frontmatter:date"), ("Three.md", "None", "")}
    assert set(status().values()) == {"same"}
    (root / "Three.md").unlink()
    write(root, {"Two.md": "changed", "Four.md": "[[Second]] [[One]]"})
    assert status() == {"2024-01-02 One.md": "same", "Two.md": "changed", "Three.md": "deleted", "Four.md": "new"}
    assert {r.path: r.body for r in index.table("chunks").collect()} == {"2024-01-02 One.md": "see Two", "Two.md": "changed", "Four.md": "Second One"}


def test_index_reports_search_and_vectors(spark, tmp_path):
    from notegraph.config import SearchOptions
    from notegraph.operators import retrieval, vectors

    root = tmp_path / "vault"
    write(root, {"2024-01-02 One.md": "alpha [[Two]] [[Nowhere]]", "Two.md": "beta gamma"})
    index = maintain.Index(spark, str(tmp_path / "index"))
    maintain.build(index, vault.notes(spark, str(root)))
    assert {r.name: r.n for r in index.stats().collect()} == {"notes": 2, "chunks": 2, "links": 2, "vectors": 0}
    counts, most, missing = index.links_report()
    assert tuple(counts.first()) == (2, 1, 1) and most.first().dst == "Two.md" and missing.first().raw == "Nowhere"
    assert {r.date_source: r.n for r in index.dates_report().collect()} == {"filename": 1, "": 1}
    assert [r.body for r in index.show("Two.md").collect()] == ["beta gamma"]
    chunks = index.searchable()
    pending = maintain.pending_vectors(chunks, spark.createDataFrame([], "text_hash string, model string"), "stub")
    made = vectors.embed_texts(pending, "stub", lambda texts: [[float("alpha" in t), float("beta" in t) * 2, 0.0] for t in texts], 1)
    own = chunks.join(made, "text_hash").select("chunk_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    asked = spark.createDataFrame([(0, "beta")], "query_id long, q string")
    hits = retrieval.Searcher(chunks, own, index.table("links")).search(asked, SearchOptions(min_score=0.5), spark.createDataFrame([(0, [0.0, 1.0, 0.0])], "query_id long, vec array<double>"))
    assert [(r.path, r.bm25_rank, r.vector_rank) for r in hits.collect()] == [("Two.md", 1, 1)]
    with pytest.raises(Exception):
        vectors.embed_texts(pending, "stub", lambda texts: [[1.0]] * 5).collect()


def test_a_build_keeps_vectors_and_writes_only_changes(spark, tmp_path):
    root = tmp_path / "vault"
    write(root, {"One.md": "# A\n\nalpha"})
    index = maintain.Index(spark, str(tmp_path / "index"))
    maintain.build(index, vault.notes(spark, str(root)))
    vectors = spark.createDataFrame([("h", "m", [1.0])], "text_hash string, model string, vec array<double>")
    index.write({t: index.table(t) for t in ("notes", "chunks", "links")} | {"vectors": vectors}, index.manifest()["config"], "m")
    before = index.manifest()
    maintain.build(index, vault.notes(spark, str(root)))
    assert index.manifest() == before
    write(root, {"Two.md": "beta"})
    maintain.build(index, vault.notes(spark, str(root)))
    assert index.manifest()["snapshot"] == before["snapshot"] + 1 and index.manifest()["model"] == "m"
    assert [tuple(r) for r in index.table("vectors").collect()] == [("h", "m", [1.0])]
    assert {r.path: r.start_line for r in index.searchable().collect()} == {r.path: r.start_line for r in index.table("chunks").collect()}


def small_index(spark, tmp_path, files):
    root = tmp_path / "vault"
    write(root, files)
    index = maintain.Index(spark, str(tmp_path / "index"), buckets=4, cells=3)
    maintain.build(index, vault.notes(spark, str(root)), root=str(root))
    return root, index


def test_a_changed_note_rewrites_its_bucket_alone(spark, tmp_path):
    root, index = small_index(spark, tmp_path, {f"n{i}.md": f"# T{i}\n\nword{i} shared [[n{(i + 1) % 12}]]" for i in range(12)})
    before = index.manifest()["files"]
    write(root, {"n3.md": "# T3\n\nother words [[n7]] [[late]]"})
    maintain.build(index, vault.notes(spark, str(root)))
    after = index.manifest()["files"]
    for name in index.WHOLE:
        assert len(set(after[name]) - set(before[name])) == 1 and len(set(before[name]) - set(after[name])) == 1, name
    assert {r.path: r.body for r in index.table("chunks").collect()}["n3.md"] == "# T3\n\nother words n7 late"
    # A new name changes what an old link means: the link's bucket is rewritten with it.
    write(root, {"late.md": "here at last"})
    maintain.build(index, vault.notes(spark, str(root)))
    assert {(r.raw, r.dst) for r in index.table("links").where("src = 'n3.md'").collect()} == {("n7", "n7.md"), ("late", "late.md")}
    row = index.table("notes").where("path = 'late.md'").first()
    assert row["size"] == 12 and row["mtime"] is not None and row["indexed_at"] is not None
    folders = lambda: {f"{p.parent.name}/{p.name}" for p in (tmp_path / "index").glob("notes/bucket=*/version=*")}
    assert len(folders()) > len(index.files("notes"))
    wanted = sorted(map(tuple, index.table("notes").select("path", "content_hash").collect()))
    assert index.expire(keep=1) > 0 and folders() == set(index.files("notes"))
    assert sorted(map(tuple, index.table("notes").select("path", "content_hash").collect())) == wanted
    with pytest.raises(ValueError):
        maintain.build(index, vault.notes(spark, str(root)), root=str(tmp_path))


def test_stored_postings_answer_as_the_chunks_do(spark, tmp_path):
    from notegraph.operators import bm25

    rng = random.Random(4)
    words = ["alpha", "beta", "o'brien", "café", "the", "the", "rare"]
    root, index = small_index(spark, tmp_path, {f"d/n{i}.md": f"---\ntags: [t{i % 3}]\n---\n" + " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for i in range(40)})
    write(root, {"d/n5.md": "o'brien rare rare", "d/n40.md": "cafe alpha"})
    (root / "d" / "n6.md").unlink()
    maintain.build(index, vault.notes(spark, str(root)))
    asked = spark.createDataFrame([(1, "alpha rare"), (2, "O'Brien's o'brien"), (3, "cafe café the"), (4, "nothing here"), (5, "t1 d beta")], "query_id long, q string")
    stored = bm25.bm25_topk(index.keywords(), asked, 7)
    fresh = bm25.bm25_topk(index.searchable(), asked, 7)
    rows = [sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in x.collect()) for x in (stored, fresh)]
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {1, 2, 3, 5}
    cells = {r[0] for r in asked.limit(1).select(F.explode(F.split("q", " ")).alias("t")).select(bm25.cell(F.col("t"), 3)).collect()}
    files = index.keywords().hits(spark.createDataFrame([("alpha",), ("rare",)], "token string")).inputFiles()
    assert {int(f.split("/cell=")[1].split("/")[0]) for f in files} <= {0, 1, 2} and len(cells) <= 2


class Provider:
    """Counts its calls in a file; fails on a text while the file ``broken`` is there."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, texts):
        import os
        import uuid

        if os.path.exists(f"{self.folder}/broken") and any("word3" in t for t in texts):
            raise RuntimeError("down")
        for t in texts:
            with open(f"{self.folder}/asked-{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return [[float(len(t)), 1.0] for t in texts]


def test_embedding_resumes_where_it_was_killed(spark, tmp_path):
    root, index = small_index(spark, tmp_path, {f"n{i}.md": f"word{i}" for i in range(12)})
    calls = tmp_path / "calls"
    calls.mkdir()
    asked = lambda: [f.read_text() for f in calls.glob("asked-*")]
    (calls / "broken").touch()
    with pytest.raises(Exception):
        index.embed("stub", Provider(calls), batch=2, commit_texts=2, retries=0)
    done = index.vectors().count()
    committed = {r.embed_text for r in index.table("chunks").join(index.vectors(), "text_hash").collect()}
    assert 0 <= done < 12
    (calls / "broken").unlink()
    first = asked()
    assert index.embed("stub", Provider(calls), batch=2, commit_texts=2) == 12 - done
    later = list(asked())
    for t in first:
        later.remove(t)
    assert not committed & set(later) and index.pending("stub").isEmpty()
    assert index.embed("stub", Provider(calls)) == 0 and index.manifest()["model"] == "stub"
    assert index.embed("other", Provider(calls), commit_texts=50) == 12 and index.vectors().count() == 24
    write(root, {"n0.md": "changed"})
    maintain.build(index, vault.notes(spark, str(root)))
    assert index.embed("other", Provider(calls)) == 1
    index.drop_vectors("other")
    assert index.vectors().count() == 12 and index.chunk_vectors("other").count() == 12


def test_kept_scores(spark, tmp_path):
    now = spark.createDataFrame([("m", 3, 0.5, 0.25)], "label string, n long, mrr double, r_at_1 double")
    evaluate.save(now, str(tmp_path / "scores"))
    later = evaluate.long_form(now.withColumn("mrr", F.lit(0.75)))
    assert [tuple(r) for r in evaluate.delta(later, evaluate.load(spark, str(tmp_path / "scores"))).collect()] == [("m", "mrr", 0.25)]


def test_another_schema_version_is_an_error(spark, tmp_path):
    (tmp_path / "manifest").mkdir()
    (tmp_path / "manifest" / "m.json").write_text(json.dumps({"snapshot": 0, "schema_version": 99, "config": "", "model": ""}))
    with pytest.raises(ValueError):
        maintain.Index(spark, str(tmp_path)).manifest()


def test_cases(spark, tmp_path):
    f = tmp_path / "cases.jsonl"
    f.write_text('# comment\n\n{"q": "who", "expect": ["a.md"], "why": "x"}\n{"q": "pin"}\n')
    assert [(r.q, r.expect) for r in vault.load_cases(spark, str(f)).collect()] == [("who", ["a.md"]), ("pin", [])]
    for text in ('{"q": "fine"}\n\n{"expect": []}\n', '# x\n{"q": "fine"}\n{"q": \n'):
        f.write_text(text)
        with pytest.raises(Exception, match="line 3 of .*cases.jsonl"):
            vault.load_cases(spark, str(f)).collect()


def test_vault_source_prunes_and_reports(spark, tmp_path, monkeypatch):
    root = tmp_path / "vault"
    write(root, {"_u/_x.md": "u", "top.MD": "t", ".obsidian/p.md": "no", "a/node_modules/n.md": "no", "a/b/c/deep.md": "d", "a/.hidden.md": "h", "a/pic.png": "p"})
    rows = {r.path: r for r in vault.scan(spark, str(root)).collect()}
    assert {p: r.skip_reason for p, r in rows.items()} == {"_u/_x.md": None, "top.MD": None, "a/b/c/deep.md": None, "a/.hidden.md": "hidden", "a/pic.png": "suffix"}
    assert rows["a/b/c/deep.md"].text == "d" and rows["top.MD"]["size"] == 1 and rows["a/pic.png"].content_hash is None

    class Away:
        st_file_attributes = vault.RECALL_ON_DATA_ACCESS | 0x20

    assert vault.is_placeholder(Away()) and not vault.is_placeholder((root / "top.MD").stat())
    walked = [vault._VaultReader(str(root), {"node_modules"}, True, (".md",)).read(p) for p in vault._VaultReader(str(root), {"node_modules"}, True, (".md",)).partitions()]
    assert len(walked) == 3  # the root's own files, and a task for each folder that is entered
    monkeypatch.setattr(vault, "is_placeholder", lambda status: True)
    (path, *_, away, content), = vault._VaultReader(str(root), set(), True, (".md",)).read(vault._Folder(str(root / "_u"), True))
    assert path == "_u/_x.md" and away and content is None


def test_links_to_a_popular_name_are_dealt_over_copies(spark):
    from notegraph.operators import graph

    notes = spark.createDataFrame([("a/hub.md", ["Hub"]), ("z/y/hub.md", []), *((f"n{i}.md", []) for i in range(30))], "path string, aliases array<string>")
    links = [(f"n{i}.md", "HUB", "link") for i in range(30)] + [("a/hub.md", "hub", "link"), ("n1.md", "n2", "embed"), ("n1.md", "none", "link")]
    got = graph.resolve_links(spark.createDataFrame(links, "src string, raw string, kind string"), notes, per_copy=4)
    want = {(s, {"HUB": "a/hub.md", "hub": "z/y/hub.md", "n2": "n2.md", "none": None}[r], r, k) for s, r, k in links}
    assert set(map(tuple, got.collect())) == want and got.count() == len(links)
    # Without coalescing and broadcasts, as at a size where neither happens.
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = graph.resolve_links(spark.createDataFrame(links, "src string, raw string, kind string"), notes, per_copy=4)
        most = got.where("raw = 'HUB'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most < 15


def plain_gather(offered, budget):
    used, dropped, out, open_ = 0, 0, [], None
    for rank, part, path, kind, body in sorted(offered):
        if part and (open_ != rank or any(o[0] == path for o in out)):
            continue
        cost = int(len(body) / 3.5) + 1 + 8
        if used + cost > budget:
            dropped += 1
            continue
        used += cost
        open_ = open_ if part else rank
        out.append((path, kind))
    return out, dropped


def test_pack_sources_equals_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(q, rank, part, f"n{rng.randint(0, 6)}", "hit" if not part else "transclusion", "x" * rng.randint(1, 400)) for q in range(20) for rank in range(1, 7) for part in range(rng.randint(1, 3))]
    got = answer.pack_sources(spark.createDataFrame(rows, "query_id long, rank long, part int, path string, kind string, body string"), 250).orderBy("query_id", "n").collect()
    for q in range(20):
        want, dropped = plain_gather([r[1:] for r in rows if r[0] == q], 250)
        mine = [r for r in got if r.query_id == q]
        assert [(r.path, r.kind) for r in mine] == want and [r.n for r in mine] == list(range(1, len(want) + 1)) and all(r.dropped == dropped for r in mine)


def test_excerpts_stop_at_the_first_overflow(spark):
    c = spark.createDataFrame([("a", 0, "x" * 30), ("a", 1, "y" * 5), ("a", 2, "z" * 50), ("a", 3, "w"), ("b", 0, "v" * 99)], "path string, ord int, body string")
    assert {r.path: r.excerpt for r in answer.excerpts(c, 40).collect()} == {"a": "x" * 30 + "\n\n" + "y" * 5, "b": "v" * 40}


def test_citations_and_budget(spark):
    df = spark.createDataFrame([("a [2] b [1][2] [9] [1234] [0]", 3), ("none", 3)], "t string, n int")
    cited, bogus = answer.check_citations(F.col("t"), F.col("n"))
    assert [tuple(r) for r in df.select(cited, bogus).collect()] == [([1, 2], [0, 9]), ([], [])]
    b = [r[0] for r in spark.createDataFrame([(0,), (None,), (8192,), (1000,)], "n int").select(answer.context_budget(F.col("n"))).collect()]
    assert b[0] == b[1] == b[2] and b[3] == 256


THINK = ["a<think>b</think>c", "a<think>b", "<think></think>", "a <thin b", "x</think>y", "<think>a</think><think>b</think>z", "tail<thi", "<think>x</thinkk></think>q"]


def test_think_filter_on_texts_and_any_cut(spark):
    df = spark.createDataFrame([(t,) for t in THINK], "t string")
    want = ["ac", "a", "", "a <thin b", "x</think>y", "z", "tail<thi", "q"]
    assert [r[0] for r in df.select(answer.visible(F.col("t"))).collect()] == want
    for t, w in zip(THINK, want):
        for size in (1, 2, 3, 5):
            buffer, inside, out = "", False, ""
            for i in range(0, len(t), size):
                shown, buffer, inside = think.visible_part(buffer + t[i : i + size], inside)
                out += shown
            assert out + ("" if inside else buffer) == w


def test_think_stream_keeps_state_across_batches(spark, tmp_path):
    source, rows = tmp_path / "in", []
    for s, t in enumerate(THINK):
        parts = [t[i : i + 3] for i in range(0, len(t), 3)]
        rows += [(str(s), i, p, i == len(parts) - 1) for i, p in enumerate(parts)]
    schema = "session string, seq long, piece string, is_last boolean"
    for half in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] >= 2) == bool(half)], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        q = think.think_filter(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("session", "seq").collect():
        got[r.session] = got.get(r.session, "") + r.visible
    assert [got[str(i)] for i in range(len(THINK))] == ["ac", "a", "", "a <thin b", "x</think>y", "z", "tail<thi", "q"]


def test_sse_lines(spark):
    piece = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    rows = [("s", 0, piece("a")), ("s", 1, ": ping"), ("s", 2, "data: {bad"), ("s", 3, piece("b")), ("s", 4, "data: [DONE]"), ("s", 5, piece("c"))]
    assert [r.piece for r in answer.sse_pieces(spark.createDataFrame(rows, "session string, seq long, line string")).orderBy("seq").collect()] == ["a", "b"]


def test_answers_are_asked_only_with_sources(spark):
    q = spark.createDataFrame([(1, "who?"), (2, "what?")], "query_id long, q string")
    s = spark.createDataFrame([(1, 1, "[1] x\nbody")], "query_id long, n long, rendered string")
    s = s.withColumn("dropped", F.lit(2))
    answers = answer.answer(answer.prompts(s, q), s, lambda system, user: "<think>hm</think>It is x [1][4]." if "who?" in user else "no")
    got = sorted((r.query_id, r.text, r.n_sources, r.cited, r.bogus, r.warnings) for r in answers.collect())
    assert got == [(1, "It is x [1][4].", 1, [1], [4], ["bogus", "dropped"]), (2, "", 0, [], [], [])]
    dry = answer.answer(answer.prompts(s, q), s, None).collect()
    assert sorted((r.query_id, r.text, r.n_sources) for r in dry) == [(1, "", 1), (2, "", 0)]


def test_uncited_sources_are_hidden_and_counted(spark):
    answers = spark.createDataFrame([(1, [2]), (2, [])], "query_id long, cited array<int>")
    sources = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")], "query_id long, n long, path string")
    assert [(r.query_id, r.n, r.path, r.hidden) for r in answer.listing(answers, sources).collect()] == [(1, 2, "b", 2)]
    assert sorted((r.query_id, r.n, r.is_cited, r.hidden) for r in answer.listing(answers, sources, True).collect()) == [(1, 1, False, 0), (1, 2, True, 0), (1, 3, False, 0), (2, 1, False, 0)]


def test_scores(spark):
    hits = spark.createDataFrame([("m", 1, 1, "x"), ("m", 1, 2, "a"), ("m", 2, 1, "b")], "label string, query_id long, rank int, path string")
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, path string")
    r = evaluate.scores(evaluate.first_ranks(hits, expected, ["m"])).first()
    assert (r.n, r.mrr, r.r_at_1, r.r_at_3) == (3, 0.5, 0.3333, 0.6667)


def test_an_index_without_a_column_is_an_error_until_a_full_build(spark, tmp_path):
    from notegraph.operators.maintain import Index, build

    index = Index(spark, str(tmp_path / "ix"), 2)
    found = spark.createDataFrame([("a.md", "# A\nalpha", "h")], "path string, text string, content_hash string")
    build(index, found)
    build(Index(spark, index.path, 2), found, full=True)
    written = max((tmp_path / "ix" / "manifest").glob("part-*"), key=lambda p: json.loads(p.read_text())["snapshot"])
    written.write_text(written.read_text().replace("date_source", "date_origin"))
    for crc in (tmp_path / "ix" / "manifest").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="lacks notes.date_source; rebuild"):
        build(index, found)
    build(index, found, full=True)
    assert index.table("notes").select("path", "date_source").collect() == [("a.md", "")] and build(index, found).where("status <> 'same'").isEmpty()


def test_verdict_needs_three_retrievers(spark):
    from notegraph.operators import evaluate

    rows = [("hybrid", 1, 0.5, 0.5), ("bm25 only", 1, 0.4, 0.4), ("vector only", 1, 0.3, 0.3)]
    table = spark.createDataFrame(rows, "label string, n int, mrr double, r_at_1 double")
    assert evaluate.verdict(table).first().verdict == "better" and evaluate.verdict(table.where("label <> 'vector only'")).count() == 0


def test_expected_notes_read_texts_once_and_send_none_through_a_shuffle(spark, tmp_path):
    from notegraph.plans import views

    docs = [(1, "x one two three extraordinary five six y", "en", "s", 0), (2, "one two three extraordinary five sixty", "en", "s", 0), (3, "one two  three extraordinary five six", "en", "s", 0), (4, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "one two three extraordinary five six"), (8, "two three"), (9, " two  three extraordinary five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = views.expected(spark, str(tmp_path))
    # One join with the passages, which are copied to every task; the texts are not fetched again.
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    assert sorted(map(tuple, found.collect())) == [(7, "s/en/1.md"), (7, "s/en/2.md"), (9, "s/en/3.md")]
