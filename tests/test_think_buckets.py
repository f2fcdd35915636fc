"""Sessions share groups of state."""

from notegraph.streaming import think


def test_sessions_share_groups_and_leave_no_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(think, "BUCKETS", 4)
    texts = [["a<think>b</think>c", "a<thi", "<think>x", "plain 日😀", "", "x</think>y<", "<think>a</think>b<think"][k % 7] + str(k % 3) * (k % 2) for k in range(60)] + ["null"]
    rows = [(None if t == "null" else f"s{k}", i, t[i : i + 2] or None, i + 2 >= len(t)) for k, t in enumerate(texts) for i in range(0, max(1, len(t)), 2)]
    schema = "session string, seq long, piece string, is_last boolean"
    for half in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] >= 4) == bool(half)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = think.think_filter(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        groups = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert 0 < groups <= 4  # unclosed reasoning is kept to the end
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("session", "seq").collect():
        got[r.session] = got.get(r.session, "") + r.visible
    want = {r.session: r.visible for r in think.visible_batch(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(want) == len(texts)
