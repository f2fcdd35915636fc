"""What small tables of large sessions leave on disk."""

import random

from pyspark.sql import functions as F

from notegraph.llm import components, near_dedup


def plans_of(monkeypatch, module, capsys):
    """The plans of all that ``module`` cuts from now on."""
    found, cut = [], module.cut

    def noted(df):
        capsys.readouterr()
        df.explain()
        found.append(capsys.readouterr().out)
        return cut(df)

    monkeypatch.setattr(module, "cut", noted)
    return found


def expected_components(links):
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in root}


def test_labels_of_a_small_graph_are_copied(spark, monkeypatch, capsys):
    rng = random.Random(7)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(links, "a long, b long").repartition(40)
        want = expected_components(links)
        plans = plans_of(monkeypatch, components, capsys)
        assert {r.node: r.component for r in components.connected_components(df).collect()} == want
        assert sum("BroadcastHashJoin" in p for p in plans) >= 2 and not any("SortMergeJoin" in p for p in plans)
        monkeypatch.setattr(components, "SMALL_ROWS", 10)  # a graph beyond the bound is joined by shuffles
        assert {r.node: r.component for r in components.connected_components(df).collect()} == want
        assert any("SortMergeJoin" in p for p in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_members_are_copied_to_the_sets(spark, monkeypatch, capsys):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:50] + [f"x{k}"] + words[50:]) for k in range(6)] + [" ".join(reversed(words)), "one two three four five six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = plans_of(monkeypatch, near_dedup, capsys)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 70).select("doc_id", F.col("component_id")).collect()}
        assert got == {**dict.fromkeys(range(6), 0), 6: 6, 7: 7}
        with_sets = [p for p in plans if "items" in p and "MapInArrow" in p and "Join" in p and "a#" in p]
        assert with_sets and not any("SortMergeJoin" in p for p in with_sets)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
