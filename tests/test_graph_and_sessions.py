from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from threadmill.operators import filters as P
from threadmill.operators import graph as G
from threadmill.operators import sessions as S


def sessions(spark, *rows):
    return spark.createDataFrame(rows, "id string, project string, start string").withColumn("start_time", F.col("start").cast("timestamp"))


def same_project(df):
    return {(r.source[8:], r.target[8:]) for r in G.adjacency(df).where("relation = 'same_project'").collect()}


def test_a_session_in_the_middle_splits_the_link(spark):
    a, b, c = ("A", "p", "2026-01-01 01:00"), ("B", "p", "2026-01-02 01:00"), ("C", "p", "2026-01-03 01:00")
    assert same_project(sessions(spark, a, c)) == {("A", "C")}
    assert same_project(sessions(spark, a, b, c)) == {("A", "B"), ("B", "C")}


def test_duplicate_edges_are_stored_once(spark):
    e = spark.createDataFrame([("s", "p", "r", "EXTRACTED", 1.0), ("s", "a", "r", "EXTRACTED", 1.0), ("s", "p", "r", "LLM", 0.5)], G.__dict__.get("EDGE", "source string, target string, relation string, confidence string, weight double"))
    stored = G.upsert_edges(e.limit(0), e)
    assert stored.count() == 2 and stored.where("target = 'p'").first().confidence == "EXTRACTED"


def test_bfs_leaves_seeds_out_and_takes_the_least_hop(spark):
    e = spark.createDataFrame([("session:a", "session:b", "x"), ("session:b", "session:c", "x"), ("session:a", "session:c", "y"), ("session:c", "session:d", "x"), ("session:a", "project:p", "z"), ("session:q", "project:p", "z")], "source string, target string, relation string")
    seeds = spark.createDataFrame([("a",)], "session_id string")
    assert sorted(map(tuple, G.related_sessions(e, seeds, 9).collect())) == [("b", "x", 1), ("c", "y", 1), ("d", "x", 2)]
    assert "q" in {r.session_id for r in G.related_sessions(e, seeds, 2, via_hubs=True).collect()}


def test_a_walk_neither_writes_the_edges_again_nor_shuffles_them(spark):
    from threadmill.storage import hadoop, shared_dir

    e = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.concat(F.lit("session:"), "o_orderkey").alias("source"), F.concat(F.lit("project:"), "o_custkey").alias("target"), F.lit("r").alias("relation"))
    fs, at = hadoop(spark, shared_dir(spark))
    written = lambda: {f.getPath().getName() for f in fs.listStatus(at) if "-both-" in f.getPath().getName()}
    before = written()
    found = G.query(G.target_nodes(e), e, e.first().target, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert written() == before and found.count() > 0
    assert "LeftSemi" in plan and "SortMergeJoin" not in [line.split("[")[0].split()[-1] for line in plan.splitlines() if "LeftSemi" in line]


def test_graph_tables_are_made_distinct_as_numbers(spark, tmp_path):
    from threadmill.plans import tables

    spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, None), (None, 8)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 5, 7), (1, 5, 9), (2, 5, 7), (2, None, 7), (None, 5, None), (None, 5, None)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = tables.graph_edges(spark, str(tmp_path))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source" not in plan and plan.count("Exchange hashpartitioning") == 2
    s = lambda k: None if k is None else f"session:{k}"
    belongs = [(s(a), f"project:{b}" if b else None, "belongs_to") for a, b in ((1, 7), (2, 7), (3, None), (None, 8))]
    used = [(s(1), "tool:5", "uses_tool"), (s(2), "tool:5", "uses_tool"), (s(2), None, "uses_tool"), (None, "tool:5", "uses_tool"), (s(1), "agent:7", "by_agent"), (s(1), "agent:9", "by_agent"), (s(2), "agent:7", "by_agent"), (None, None, "by_agent")]
    assert sorted(map(str, map(tuple, edges.collect()))) == sorted(map(str, belongs + used))
    assert sorted(map(str, tables.graph_nodes(spark, str(tmp_path)).collect())) == sorted(map(str, G.target_nodes(edges).collect()))


def test_llm_answers(spark):
    ok = '{"edges":[{"relation":"fixes_bug","target_type":"issue","target_label":"1"},{"relation":"nope","target_type":"x","target_label":"y"},{"relation":"fixes_bug","target_type":"issue","target_label":""}]}'
    df = spark.createDataFrame([("a", ok), ("b", f"```json\n{ok}\n```"), ("c", "sorry"), ("d", None)], "session_id string, answer string")
    assert sorted((r.source, r.target, r.weight) for r in G.llm_edges(df).collect()) == [("session:a", "issue:1", 0.8), ("session:b", "issue:1", 0.8)]


@pytest.mark.parametrize(("agent", "parsed", "stored", "want"), [("codex", 30, 5, "rebuild"), ("codex", 6, 5, "incremental"), ("codex", 5, 5, "skip"), ("codex", 4, 5, "rebuild"), ("chatgpt", 5, 5, "rebuild"), ("claude-code", 15, 5, "incremental")])
def test_reingest_decisions(spark, agent, parsed, stored, want):
    assert spark.range(1).select(S.decide_reingest(F.lit(agent), F.lit(parsed), F.lit(stored))).first()[0] == want


def test_upsert_keeps_what_users_set(spark):
    schema = "id string, model string, turn_count int, tags array<string>, summary string"
    old = spark.createDataFrame([("a", "m", 1, ["mine"], "s"), ("z", None, 9, [], None)], schema)
    new = spark.createDataFrame([("a", None, 5, [], "other"), ("b", "n", 2, [], "t")], schema)
    got = {r.id: r for r in S.upsert(old, new).collect()}
    assert tuple(got["a"]) == ("a", "m", 5, ["mine"], "s") and got["b"].turn_count == 2 and got["z"].turn_count == 9


def test_rules(spark):
    with pytest.raises(ValueError):
        S.Rule("x")
    rules = [S.Rule("auto", pattern="^Run"), S.Rule("proj", project="p")]
    df = spark.createDataFrame([("Run it", "p"), ("x", "p"), (None, None)], "c string, p string")
    assert [r[0] for r in df.select(S.classify(rules, F.col("c"), F.col("p"))).collect()] == ["auto", "proj", "interactive"]


def test_budgets(spark):
    t = spark.createDataFrame([("s", i, "x" * 40) for i in range(5)], "session_id string, turn_index int, content string")
    assert [r.turn_index for r in S.budget_suffix(t, 100, "session_id", "turn_index", F.length("content")).orderBy("turn_index").collect()] == [3, 4]
    assert S.budget_prefix(t, 100, 1000).count() == 3


def test_temporal_words():
    now = datetime(2026, 1, 5, 9, tzinfo=UTC)
    assert P.temporal("Today", now).since.hour == 0 and P.temporal("yesterday", now).until == P.temporal("today", now).since
    assert P.temporal("since 2026-01-02", now).since.day == 2 and P.temporal("2026-01-02", now).since.day == 2 and P.temporal("someday", now) is None
    assert P.split_tags(["a,b", " c "]) == ["a", "b", "c"]
    assert P.date_range("week", datetime(2026, 1, 7))[0].day == 5
