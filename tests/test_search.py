import math
import os
import re

import pytest
from pyspark.sql import functions as F

from threadmill.functions import text as X
from threadmill.model import SearchFilters
from threadmill.operators import bm25, fusion
from threadmill.operators import vectors as V
from threadmill.plans import saved


@pytest.fixture(scope="module")
def small(spark):
    turns = spark.createDataFrame([("a", 0, "apple banana apple"), ("a", 1, "banana cherry"), ("b", 0, "apple cherry pie"), ("c", 0, "x")], "session_id string, turn_index int, content string")
    sessions = spark.createDataFrame([("a", "p", "codex", False, 10, "interactive"), ("b", "q", "codex", True, 1, None), ("c", None, "chatgpt", False, 1, "automated")], "id string, project string, agent string, is_archived boolean, turn_count int, session_type string").withColumn("start_time", F.lit("2024-01-01").cast("timestamp"))
    return turns, sessions


def test_bm25_scores_by_hand(small):
    turns, _ = small
    got = {(r.session_id, r.turn_index): r.score for r in bm25.scores(bm25.build(turns), ["cherry"]).collect()}
    idf, avg = max(math.log((4 - 2 + 0.5) / 2.5), 1e-6), (3 + 2 + 3 + 0) / 4
    want = {k: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg)) for k, dl in ((("a", 1), 2), (("b", 0), 3))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_search_needs_all_terms_skips_archived_and_normalises(small):
    turns, sessions = small
    i = bm25.build(turns)
    assert [(r.session_id, r.turn_index, r.score) for r in bm25.search(i, turns, sessions, "apple banana", 5).collect()] == [("a", 0, 1.0)]
    both = bm25.search(i, turns, sessions, "cherry", 5, SearchFilters(include_archived=True)).collect()
    assert {r.session_id for r in both} == {"a", "b"} and max(r.score for r in both) == 1.0
    assert bm25.search(i, turns, sessions, "x", 5).count() == 0
    none = turns.select("session_id").limit(0)
    assert bm25.search(i, turns, sessions, "banana", 5, SearchFilters(allowlist=none)).count() == 0


def test_saved_index_reads_its_buckets(spark, small, tmp_path):
    turns, _ = small
    i = bm25.build(turns)
    bm25.save(i, str(tmp_path / "i"))
    j = bm25.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, bm25.scores(j, ["apple", "pie"], "or").collect())) == sorted(map(tuple, bm25.scores(i, ["apple", "pie"], "or").collect()))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", bm25.hits(j, ["apple"])._jdf.queryExecution().toString())


def test_terms_are_counted_without_a_shuffle_where_keys_are_unique(spark, small, tmp_path):
    turns = small[0].union(spark.createDataFrame([("d", 0, ""), ("d", 1, None), ("d", 2, "b! bb BB bb aa"), (None, 3, "zz zz")], small[0].schema))
    apart, one = bm25.build(turns), bm25.build(turns, unique=True)
    assert not bm25.keys_repeat(turns) and bm25.keys_repeat(turns.union(turns.limit(1)))
    assert one.postings.schema.simpleString() == apart.postings.schema.simpleString()
    assert sorted(map(str, one.postings.collect())) == sorted(map(str, apart.postings.collect())) and one.docs.count() == 8
    assert "Exchange" not in one.postings._jdf.queryExecution().toString()
    bm25.save(one, str(tmp_path / "i"))
    assert sorted(map(str, bm25.scores(bm25.load(spark, str(tmp_path / "i")), ["bb", "apple"], "or").collect())) == sorted(map(str, bm25.scores(apart, ["bb", "apple"], "or").collect()))


def test_postings_are_shuffled_by_turn_and_bucket(spark, tmp_path, monkeypatch):
    """Keys go with a turn's words of a bucket, and a task's words are bounded, whatever the corpus."""
    rows = [(f"s{i % 3}", i, " ".join(["the", "the"] + [f"w{i * j % 700}" for j in range(300)])) for i in range(40)]
    rows += [("d", 0, ""), ("d", 1, None), (None, 3, "zz ZZ zz"), ("d", 4, "\u00e9\u00e9 \u65e5\u672c \u65e5\u672c a\x00b \U0001f600\U0001f600")]
    turns = spark.createDataFrame(rows, "session_id string, turn_index int, content string")
    apart, one = bm25.build(turns), bm25.build(turns, unique=True)
    packed = bm25._packed(one.words, one.keys)
    assert packed.count() <= 42 * bm25.BUCKETS < apart.postings.count() and max(r["count"] for r in packed.groupBy(*one.keys).count().collect()) <= bm25.BUCKETS
    want = sorted(map(str, apart.postings.select("session_id", "turn_index", "dl", "term", "tf").collect()))
    for words, tasks in ((2_000_000, 1), (1_000, 13), (100, 128)):  # buckets share a task, or have four each
        monkeypatch.setattr(bm25, "TASK_WORDS", words)
        own = bm25._shuffled(one.words, one.keys, 12_100)
        assert own.rdd.getNumPartitions() == tasks
        bm25.save(one, str(tmp_path / f"{words}"))
        kept = bm25.load(spark, str(tmp_path / f"{words}"))
        assert kept.postings.where(kept.postings["bucket"] != bm25._bucket(kept.postings["term"])).isEmpty()
        assert sorted(map(str, kept.postings.select("session_id", "turn_index", "dl", "term", "tf").collect())) == want
        assert sorted(map(str, bm25.scores(kept, ["the", "w0"]).collect())) == sorted(map(str, bm25.scores(apart, ["the", "w0"]).collect()))
    common = bm25.hits(kept, ["the"])
    assert common.select(F.input_file_name()).distinct().count() > 1  # a term that all hold is written by several


def test_saved_tables_belong_to_their_folder(spark, tmp_path):
    """Folders whose files have the same names, sizes and times don't share what is saved."""
    states = set()
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "documents.parquet").write_text(name)
        os.utime(tmp_path / name / "documents.parquet", (0, 0))
        states |= {saved._state(spark, str(tmp_path / name)), saved._state(spark, f"file://{tmp_path / name}")}
    assert len(states) == 2


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0, 1.0, 1.0]


def test_rrf_ranks_what_both_lists_have_first(spark):
    mk = lambda ids: spark.createDataFrame([(i, 0, 1.0 - k / 10) for k, i in enumerate(ids)], "session_id string, turn_index int, score double")
    fused = fusion.rrf({"bm25": mk("ABC"), "vector": mk("BCD")})
    best = fused.orderBy(F.desc("score")).first()
    assert best.session_id == "B" and best.score == 1.0


def test_short_sessions_are_demoted(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.9)], "session_id string, turn_index int, score double")
    meta = spark.createDataFrame([("a", 1), ("b", 10)], "id string, turn_count int")
    assert fusion.with_penalty(s, meta).orderBy(F.desc("score")).first().session_id == "b"


def test_diversity_keeps_the_best_of_each(spark):
    s = spark.createDataFrame([("a", i, 1.0 - i / 10) for i in range(4)] + [("b", 0, 0.1)], "session_id string, turn_index int, score double")
    assert sorted((r.session_id, r.turn_index) for r in fusion.diversify(s, 2).collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_embedding_is_incremental_and_survives_bad_items(spark):
    turns = spark.createDataFrame([("a", 0, "x " * 900), ("a", 1, ""), ("b", 0, "bad")], "session_id string, turn_index int, content string")

    def embedder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return [[1.0, float(len(t))] for t in texts]

    chunks = V.chunks(turns)
    done = V.embed(chunks, embedder, "m")
    assert {(r.session_id, r.chunk_seq) for r in done.collect()} == {("a", 0), ("a", 1)}
    assert [(r.session_id, r.seq) for r in V.pending(chunks, done, "m").collect()] == [("b", 0)]


def test_insert_checks_the_size(spark):
    schema = "session_id string, turn_index int, chunk_seq int, model string, embedding array<float>"
    stored = spark.createDataFrame([("a", 0, 0, "m", [1.0, 2.0])], schema)
    assert V.insert_vectors(stored, spark.createDataFrame([("a", 0, 0, "m", [9.0, 9.0]), ("a", 1, 0, "m", [3.0, 4.0])], schema)).count() == 2
    with pytest.raises(Exception, match="size"):
        V.insert_vectors(stored, spark.createDataFrame([("b", 0, 0, "m", [1.0])], schema)).collect()


def test_vector_codec_and_pooling(spark):
    import struct

    df = spark.createDataFrame([(bytearray(struct.pack("<2f", 1.5, -2.0)),), (bytearray(b"abc"),)], "b binary")
    assert [r[0] for r in df.select(V.decode_floats(F.col("b"))).collect()] == [[1.5, -2.0], []]
    t = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert t.select(V.mean_pool(F.col("t"), F.col("m"))).first()[0] == pytest.approx([0.6, 0.8])


def test_text_edges(spark):
    df = spark.createDataFrame([("a" * 1850,), ("",), (None,), ("é" * 60,)], "t string")
    got = [r[0] for r in df.select(X.char_chunks(F.col("t"))).collect()]
    assert [len(c) for c in got[0]] == [1000, 1000] and got[1] == [""] and got[2] == []
    cut = [r[0] for r in df.select(X.truncate_bytes(F.col("t"), 11)).collect()]
    assert cut == ["a" * 11, "", None, "é" * 5]
    assert X.chunk_budget(512) == (500, 75) and X.chunk_budget(512, 9999) == (500, 75) and X.chunk_budget(512, 10) == (10, 9)
    assert X.query_tokens("A the, ofé-X") == ["the", "ofé"]
