import io
import json
import time
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.functions import markdown
from threadmill.sources import transcripts as T
from threadmill.sources import vault
from threadmill.streaming import ingest
from threadmill.streaming.store import Conflict, Store


def lines(*events):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in events).encode()


EVENTS = [
    {"type": "user", "timestamp": "2026-01-01T10:00:00Z", "sessionId": "s1", "cwd": "/w/proj", "gitBranch": "main", "message": {"role": "user", "content": "Fix it"}},
    {"type": "assistant", "timestamp": "2026-01-01T10:00:01Z", "message": {"id": "m1", "model": "x-1", "content": [{"type": "thinking", "thinking": "hm"}], "usage": {"input_tokens": 10, "output_tokens": 5}}},
    {"type": "assistant", "timestamp": "2026-01-01T10:00:02Z", "message": {"id": "m1", "content": [{"type": "text", "text": "Look"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}], "usage": {"input_tokens": 10, "output_tokens": 7}}},
    "not json",
    {"type": "user", "timestamp": "2026-01-01T10:00:03Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "a.txt"}]}},
    {"type": "assistant", "timestamp": "2026-01-01T10:00:04Z", "message": {"id": "m2", "content": [{"type": "text", "text": "Done"}]}},
]


def test_event_log_merges_and_attaches():
    (s,) = T.parse_file("/x/.claude/projects/p/s1.jsonl", lines(*EVENTS))
    assert (s["id"], s["project"], s["model"], s["git_branch"]) == ("s1", "proj", "x-1", "main")
    assert [t["role"] for t in s["turns"]] == ["user", "assistant", "assistant"]
    t = s["turns"][1]
    assert t["thinking"] == "hm" and t["content"] == "Look" and t["tokens"]["output"] == 7
    assert t["actions"][0]["input_summary"] == "ls" and t["actions"][0]["output_summary"] == "a.txt"
    assert s["end_time"].second == 4


def test_event_log_errors_and_sidechains():
    assert T.parse_file("/.claude/projects/a.jsonl", b"")[0]["error"]
    (s,) = T.parse_file("/.claude/projects/journal.jsonl", lines({"type": "started"}))
    assert s["turns"] == [] and s["id"] == "journal"


def test_rollout():
    data = lines(
        {"type": "session_meta", "payload": {"id": "r1", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/a/b"}},
        {"timestamp": "2026-01-01T00:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "# AGENTS.md instructions for x"}]}},
        {"timestamp": "2026-01-01T00:00:02Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}},
        {"timestamp": "2026-01-01T00:00:03Z", "type": "response_item", "payload": {"type": "function_call", "name": "sh", "call_id": "c", "arguments": "{}"}},
        {"timestamp": "2026-01-01T00:00:04Z", "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "ok"}]}},
        {"timestamp": "2026-01-01T00:00:09Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "out"}},
    )
    (s,) = T.parse_file("/q/rollout-zz.jsonl", data)
    assert s["id"] == "r1" and [t["content"] for t in s["turns"]] == ["go", "ok"] and s["end_time"].second == 9
    assert s["turns"][0]["actions"][0]["output_summary"] == "out"
    assert T.parse_file("/q/rollout-e.jsonl", lines({"type": "session_meta", "payload": {"id": "r"}}))[0]["error"]


def test_messages_json():
    x = {"sessionId": "g", "startTime": "2026-01-01T00:00:00Z", "messages": [{"type": "user", "content": [{"text": "hi"}]}, {"type": "info", "content": "x"}, {"type": "gemini", "content": "", "model": "g-1", "thoughts": [{"description": "d"}], "toolCalls": [{"name": "f", "args": {"a": 1}, "result": [{"functionResponse": {"response": {"error": "no"}}}]}]}]}
    (s,) = T.parse_file("/h/session-1.json", json.dumps(x).encode())
    assert s["agent"] == "gemini-cli" and [t["role"] for t in s["turns"]] == ["user", "assistant"]
    assert s["turns"][1]["thinking"] == "d" and s["turns"][1]["actions"][0]["output_summary"] == "no"


def archive(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, x in files.items():
            z.writestr(name.replace("__", "."), json.dumps(x))
    return b.getvalue()


def test_web_archive_gives_all_sessions():
    mk = lambda i: {"projectHash": "gemini-web", "sessionId": i, "messages": [{"type": "user", "content": "q"}, {"type": "gemini", "content": "a", "model": "m" + i}]}
    found = T.parse_file("/x/e.zip", archive(a__json=mk("1"), b__json=mk("2")))
    assert [(s["id"], s["model"]) for s in found] == [("1", "m1"), ("2", "m2")]


def test_chat_export_cuts_by_bytes():
    c = {"uuid": "u", "name": "My: chat", "created_at": "2026-01-01T00:00:00Z", "chat_messages": [{"sender": "human", "text": "t", "content": [], "created_at": "2026-01-01T00:00:05Z", "attachments": [{"file_name": "f", "extracted_content": "é" * 2000}]}, {"sender": "assistant", "content": [{"type": "tool_result", "content": [{"text": "é" * 300}]}, {"type": "tool_use", "name": "web", "input": {"query": "q"}}], "created_at": "2026-01-01T00:00:06Z"}]}
    for data in (json.dumps([c]).encode(), archive(conversations__json=[c])):
        (s,) = T.parse_file("/x/conversations.json", data)
        assert s["project"] == "My_ chat" and s["turns"][0]["content"].count("é") == 1000 and s["turns"][1]["content"] == "é" * 250
        assert s["turns"][1]["actions"][0]["input_summary"] == "q"


def test_tree_export_walks_the_current_branch():
    node = lambda i, parent, role, text: {"id": i, "parent": parent, "message": {"author": {"role": role}, "content": {"content_type": "text", "parts": [text]}, "create_time": 1700000000.5}}
    m = {"r": {"id": "r", "parent": None, "message": None}, "a": node("a", "r", "user", "q"), "b": node("b", "a", "assistant", "old"), "c": node("c", "a", "tool", "new"), "s": node("s", "c", "system", "no")}
    c = {"conversation_id": "k", "title": "T", "create_time": 1700000000.25, "current_node": "s", "mapping": m}
    (s,) = T.parse_file("/x/conversations.json", json.dumps([c]).encode())
    assert [(t["role"], t["content"]) for t in s["turns"]] == [("user", "q"), ("system", "new")]
    assert s["start_time"].microsecond == 250000
    m["r"]["parent"] = "a"
    assert [x["content"]["parts"][0] for x in T.path_to_root(m, "c")] == ["q", "new"]


def test_session_export():
    x = {"info": {"id": "o", "directory": "/a/b", "time": {"created": 1700000000000}}, "messages": [{"info": {"role": "user", "time": {"created": 1700000000500}}, "parts": [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}]}, {"info": {"role": "assistant", "model": {"modelID": "m"}}, "parts": []}]}
    (s,) = T.parse_file("/x/o.json", json.dumps(x).encode())
    assert s["turns"][0]["content"] == "a\nb" and len(s["turns"]) == 1 and s["model"] == "m" and s["project"] == "b"


@given(st.binary(max_size=200))
def test_any_bytes_give_rows(data):
    assert all(set(s) == set(T.PARSED_SESSION.names) for s in T.parse_file("/x/f", data))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / ".claude" / "projects" / "p"
    d.mkdir(parents=True)
    (d / "s1.jsonl").write_bytes(lines(*EVENTS))
    (d / "bad.jsonl").write_bytes(b"\n")
    (d / "subagents").mkdir()
    (d / "subagents" / "x.jsonl").write_bytes(lines(*EVENTS))
    return tmp_path


def test_files_become_tables(spark, folder):
    parsed = T.parse_all(T.discover(spark, str(folder), "claude-code"))
    assert {(r.id, r.error is None) for r in parsed.collect()} == {("s1", True), (None, False)}
    turns = T.turns_of(parsed)
    assert [r.tool_names for r in turns.orderBy("turn_index").collect()] == [[], ["Bash"], []]
    assert T.find_session(T.find_files(spark, str(folder)), "s1").count() == 1
    spark.dataSource.register(T.TranscriptSource)
    assert spark.read.format("transcripts").load(str(folder)).where("error is null").select("id").collect() == [("s1",)]


def test_stream_ingests_like_batch_and_is_idempotent(spark, folder, tmp_path):
    batch = Store(spark, str(tmp_path / "b"))
    ingest.ingest_batch(batch, T.discover(spark, str(folder), "claude-code"))
    ingest.ingest_batch(batch, T.discover(spark, str(folder), "claude-code"))
    stream = Store(spark, str(tmp_path / "s"))
    ingest.ingest_stream(spark, str(folder / ".claude"), stream, str(tmp_path / "cp")).awaitTermination(120)
    pick = lambda s: ingest.turns_of(s).select("session_id", "turn_index", "content").orderBy("turn_index").collect()
    assert pick(batch) == pick(stream) and len(pick(batch)) == 3
    assert [r.action for r in batch.read("ingest_log").orderBy("at").collect()] == ["new", "skip"]
    p = folder / ".claude" / "projects" / "p" / "s1.jsonl"
    p.write_bytes(p.read_bytes() + b"\n" + lines({"type": "user", "timestamp": "2026-01-01T11:00:00Z", "message": {"content": "more"}}))
    ingest.ingest_batch(batch, T.discover(spark, str(folder), "claude-code"))
    assert len(pick(batch)) == 4 and ingest.sessions_of(batch).first().turn_count == 4


def test_job_states_stream(spark, tmp_path):
    src = tmp_path / "jobs"
    spark.createDataFrame([(1, 1, "started"), (1, 2, "running"), (1, 3, "completed"), (1, 4, "running"), (2, 1, "started")], "job_id bigint, seq bigint, status string").write.parquet(str(src))
    q = ingest.job_states(spark.readStream.schema("job_id bigint, seq bigint, status string").parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("jobs_out").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 120
    while spark.table("jobs_out").count() < 2 and time.time() < until:  # state timeouts keep such a query going
        time.sleep(0.5)
    q.stop()
    assert sorted(map(tuple, spark.table("jobs_out").collect())) == [(1, "completed", 4), (2, "started", 1)]


def test_vault_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("abcdefghij", "codex", "my proj", "Sum \"q\"", 3)], "id string, agent string, project string, summary string, turn_count int").withColumn("start_time", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    t = spark.createDataFrame([("abcdefghij", 0, "user", "Hello\nworld"), ("abcdefghij", 1, "user", "Again"), ("abcdefghij", 2, "assistant", "Yes")], "session_id string, turn_index int, role string, content string")
    assert vault.write(markdown.render(s, t), str(tmp_path)).count() == 1
    files = vault.read(spark, str(tmp_path))
    assert files.first().path == "raw/.sessions/2026-01-02/codex_my proj_abcdefgh.md"
    sessions, turns = vault.reindex(files)
    assert sorted(map(tuple, turns.select("turn_index", "role", "content").collect())) == [(0, "user", "Hello\nworld"), (1, "user", "Again"), (2, "assistant", "Yes")]
    row = sessions.first()
    assert (row.id, row.project, row.turns) == ("abcdefghij", "my proj", 3)
    new, todo = vault.missing_turns(sessions, turns, sessions.select("id"), turns.where("turn_index = 0"))
    assert new.count() == 0 and todo.count() == 2


def test_markdown_helpers(spark):
    zw = "\u200b"
    cases = {"a:: b `c:: d` ```\ne::\n```": f"a:{zw}: b `c:: d` ```\ne::\n```", "``` open:: x": "``` open:: x", "`a:: b": f"`a:{zw}: b", "`x\ny:: z`": f"`x\ny:{zw}: z`", "": "", "::" * 3: f":{zw}:" * 3, "x" * 200_000 + "::": "x" * 200_000 + f":{zw}:"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.e for r in df.select("t", markdown.escape_fields(F.col("t")).alias("e")).collect()} == cases
    assert markdown.insert_links("see abcd1234 and [[abcd1234]]", {"abcd1234": "s/abcd1234"}) == "see [[s/abcd1234|abcd1234]] and [[abcd1234]]"
    assert markdown.parse_frontmatter("---\r\na: 1\r\n---\r\nx") == {"a": 1} and markdown.parse_frontmatter("---\n: [\n---") == {}


def test_phases_stop_at_a_failure():
    def bad():
        raise RuntimeError("no")

    assert [p["outcome"] for p in ingest.run_phases([("a", lambda: 1), ("b", bad), ("c", lambda: 1)])] == ["done", "failed: no"]
    assert ingest.run_phases([("a", lambda: 1)], lambda: True)[0]["outcome"] == "cancelled"


def test_progress_is_told():
    events = []
    ingest.run_phases([("a", lambda: 3), ("b", lambda: 1)], told_to=lambda *e: events.append(e))
    assert events == [("a: done", 3), ("b: done", 1)]


@pytest.fixture
def logs(spark):
    return lambda *sessions: spark.createDataFrame([(f"/h/.claude/projects/p/{i}.jsonl", lines(*[{"type": "user" if k % 2 == 0 else "assistant", "timestamp": f"2026-01-01T10:00:{k:02d}Z", "sessionId": i, "cwd": "/w/p", "message": {"id": f"m{k}", "content": f"{i} word{k}" if k % 2 == 0 else [{"type": "text", "text": f"{i} word{k}"}]}} for k in range(n)])) for i, n in sessions], "path string, content binary")


def test_a_broken_run_leaves_all_tables_as_they_were(spark, tmp_path, logs, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    ingest.ingest_batch(store, logs(("a", 2), ("b", 3)))
    state = lambda: (sorted((r.id, r.turn_count) for r in ingest.sessions_of(store).collect()), ingest.turns_of(store).count(), ingest.index_of(store).postings.count(), ingest.pending_of(store, "m").count(), store.read("ingest_log").count())
    before = state()
    assert before[:2] == ([("a", 2), ("b", 3)], 5)
    for name in ("_publish",):
        with monkeypatch.context() as m:
            m.setattr(Store, name, lambda *a: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError, match="killed"):
                ingest.ingest_batch(store, logs(("a", 5), ("c", 2)))
        assert state() == before
    from threadmill.streaming import store as module

    real, n = module.Transaction._stage, [0]

    def dies(self, *args):
        n[0] += 1
        if n[0] == 3:
            raise OSError("killed")
        return real(self, *args)

    with monkeypatch.context() as m:
        m.setattr(module.Transaction, "_stage", dies)
        with pytest.raises(OSError, match="killed"):
            ingest.ingest_batch(store, logs(("a", 5), ("c", 2)))
    assert state() == before
    ingest.ingest_batch(store, logs(("a", 5), ("c", 2)), token="t")
    after = state()
    assert after[:2] == ([("a", 5), ("b", 3), ("c", 2)], 10)
    ingest.ingest_batch(store, logs(("a", 5), ("c", 2)), token="t")
    assert state() == after and store.vacuum() > 0 and state() == after
    ingest.compact(store)
    assert state() == after


def test_a_session_built_anew_counts_once(spark, tmp_path, logs):
    store = Store(spark, str(tmp_path / "s"))
    ingest.ingest_batch(store, logs(("a", 30), ("b", 2)))
    ingest.ingest_batch(store, logs(("a", 4)))  # shorter than what is stored: not one that has grown
    assert ingest.turns_of(store).where("session_id = 'a'").count() == 4 and ingest.turns_of(store).count() == 6
    assert ingest.index_of(store).docs.count() == 6 and ingest.index_of(store).postings.where("term = 'word20'").count() == 0
    from threadmill.operators import bm25

    assert bm25.scores(ingest.index_of(store), ["word1"]).count() == 2


def test_ingest_reads_no_turns(spark, tmp_path, logs, monkeypatch):
    """The cost of a batch doesn't depend on the turns that are stored."""
    store = Store(spark, str(tmp_path / "s"))
    ingest.ingest_batch(store, logs(("a", 2)))
    read = []
    real = Store.read
    monkeypatch.setattr(Store, "read", lambda self, name: read.append(name) or real(self, name))
    ingest.ingest_batch(store, logs(("a", 4), ("b", 2)))
    assert set(read) == {"sessions"}


def test_hook_vault_and_embedding_queue(spark, tmp_path, logs):
    script = tmp_path / "hook.sh"
    script.write_text(f'#!/bin/sh\necho "$SESSION_SESSION_ID $SESSION_TURNS $SESSION_AGENT" >> {tmp_path}/out\n[ "$SESSION_SESSION_ID" != b ]\n')
    script.chmod(0o755)
    from threadmill.operators import sessions as S
    from threadmill.operators import vectors as V

    rules = ingest.Rules(classify=[S.Rule("automated", pattern="^b")], vault=str(tmp_path / "v"), hook=str(script))
    store = Store(spark, str(tmp_path / "s"))
    ingest.ingest_batch(store, logs(("a", 2), ("b", 3)), rules)
    assert sorted((tmp_path / "out").read_text().split("\n")[:-1]) == ["a 2 claude-code", "b 3 claude-code"]
    assert {r.session_id: r.hook for r in store.read("ingest_log").collect()} == {"a": True, "b": False}
    assert vault.read(spark, str(tmp_path / "v")).count() == 2
    assert {r.session_id for r in ingest.pending_of(store, "m").collect()} == {"a"}
    assert ingest.embed_pending(store, V.hash_embedder(), "m") == 2 and ingest.pending_of(store, "m").count() == 0
    assert ingest.update_graph(store) > 0 and store.read("nodes").where("type = 'session'").count() == 2
    assert vault.run_hook("/no/such/script", {}) is False and vault.run_hook("/bin/sleep", {}) is False


def test_reindex_takes_up_vault_files(spark, tmp_path, logs):
    one, two = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "two"))
    rules = ingest.Rules(vault=str(tmp_path / "v"))
    ingest.ingest_batch(one, logs(("a", 2), ("b", 3)), rules)
    assert ingest.reindex(two, rules.vault) == 2 and ingest.reindex(two, rules.vault) == 0
    assert sorted((r.id, r.turn_count) for r in ingest.sessions_of(two).collect()) == [("a", 2), ("b", 3)]
    assert ingest.turns_of(two).count() == 5
    (md,) = (tmp_path / "v").rglob("*_a.md")
    md.write_text(md.read_text().replace("turns: 2", "turns: 7\narchived: true"))
    assert ingest.reindex(two, rules.vault) == 1
    assert {(r.id, r.turn_count, r.is_archived) for r in ingest.sessions_of(two).collect()} == {("a", 7, True), ("b", 3, False)}


def test_transactions_conflict_only_where_they_must(spark, tmp_path):
    store, row = Store(spark, str(tmp_path / "s")), spark.createDataFrame([(1,)], "x int")
    store.write("t", row)
    with store.transaction() as a, store.transaction() as b:
        a.append("t", row), b.append("t", row)
    assert store.read("t").count() == 3
    late = store.transaction()
    late.replace("t", row)
    store.append("t", row)
    with pytest.raises(Conflict):
        late.commit()
    store.append("t", spark.createDataFrame([(2, "new")], "x int, y string"))
    assert store.read("t").columns == ["x", "y"] and store.read("t").count() == 5
    store.append("e", row.limit(0))
    assert store.read("e").count() == 0 and not store.exists("none")


def test_sessions_of_many_files_share_a_frame():
    import pandas as pd

    file = lines({"type": "user", "timestamp": "2026-01-01T10:00:00Z", "sessionId": "a", "message": {"content": "hi"}})
    files = pd.DataFrame({"path": [f"/h/.claude/projects/p/{i}.jsonl" for i in range(2 * T.TOGETHER + 1)], "content": [file] * (2 * T.TOGETHER) + [b"\xff"]})
    found = list(T._frames(iter([files, files[:0], files[:3]])))
    assert [len(f) for f in found] == [T.TOGETHER, T.TOGETHER, 1, 3] and list(pd.concat(found[:3])["path"]) == list(files["path"])
    large = pd.DataFrame({"path": files["path"][:3], "content": [file + b"\n" * T.TOGETHER_BYTES] * 3})
    assert [len(f) for f in T._frames(iter([large]))] == [1, 1, 1]


def test_a_bucket_of_a_batch_is_one_file(spark, tmp_path, logs):
    """Whatever the number of tasks that make the rows."""
    store = Store(spark, str(tmp_path / "s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ingest.ingest_batch(store, logs(*[(f"x{i}", 3) for i in range(40)]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("postings", "docs", "queue"):
        assert len(list((tmp_path / "s" / name).rglob("*.parquet"))) == len(list((tmp_path / "s" / name).rglob("bucket=*"))) > 1
    assert ingest.index_of(store).postings.count() == 40 * 3 * 2
