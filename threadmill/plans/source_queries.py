"""Queries of parsers, discovery, the vault, ingest and sync, each with its SQL. Transcripts of every format
are made from the conversations and parsed back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import markdown
from threadmill.functions import text as X
from threadmill.operators import bm25
from threadmill.operators import filters as P
from threadmill.operators import sessions as S
from threadmill.plans import saved
from threadmill.plans.tables import FIRST_LINE_SQL, SESSIONS_SQL, sessions, table, turns
from threadmill.sources import transcripts as T
from threadmill.sources import vault
from threadmill.streaming import ingest
from threadmill.streaming.store import Store

C = F.col
def _ts() -> Column:
    return F.concat(F.lit("2024-01-01T00:"), F.lpad((C("turn") / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((C("turn") % 60).cast("string"), 2, "0"), F.lit("Z"))


def _sid() -> Column:
    return F.concat(F.lit("s"), "conv_id")


def _cwd() -> Column:
    return F.concat(F.lit("/w/proj"), C("conv_id") % 7)


def _j(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _s(**fields: Column | str) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _joined(rows: DataFrame, one: Column, sep: str) -> DataFrame:
    """(conv_id, body): the JSON of each turn in order."""
    g = rows.select("conv_id", F.struct("turn", one.alias("j")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.select("conv_id", F.array_join(F.transform("x", lambda x: x["j"]), sep).alias("body"))


def _event_log(c: DataFrame) -> DataFrame:
    """A: an assistant's turn is two events of one message, its thinking and its text with a tool call."""
    user = _j(type="user", timestamp=_ts(), sessionId=_sid(), cwd=_cwd(), message=_s(content=C("text")))
    mid = F.concat(F.lit("m"), "turn")
    thought = _j(type="assistant", timestamp=_ts(), message=_s(id=mid, model="x-1", content=F.array(_s(type="thinking", thinking="hm"))))
    said = _j(type="assistant", timestamp=_ts(), message=_s(id=mid, content=F.array(_s(type="text", text=C("text"), name=F.lit(None).cast("string"), input=F.lit(None).cast("struct<command:string>")), _s(type="tool_use", text=F.lit(None).cast("string"), name="Bash", input=_s(command=F.concat(F.lit("cargo test case"), C("turn").cast("string")))))))
    one = F.when(C("role") == "user", user).otherwise(F.concat(thought, F.lit("\n"), said))
    own = _joined(c.where("role != 'system'"), one, "\n")
    return own.select(F.concat(F.lit("/h/.claude/projects/p/"), _sid(), F.lit(".jsonl")).alias("path"), "body")


def _rollout(c: DataFrame) -> DataFrame:
    kind = F.when(C("role") == "user", "input_text").otherwise("output_text")
    one = _j(timestamp=_ts(), type="response_item", payload=_s(type="message", role=C("role"), content=F.array(_s(type=kind, text=C("text")))))
    own = _joined(c.where("role != 'system'"), one, "\n")
    head = _j(type="session_meta", payload=_s(id=_sid(), timestamp="2024-01-01T00:00:00Z", cwd=_cwd()))
    return own.select(F.concat(F.lit("/h/.codex/sessions/rollout-"), _sid(), F.lit(".jsonl")).alias("path"), F.concat(head, F.lit("\n"), "body").alias("body"))


def _messages(c: DataFrame) -> DataFrame:
    one = _j(timestamp=_ts(), type=F.when(C("role") == "user", "user").otherwise("gemini"), content=F.array(_s(text=C("text"))))
    own = _joined(c.where("role != 'system'"), one, ",")
    return own.select(F.concat(F.lit("/h/.gemini/tmp/h/chats/session-"), _sid(), F.lit(".json")).alias("path"), F.concat(F.lit('{"sessionId":"'), _sid(), F.lit('","messages":['), "body", F.lit("]}")).alias("body"))


def _web_export(c: DataFrame) -> DataFrame:
    one = _j(timestamp=_ts(), type=F.when(C("role") == "user", "user").when(C("role") == "assistant", "gemini").otherwise("note"), content=C("text"))
    return _joined(c, one, ",").select(F.concat(F.lit("/x/web-"), _sid(), F.lit(".json")).alias("path"), F.concat(F.lit('{"projectHash":"gemini-web","sessionId":"'), _sid(), F.lit('","messages":['), "body", F.lit("]}")).alias("body"))


def _chat_export(c: DataFrame) -> DataFrame:
    one = _j(sender=F.when(C("role") == "user", "human").otherwise(C("role")), created_at=_ts(), content=F.array(_s(type="text", text=C("text"))))
    return _joined(c, one, ",").select(F.concat(F.lit("/x/chat-"), _sid(), F.lit(".json")).alias("path"), F.concat(F.lit('[{"uuid":"'), _sid(), F.lit('","name":"My: chat","chat_messages":['), "body", F.lit("]}]")).alias("body"))


def _tree_export(c: DataFrame) -> DataFrame:
    """F: each turn hangs on the one before; every third has a sibling that isn't on the branch."""
    at, before = F.concat(F.lit("n"), "turn"), F.when(C("turn") > 0, F.concat(F.lit("n"), C("turn") - 1))
    message = lambda text: _s(author=_s(role=C("role")), content=_s(content_type="text", parts=F.array(text)), create_time=F.lit(1.7e9) + C("turn"))
    node = F.concat(F.lit('"'), at, F.lit('":'), _j(id=at, parent=before, message=message(C("text"))))
    other = F.when(C("turn") % 3 == 1, F.concat(F.lit(',"x'), C("turn").cast("string"), F.lit('":'), _j(id=F.concat(F.lit("x"), "turn"), parent=before, message=message(F.lit("old"))))).otherwise("")
    own = _joined(c, F.concat(node, other), ",").join(c.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")
    return own.select(F.concat(F.lit("/x/tree-"), _sid(), F.lit(".json")).alias("path"), F.concat(F.lit('[{"conversation_id":"'), _sid(), F.lit('","title":"T","create_time":1700000000.25,"current_node":"n'), C("last").cast("string"), F.lit('","mapping":{'), "body", F.lit("}}]")).alias("body"))


def _session_export(c: DataFrame) -> DataFrame:
    one = _j(info=_s(role=C("role"), time=_s(created=(C("turn") + 1700000000) * 1000)), parts=F.array(_s(type="text", text=C("text")), _s(type="step", text="no")))
    return _joined(c, one, ",").select(F.concat(F.lit("/x/run-"), _sid(), F.lit(".json")).alias("path"), F.concat(F.lit('{"info":{"id":"'), _sid(), F.lit('","directory":"/a/b"},"messages":['), "body", F.lit("]}")).alias("body"))


FORMATS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "claude-code": (_event_log, "role != 'system'"), "codex": (_rollout, "role != 'system'"), "gemini-cli": (_messages, "role != 'system'"), "gemini-web": (_web_export, "true"),
    "claude-ai": (_chat_export, "true"), "chatgpt": (_tree_export, "role != 'system'"), "opencode": (_session_export, "true"),
}


def _files(spark: SparkSession, sf: str, agent: str, where: str = "true") -> DataFrame:
    made = FORMATS[agent][0](table(spark, sf, "conversations").where(where))
    return made.select("path", C("body").cast("binary").alias("content"))


def _parser(name: str, agent: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        parsed = T.parse_all(_files(spark, sf, agent))
        rows = parsed.select(C("id").alias("session_id"), "agent", "project", F.explode("turns").alias("t"))
        return rows.select("session_id", "agent", "project", "t.turn_index", "t.role", F.sha2("t.content", 256).alias("sha"), F.coalesce("t.thinking", F.lit("")).alias("thinking"), F.array_join(F.transform("t.actions", lambda a: F.concat(a["name"], F.lit(" "), a["input_summary"])), ";").alias("tools"))

    query.__name__ = name
    return query


PARSERS = {f"s{n:02d}_{f}": (_parser(f"s{n:02d}_{f}", agent), agent) for n, f, agent in ((7, "event_log", "claude-code"), (9, "rollout", "codex"), (10, "messages", "gemini-cli"), (11, "web_export", "gemini-web"), (12, "chat_export", "claude-ai"), (13, "tree_export", "chatgpt"), (14, "session_export", "opencode"))}
PROJECTS = {"claude-code": "'proj' || (conv_id % 7)", "codex": "'proj' || (conv_id % 7)", "gemini-cli": "'h'", "claude-ai": "'My_ chat'", "chatgpt": "'T'", "opencode": "'b'"}


def _parser_sql(agent: str) -> str:
    extra = "case when role = 'assistant' then 'hm' else '' end as thinking, case when role = 'assistant' then 'Bash cargo test case' || turn else '' end as tools" if agent == "claude-code" else "'' as thinking, '' as tools"
    return f"select 's' || conv_id as session_id, '{agent}' as agent, {PROJECTS.get(agent, 'null::varchar')} as project, (row_number() over (partition by conv_id order by turn) - 1)::int as turn_index, role, sha256(text) as sha, {extra} from conversations where {FORMATS[agent][1]}"


def s01_detect(spark: SparkSession, sf: str) -> DataFrame:
    """The format of a file of each kind."""
    out = None
    for i, agent in enumerate(FORMATS):
        own = _files(spark, sf, agent, f"conv_id % 7 = {i}")
        out = own if out is None else out.union(own)
    return T.parse_all(out).select("id", "agent", C("error").isNull().alias("ok"))


def _tree(spark: SparkSession, sf: str) -> str:
    """A home folder with the files of three agents, and of subagents."""

    def make(path: str) -> None:
        own = None
        for i, agent in enumerate(("claude-code", "codex", "gemini-cli")):
            made = FORMATS[agent][0](table(spark, sf, "conversations").where(f"conv_id % 3 = {i}")).select(F.regexp_replace("path", "^/h/", "").alias("path"), C("body").alias("markdown"))
            own = made if own is None else own.union(made)
        sub = table(spark, sf, "conversations").where("conv_id % 4 = 0").select(F.concat(F.lit(".claude/projects/p/subagents/x"), "conv_id", F.lit(".jsonl")).alias("path"), F.lit("{}").alias("markdown")).distinct()
        vault.write(own.union(sub), path).count()

    return saved._folder(spark, sf, "home", make)


def _found(df: DataFrame, agent: str) -> DataFrame:
    return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.lit(agent).alias("agent"))


def s02_discover(spark: SparkSession, sf: str) -> DataFrame:
    return _found(T.discover(spark, _tree(spark, sf) + "/.claude", "claude-code"), "claude-code")


def s03_discover(spark: SparkSession, sf: str) -> DataFrame:
    return _found(T.discover(spark, _tree(spark, sf) + "/.codex", "codex"), "codex")


def s04_discover(spark: SparkSession, sf: str) -> DataFrame:
    return _found(T.discover(spark, _tree(spark, sf) + "/.gemini", "gemini-cli"), "gemini-cli")


def s06_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """A folder, a file, a session's id, and a path that isn't there."""
    home, out = _tree(spark, sf), None
    for target in (home + "/.codex", home + "/.claude/projects/p/s0.jsonl", "s0", "/no/such/file.jsonl"):
        own = _found(T.resolve(spark, target, home + "/.claude"), target.removeprefix(home))
        out = own if out is None else out.union(own)
    return out


def s16_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Why a session isn't a conversation of its own."""
    s = sessions(spark, sf).join(S.first_user_turn(turns(spark, sf)).select(C("session_id").alias("id"), C("content").alias("said")), "id", "left")
    cwd = F.when(C("conv_id") % 4 == 0, "/tmp/x").when(C("conv_id") % 4 == 1, "/private/var/folders/y").otherwise("/w")
    said = F.when(C("conv_id") % 5 == 0, F.concat(F.lit("  Summarize this session: "), F.coalesce("said", F.lit("")))).when(C("conv_id") % 5 == 1, F.concat(F.coalesce("said", F.lit("")), F.lit(" <!-- wiki run -->"))).otherwise(C("said"))
    return s.select("id", P.skip_reason(cwd, said, F.when(C("conv_id") % 9 == 0, 0).otherwise(C("turn_count")), C("conv_id") % 7 == 0, "Summarize this session", "<!-- wiki run -->").alias("reason"))


def _vault(spark: SparkSession, sf: str) -> str:
    make = lambda path: vault.write(markdown.render(sessions(spark, sf), turns(spark, sf)), path).count()
    return saved._folder(spark, sf, "vault", make)


def s20_vault(spark: SparkSession, sf: str) -> DataFrame:
    return vault.read(spark, _vault(spark, sf)).select("path")


def s21_reindex(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions read back from the vault."""
    return vault.reindex(vault.read(spark, _vault(spark, sf)))[0].select("id", "agent", "project", "start_time", C("turns").alias("turn_count"), "vault_path")


def s22_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that the vault has and the store lacks."""
    found, own = vault.reindex(vault.read(spark, _vault(spark, sf)))
    stored = sessions(spark, sf).where("conv_id % 3 != 0")
    have = turns(spark, sf).where("conv_id % 3 != 0 and turn_index < 2")
    return vault.missing_turns(found, own, stored, have)[1].select("session_id", "turn_index", "role")


def f18_body_summary(spark: SparkSession, sf: str) -> DataFrame:
    return vault.read(spark, _vault(spark, sf)).select(X.yaml_field(X.frontmatter(C("markdown")), "session_id").alias("id"), markdown.summary_of_body(C("markdown")).alias("summary"))


def f19_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of the frontmatter, with line ends of both kinds."""
    f = markdown.session_fields(C("markdown"))
    files = vault.read(spark, _vault(spark, sf)).select(F.when(F.length("path") % 2 == 0, F.replace("markdown", F.lit("\n"), F.lit("\r\n"))).otherwise(C("markdown")).alias("markdown"))
    return files.select(f["session_id"].alias("id"), f["agent"].alias("agent"), f["project"].alias("project"), f["date"].alias("date"), f["turns"].alias("turns"), f["summary"].alias("summary"), F.size(f["tags"]).alias("n_tags"), f["archived"].alias("archived"))


def f31_session_id(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.lit("---\nagent: codex\nsession_id: "), F.when(C("doc_id") % 2 == 0, F.concat(F.lit('"d'), "doc_id", F.lit('"'))).otherwise(F.concat(F.lit("d"), "doc_id")), F.lit("\n---\n"), "text")
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.yaml_field(X.frontmatter(F.when(C("doc_id") % 5 == 0, C("text")).otherwise(head)), "session_id").alias("session_id"))


def m03_sync_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows whose archive state or number of turns isn't the vault's."""
    found = sessions(spark, sf).select("id", (C("conv_id") % 5 == 0).alias("archived"), F.when(C("conv_id") % 5 == 0, C("start_time")).alias("archived_at"), (C("turn_count") + F.when(C("conv_id") % 8 == 0, 1).otherwise(0)).alias("turns"))
    stored = sessions(spark, sf).where("conv_id % 10 != 9").select("id", "is_archived", F.lit(None).cast("timestamp").alias("archived_at"), "turn_count")
    new, changed = vault.against(found, stored)
    return changed.select("id", "is_archived", "turn_count").union(new.select("id", F.lit(None).cast("boolean"), F.lit(None).cast("bigint")))


# ingest


def _store(spark: SparkSession, sf: str) -> Store:
    """A store that took up the first two turns of each conversation, and then all of them."""

    def make(path: str) -> None:
        store = Store(spark, path)
        rules = ingest.Rules(classify=[S.Rule("third", project="proj3")], skip_embedding=("third",), vault=path + "-vault")
        ingest.ingest_batch(store, _files(spark, sf, "claude-code", "turn < 2"), rules, token="first")
        ingest.ingest_batch(store, _files(spark, sf, "claude-code", "turn < 2"), rules, token="first")  # known by its token
        ingest.ingest_batch(store, _files(spark, sf, "claude-code"), rules)

    return Store(spark, saved._folder(spark, sf, "store", make))


def m11_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.sessions_of(_store(spark, sf)).select("id", "agent", "project", "turn_count", "session_type", "summary", F.array_join("tools_used", ",").alias("tools"))


def t01_turns(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.turns_of(_store(spark, sf)).select("session_id", "turn_index", "role", F.sha2("content", 256).alias("sha"))


def m11_log(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf).read("ingest_log").groupBy("action").agg(F.count("*").alias("n"))


def m11_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The index that ingest keeps: contents and tool calls of all turns."""
    return ingest.index_of(_store(spark, sf)).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def m11_search(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.scores(ingest.index_of(_store(spark, sf)), ["cargo", "test", "bash"]).select("session_id", "turn_index")


def m11_queue(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.pending_of(_store(spark, sf), "m").groupBy("session_id").agg(F.count_distinct("turn_index").alias("turns"))


def m10_transaction(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables that change together: the second change of one fails on its way, and leaves both."""
    import uuid

    from threadmill.storage import shared_dir

    store = Store(spark, f"{shared_dir(spark)}/threadmill-store-{uuid.uuid4().hex}")
    with store.transaction() as t:
        t.append("a", table(spark, sf, "nation").select("n_nationkey"))
        t.append("b", table(spark, sf, "region").select("r_regionkey"))
    with store.transaction() as t:
        t.append("a", table(spark, sf, "nation").select("n_nationkey"))
    try:
        with store.transaction() as t:
            t.replace("a", table(spark, sf, "nation").limit(0).select("n_nationkey"))
            raise RuntimeError("lost")
    except RuntimeError:
        pass
    return store.read("a").agg(F.count("*").alias("a")).crossJoin(store.read("b").agg(F.count("*").alias("b")))  # one row each


def t07_sync(spark: SparkSession, sf: str) -> DataFrame:
    """All phases of a sync into an empty store; then a second one, whose vault has what the first wrote."""
    import uuid

    from threadmill.storage import shared_dir

    root = f"{shared_dir(spark)}/threadmill-sync-{uuid.uuid4().hex}"
    store, rules, rows = Store(spark, root + "/store"), ingest.Rules(vault=root + "/vault"), []
    for run in (1, 2):
        told = ingest.run_phases(ingest.sync_phases(store, lambda: _files(spark, sf, "claude-code", "conv_id % 5 = 0"), rules))
        rows += [(run, i, p["phase"], p["outcome"]) for i, p in enumerate(told)]
    return spark.createDataFrame(rows, "run int, place int, phase string, outcome string")


def _q(f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> tuple[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return f.__name__, (f, sql)


S_ = "with " + SESSIONS_SQL
A = "select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as i from conversations where role != 'system'"
FILE = "case conv_id % 3 when 0 then 's' || conv_id || '.jsonl' when 1 then 'rollout-s' || conv_id || '.jsonl' else 'session-s' || conv_id || '.json' end"
INDEXED = "text || case when role = 'assistant' then chr(10) || chr(10) || '[Tool: Bash] cargo test case' || turn else '' end"


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from threadmill.plans.text_queries import WORDS_SQL

    found = dict([_q(f, _parser_sql(agent)) for f, agent in PARSERS.values()])
    agents = "['" + "', '".join(FORMATS) + "']"
    return found | dict([
        _q(s01_detect, f"select distinct 's' || conv_id as id, ({agents})[(conv_id % 7 + 1)::int] as agent, true as ok from conversations"),
        _q(s02_discover, f"select distinct {FILE} as file, 'claude-code' as agent from conversations where conv_id % 3 = 0"),
        _q(s03_discover, f"select distinct {FILE} as file, 'codex' as agent from conversations where conv_id % 3 = 1"),
        _q(s04_discover, f"select distinct {FILE} as file, 'gemini-cli' as agent from conversations where conv_id % 3 = 2"),
        _q(s06_resolve, f"select distinct {FILE} as file, '/.codex' as agent from conversations where conv_id % 3 = 1 union all select 's0.jsonl', '/.claude/projects/p/s0.jsonl' union all select 's0.jsonl', 's0' union all select 'file.jsonl', '/no/such/file.jsonl'"),
        _q(s16_noise, S_ + " select id, case when conv_id % 9 = 0 then 'no turns' when conv_id % 7 = 0 then 'sidechain' when conv_id % 4 < 2 then 'temporary folder' when conv_id % 5 = 0 then 'summary prompt' when conv_id % 5 = 1 then 'wiki invocation' end as reason from sessions"),
        _q(s20_vault, S_ + " select distinct 'raw/.sessions/' || strftime(start_time, '%Y-%m-%d') || '/' || agent || '_' || coalesce(project, 'unknown') || '_' || left(id, 8) || '.md' as path from sessions"),
        _q(s21_reindex, S_ + " select id, agent, project, start_time, turn_count::int as turn_count, 'raw/.sessions/' || strftime(start_time, '%Y-%m-%d') || '/' || agent || '_' || coalesce(project, 'unknown') || '_' || left(id, 8) || '.md' as vault_path from sessions"),
        _q(s22_missing, "select conv_id::varchar as session_id, turn::int as turn_index, role from conversations where (conv_id % 3 = 0 or turn >= 2)"),
        _q(f18_body_summary, S_ + " select id, summary from sessions"),
        _q(f19_frontmatter, S_ + " select id, agent, project, strftime(start_time, '%Y-%m-%d') as date, turn_count::int as turns, summary, 0 as n_tags, null::boolean as archived from sessions"),
        _q(f31_session_id, "select doc_id, case when doc_id % 5 != 0 then 'd' || doc_id end as session_id from documents"),
        _q(m03_sync_rows, S_ + " select id, case when conv_id % 10 != 9 then conv_id % 5 = 0 end as is_archived, case when conv_id % 10 != 9 then turn_count + case when conv_id % 8 = 0 then 1 else 0 end end as turn_count from sessions where conv_id % 10 = 9 or is_archived != (conv_id % 5 = 0) or conv_id % 8 = 0"),
        _q(m11_sessions, f"with t as ({A}), g as (select conv_id, count(*) as turn_count, " + FIRST_LINE_SQL.format("arg_min(text, turn) filter (role = 'user')") + " as line, count(*) filter (role = 'assistant') as n from t group by 1) select 's' || conv_id as id, 'claude-code' as agent, 'proj' || (conv_id % 7) as project, turn_count, case when conv_id % 7 = 3 then 'third' else 'interactive' end as session_type, case when length(line) > 80 then left(line, 80) || '...' else line end as summary, case when n > 0 then 'Bash' else '' end as tools from g"),
        _q(t01_turns, f"select 's' || conv_id as session_id, i::int as turn_index, role, sha256(text) as sha from ({A})"),
        _q(m11_log, f"with g as (select conv_id, count(*) filter (turn < 2) as a, count(*) as b from ({A}) group by 1) select 'new' as action, count(*) filter (a > 0) + count(*) filter (a = 0) as n from g union all select case when b > a + 10 and b > 2 * a then 'rebuild' when b > a then 'incremental' else 'skip' end, count(*) from g where a > 0 group by 1"),
        _q(m11_postings, f"select term, count(distinct (conv_id, turn)) as df, count(*) as cf from (select conv_id, turn, unnest(" + WORDS_SQL.format(INDEXED) + f") as term from ({A})) group by 1"),
        _q(m11_search, f"select 's' || conv_id as session_id, i::int as turn_index from ({A}) where role = 'assistant'"),
        _q(m11_queue, f"select 's' || conv_id as session_id, count(*) as turns from ({A}) where conv_id % 7 != 3 group by 1"),
        _q(m10_transaction, "select (select count(*) * 2 from nation) as a, (select count(*) from region) as b"),
        _q(t07_sync, "select r::int as run, (i - 1)::int as place, (['init', 'pull', 'reindex', 'ingest', 'wiki', 'graph', 'push'])[i] as phase, 'done' as outcome from range(1, 3) a(r), range(1, 8) b(i)"),
    ])


QUERIES = _queries()
