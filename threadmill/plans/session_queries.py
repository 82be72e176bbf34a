"""Queries of filters, joins, aggregates, windows and maintenance, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import markdown
from threadmill.functions import text as X
from threadmill.model import ListFilter, SearchFilters
from threadmill.operators import filters as P
from threadmill.operators import bm25
from threadmill.operators import lint as N
from threadmill.operators import sessions as S
from threadmill.plans.tables import SESSIONS_SQL, TURNS_SQL, VECTORS_SQL, bytes_sql, sessions, table, turns, vectors

C = F.col
NOW = datetime(2024, 1, 5, 12)


def p01_search_pred(spark: SparkSession, sf: str) -> DataFrame:
    allow = table(spark, sf, "embeddings").select((C("vec_id") % 90).cast("string").alias("session_id")).distinct()
    f = SearchFilters(since=datetime(2024, 1, 1, 5), until=datetime(2024, 1, 4), exclude_session_types=("automated",), allowlist=allow)
    return P.search_predicate(sessions(spark, sf), f).select("id", "session_type")


def p02_vector_pred(spark: SparkSession, sf: str) -> DataFrame:
    return P.search_predicate(sessions(spark, sf), SearchFilters(project="proj3", agent="codex", include_archived=True)).select("id")


def p04_temporal(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for word in ("today", "yesterday", "last week", "since 2024-01-02"):
        own = P.search_predicate(sessions(spark, sf), P.temporal(word, NOW)).select(F.lit(word).alias("word"), "id")
        out = own if out is None else out.union(own)
    return out


def p06_list(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).where(P.list_predicate(ListFilter(tags=("even",), q="E", include_archived=True))).select("id")


def p06_list_tags(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).where(P.list_predicate(ListFilter(tags=("even", "three"), favorite=True, date_from=datetime(2024, 1, 1, 2)))).select("id")


def p08_daily(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).where(P.on_day("2024-01-02")).select("id", "start_time")


def p10_prefix(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf)
    return P.by_prefix(s, "1").withColumn("p", F.lit("1")).union(P.by_prefix(s, "19").withColumn("p", F.lit("19"))).union(P.by_prefix(s, "x").withColumn("p", F.lit("x")))


def p11_open(spark: SparkSession, sf: str) -> DataFrame:
    return P.is_open(sessions(spark, sf)).select("id")


def p12_rebuild_pick(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf)
    return P.rebuild_selection(s, retry_failed=True, since=NOW).select("id", F.lit("retry").alias("why")).union(P.rebuild_selection(s, since=datetime(2024, 1, 3)).select("id", F.lit("since").alias("why")))


def p13_noise(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).where(P.daily_noise(prefixes=("The", "Nicht", "An"))).select("id")


def p15_invalid_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = F.when(C("vec_id") % 7 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(C("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", X.valid_embedding(e).alias("ok"))


def p18_date_range(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in ("today", "week", "month", "all"):
        a, b = P.date_range(name, NOW)
        own = sessions(spark, sf)
        if a is not None:
            own = own.where((F.to_date("start_time") >= F.lit(a).cast("date")) & (F.to_date("start_time") <= F.lit(b).cast("date")))
        own = own.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.union(own)
    return out


def l03_page(spark: SparkSession, sf: str) -> DataFrame:
    rows, total = P.page(sessions(spark, sf), ListFilter(page=2, page_size=15))
    return rows.select("id", "start_time").crossJoin(F.broadcast(total))  # one row


def l08_recent_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts")


def l10_latest(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest(sessions(spark, sf))


def j01_inner(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).join(sessions(spark, sf).select(C("id").alias("session_id"), "agent", "project"), "session_id").select("session_id", "turn_index", "agent", "project")


def j02_left_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("event_id", C("user_id").cast("string").alias("id"), "ts")
    return log.join(sessions(spark, sf).select("id", "agent"), "id", "left").select("event_id", "id", F.coalesce("agent", F.lit("unknown")).alias("agent"), "ts").orderBy(F.desc("ts"), "event_id").limit(5)


def j03_first_user(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).select("id").join(S.first_user_turn(turns(spark, sf)).withColumnRenamed("session_id", "id"), "id", "left")


def j04_anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    return N.missing_embeddings(turns(spark, sf), vectors(spark, sf)).select("session_id")


def j05_anti_orphan(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors whose session isn't among those of three agents."""
    return N.orphan_vectors(vectors(spark, sf), sessions(spark, sf).where("conv_id % 4 != 2")).select("session_id", "detail")


def j06_semi_pair(spark: SparkSession, sf: str) -> DataFrame:
    wanted = vectors(spark, sf).select("session_id", "turn_index")
    return turns(spark, sf).join(wanted, ["session_id", "turn_index"], "left_semi").select("session_id", "turn_index", "content")


def j08_full_merge(spark: SparkSession, sf: str) -> DataFrame:
    a = turns(spark, sf).select("session_id", "turn_index", F.length("content").alias("left_score"))
    b = vectors(spark, sf).select("session_id", "turn_index", C("vec_id").alias("right_score"))
    return a.join(b, ["session_id", "turn_index"], "full")


def j14_prefix_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose id, of 8 characters at most, starts no session's id."""
    files = table(spark, sf, "events").select((C("user_id") + 40).cast("string").alias("file_id")).distinct().withColumn("path", C("file_id"))
    return N.orphan_files(files, sessions(spark, sf)).select(C("session_id").alias("file_id"))


def j17_tool_results(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    use, result = e.select(C("event_id").alias("tool_use_id"), "event_type"), e.select((C("event_id") * 2).alias("tool_use_id"), C("value").alias("output"))
    return use.join(result, "tool_use_id", "left")


def a02_status(spark: SparkSession, sf: str) -> DataFrame:
    return S.status(sessions(spark, sf), turns(spark, sf), vectors(spark, sf)).withColumn("coverage", F.round("coverage", 6))


def a03_distinct2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.count_distinct("l_suppkey", "l_returnflag").alias("n"))


def a05_agents(spark: SparkSession, sf: str) -> DataFrame:
    return S.agent_counts(sessions(spark, sf))


def a06_tags(spark: SparkSession, sf: str) -> DataFrame:
    return S.tag_counts(sessions(spark, sf))


def a07_roles(spark: SparkSession, sf: str) -> DataFrame:
    return S.role_histogram(turns(spark, sf))


def _tooled(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(C("l_suppkey").cast("string").alias("session_id"), F.array(F.concat(F.lit("tool"), C("l_partkey") % 40)).alias("tool_names"))


def a08_top8(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_tools(_tooled(spark, sf))


def a09_dups(spark: SparkSession, sf: str) -> DataFrame:
    return S.duplicate_ingests(table(spark, sf, "events").select(C("user_id").cast("string").alias("session_id"), F.when(C("event_type") == "click", "ingest").otherwise("other").alias("action")))


def a12_dedup(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").select(C("l_suppkey").alias("session_id"), C("l_linenumber").alias("turn_index"), F.lit(0).alias("chunk_seq"), C("l_returnflag").alias("model"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("vec_id"))
    return S.dedup_vectors(v).select("session_id", "turn_index", "model", "vec_id")


def a13_projects(spark: SparkSession, sf: str) -> DataFrame:
    return S.projects(sessions(spark, sf))


def a14_by_project(spark: SparkSession, sf: str) -> DataFrame:
    return S.by_project(sessions(spark, sf)).select("project", F.array_join(F.transform("entries", lambda x: x["id"]), ",").alias("ids"))


def a15_session_agg(spark: SparkSession, sf: str) -> DataFrame:
    tok = F.struct(F.length("content").cast("bigint").alias("input"), C("turn_index").cast("bigint").alias("output"))
    t = turns(spark, sf).withColumn("tokens", tok).withColumn("tool_names", F.array("role"))
    return S.session_aggregates(t).withColumn("tools_used", F.array_join("tools_used", ","))


def a17_max_norm(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", C("l_extendedprice").alias("score"))
    return bm25.normalize(scored, by="l_suppkey").select("l_orderkey", "l_linenumber", F.round("score", 9).alias("score"))


def w02_diversify(spark: SparkSession, sf: str) -> DataFrame:
    from threadmill.operators.fusion import diversify

    return diversify(table(spark, sf, "lineitem").select(C("l_suppkey").cast("string").alias("session_id"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("turn_index"), C("l_extendedprice").alias("score")))


def w05_role_runs(spark: SparkSession, sf: str) -> DataFrame:
    return S.role_runs(turns(spark, sf)).select("session_id", "turn_index", "starts", "run")


def w06_ffill(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).withColumn("role", F.when(C("turn_index") % 3 == 0, C("role")))
    return S.carry_forward(t, "role").select("session_id", "turn_index", "role")


def w07_merge_islands(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(C("user_id").alias("session_id"), "event_id", C("event_type").alias("msg"), C("value"))
    return S.merge_islands(e, "msg", "event_id", F.lit("v"), "session_id").select("session_id", "event_id", "msg", "merged", "n")


def w09_budget(spark: SparkSession, sf: str) -> DataFrame:
    return S.budget_suffix(turns(spark, sf), 1500, "session_id", "turn_index", F.length("content")).select("session_id", "turn_index", "used")


def w10_prefix_budget(spark: SparkSession, sf: str) -> DataFrame:
    return S.budget_prefix(turns(spark, sf)).select("session_id", "turn_index", "before", F.length("shown").alias("n"))


RULES = [S.Rule("wiki", pattern="^The|^Nicht"), S.Rule("third", project="proj3"), S.Rule("long", pattern="(?i)thes")]


def c01_classify(spark: SparkSession, sf: str) -> DataFrame:
    return S.backfill_types(sessions(spark, sf), turns(spark, sf), RULES)


def r05_detail(spark: SparkSession, sf: str) -> DataFrame:
    return S.detail(sessions(spark, sf), turns(spark, sf), full=True).select("id", "agent", "user_turns", "assistant_turns", "system_turns", "content")


def r06_with_turns(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_turns(sessions(spark, sf), turns(spark, sf)).select("id", F.array_join(F.transform("turns", lambda t: F.concat(t["turn_index"].cast("string"), t["role"])), ",").alias("turns"))


def r09_summary_backfill(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf).withColumn("summary", F.when(C("is_favorite"), C("summary")))
    return S.summary_backfill(s, turns(spark, sf))


def f21_render_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that come back from their markdown: all of them, with their text."""
    t = turns(spark, sf).where("length(trim(content)) > 0")
    return markdown.parse_turns(markdown.render(sessions(spark, sf), t)).select("id", "turn_index", "role", F.sha2(F.trim("content"), 256).alias("sha"))


def m01_upsert(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf)
    old = s.where("agent != 'chatgpt'").select("id", C("agent").alias("model"), "turn_count", "end_time", "tags", "summary")
    new = s.where("session_type = 'interactive'").select("id", F.when(C("agent") == "codex", F.lit("m2")).alias("model"), (C("turn_count") + 1).alias("turn_count"), "end_time", F.array(F.lit("x")).alias("tags"), F.lit("new").alias("summary"))
    return S.upsert(old, new).select("id", "model", "turn_count", "summary", F.array_join("tags", ",").alias("tags"))


def m02_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).select("session_id", "turn_index", "role")
    return S.insert_ignore(t.where("role = 'user'"), t.withColumn("role", F.lit("new")))[0]


def m04_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = sessions(spark, sf).where("is_archived").select(C("id").alias("session_id"))
    out = S.delete_sessions({"sessions": sessions(spark, sf).select("id"), "turns": turns(spark, sf).select("session_id"), "vectors": vectors(spark, sf).select("session_id")}, gone)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in out.items()]
    return parts[0].union(parts[1]).union(parts[2])


def m05_set_tags(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf).select("id", "is_favorite", "summary")
    return S.set_fields(s, s.where("is_favorite").select("id", F.concat(F.lit("s"), "id").alias("value")), "summary").select("id", "summary")


def m06_archive(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf).select("id", "is_favorite", "is_archived").withColumn("archived_at", F.when(C("is_archived"), F.lit(datetime(2024, 1, 1))))
    return S.set_archived(s, s.where("is_favorite").select("id"), True, F.lit(datetime(2024, 2, 1))).select("id", "is_archived", "archived_at")


def m07_relative(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf).withColumn("vault_path", F.when(C("is_favorite"), F.concat(F.lit("/home/v/"), "vault_path")).otherwise(C("vault_path")))
    return S.relative_paths(s, "/home/v").select("id", "vault_path")


def s18_changed(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    files = p.select(C("url").alias("path"), F.length("html").cast("bigint").alias("size"), C("page_id").alias("mtime")).dropDuplicates(["path"])
    stored = p.where("url like 'https:%'").select(C("url").alias("path"), (F.length("html") + F.endswith("url", F.lit(".html")).cast("int")).cast("bigint").alias("size"), C("page_id").alias("mtime")).dropDuplicates(["path"])
    return S.source_changed(files.join(p.groupBy(C("url").alias("path")).count().where("count = 1").select("path"), "path", "left_semi"), stored)


def s19_decide(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf)
    stored = C("conv_id") % 9
    return s.select("id", S.decide_reingest(C("agent"), C("turn_count") * F.when(C("conv_id") % 6 == 0, 4).otherwise(1), stored).alias("action"))


def _q(f, sql: str):  # noqa: ANN001, ANN202
    return f.__name__, (f, sql)


S_ = "with " + SESSIONS_SQL + " "
T_ = "with " + TURNS_SQL + " "
SV = "with " + SESSIONS_SQL + ", " + VECTORS_SQL + " "
TV = "with " + TURNS_SQL + ", " + VECTORS_SQL + " "
QUERIES = dict([
    _q(p01_search_pred, S_ + "select id, session_type from sessions where not is_archived and start_time >= '2024-01-01 05:00' and start_time < '2024-01-04' and (session_type is null or session_type != 'automated') and id in (select cast(vec_id % 90 as varchar) from embeddings)"),
    _q(p02_vector_pred, S_ + "select id from sessions where project = 'proj3' and agent = 'codex'"),
    _q(p04_temporal, S_ + """select 'today' as word, id from sessions where not is_archived and start_time >= '2024-01-05' union all select 'yesterday', id from sessions where not is_archived and start_time >= '2024-01-04' and start_time < '2024-01-05'
      union all select 'last week', id from sessions where not is_archived and start_time >= '2023-12-29 12:00' union all select 'since 2024-01-02', id from sessions where not is_archived and start_time >= '2024-01-02'"""),
    _q(p06_list, S_ + "select id from sessions where session_type != 'automated' and list_contains(tags, 'even') and (contains(lower(coalesce(summary, '')), 'e') or contains(lower(coalesce(project, '')), 'e'))"),
    _q(p06_list_tags, S_ + "select id from sessions where session_type != 'automated' and not is_archived and list_contains(tags, 'even') and list_contains(tags, 'three') and is_favorite and start_time >= '2024-01-01 02:00'"),
    _q(p08_daily, S_ + "select id, start_time from sessions where start_time::date = '2024-01-02'"),
    _q(p10_prefix, S_ + "select p, case when count(id) = 1 then 'found' when count(id) > 1 then 'ambiguous' else 'missing' end as status, case when count(id) = 1 then min(id) end as id, count(id) as n from (values ('1'), ('19'), ('x')) v(p) left join sessions on starts_with(id, p) group by p"),
    _q(p11_open, S_ + "select id from sessions where end_time is null"),
    _q(p12_rebuild_pick, S_ + "select id, 'retry' as why from sessions where semantic_extracted_at is null union all select id, 'since' from sessions where start_time >= '2024-01-03'"),
    _q(p13_noise, S_ + "select id from sessions where turn_count >= 2 and coalesce(session_type, '') != 'automated' and not (starts_with(coalesce(summary, ''), 'The') or starts_with(coalesce(summary, ''), 'Nicht') or starts_with(coalesce(summary, ''), 'An'))"),
    _q(p15_invalid_vectors, "select vec_id, vec_id % 7 != 0 as ok from embeddings"),
    _q(p18_date_range, S_ + "select 'today' as name, count(*) as n from sessions where start_time::date = '2024-01-05' union all select 'week', count(*) from sessions where start_time::date between '2024-01-01' and '2024-01-05' union all select 'month', count(*) from sessions where start_time::date between '2024-01-01' and '2024-01-05' union all select 'all', count(*) from sessions"),
    _q(l03_page, S_ + "select id, start_time, (select count(*) from sessions where session_type != 'automated' and not is_archived) as total from sessions where session_type != 'automated' and not is_archived order by start_time desc, id limit 15 offset 15"),
    _q(l08_recent_jobs, "select event_id, ts from events order by ts desc, event_id limit 50"),
    _q(l10_latest, S_ + "select 'session:' || id as node from sessions order by start_time desc, id limit 1"),
    _q(j01_inner, S_ + "select session_id, turn_index, agent, project from turns join sessions on id = session_id"),
    _q(j02_left_latest, S_ + "select event_id, cast(user_id as varchar) as id, coalesce(agent, 'unknown') as agent, ts from events left join sessions on id = cast(user_id as varchar) order by ts desc, event_id limit 5"),
    _q(j03_first_user, S_ + "select id, arg_min(content, turn_index) filter (role = 'user') as content, min(turn_index) filter (role = 'user') as turn_index from sessions left join turns on id = session_id group by id"),
    _q(j04_anti_missing, TV + "select distinct session_id from turns t where not exists (select 1 from vectors v where v.session_id = t.session_id and v.turn_index = t.turn_index)"),
    _q(j05_anti_orphan, SV + "select session_id, count(*) || ' vectors' as detail from vectors where session_id not in (select id from sessions where conv_id % 4 != 2) group by 1"),
    _q(j06_semi_pair, TV + "select session_id, turn_index, content from turns where (session_id, turn_index) in (select session_id, turn_index from vectors)"),
    _q(j08_full_merge, TV + "select session_id, turn_index, left_score, right_score from (select session_id, turn_index, length(content)::int as left_score from turns) full join (select session_id, turn_index, vec_id as right_score from vectors) using (session_id, turn_index)"),
    _q(j14_prefix_anti, S_ + "select distinct cast(user_id + 40 as varchar) as file_id from events where not exists (select 1 from sessions where starts_with(id, cast(user_id + 40 as varchar)))"),
    _q(j17_tool_results, "select u.event_id as tool_use_id, u.event_type, r.value as output from events u left join (select event_id * 2 as k, value from events) r on r.k = u.event_id"),
    _q(a02_status, SV + "select (select count(*) from sessions) as sessions, (select count(*) from turns) as turns, (select count(*) from turns where coalesce(content, '') != '') as embeddable, count(*) as vectors, count(distinct (session_id, turn_index)) as embedded, round(100.0 * count(distinct (session_id, turn_index)) / (select count(*) from turns where coalesce(content, '') != ''), 6) as coverage from vectors"),
    _q(a03_distinct2, "select count(distinct (l_suppkey, l_returnflag)) as n from lineitem"),
    _q(a05_agents, S_ + "select agent, count(*) as n from sessions group by agent"),
    _q(a06_tags, S_ + "select tag, count(*) as n from (select unnest(tags) as tag from sessions) group by tag"),
    _q(a07_roles, T_ + "select session_id, count(*) filter (role = 'user') as user_turns, count(*) filter (role = 'assistant') as assistant_turns, count(*) filter (role = 'system') as system_turns from turns group by session_id"),
    _q(a08_top8, "select cast(l_suppkey as varchar) as session_id, 'tool' || (l_partkey % 40) as tool, count(*) as uses from lineitem group by 1, 2 qualify row_number() over (partition by 1, cast(l_suppkey as varchar) order by count(*) desc, 'tool' || (l_partkey % 40)) <= 8"),
    _q(a09_dups, "select cast(user_id as varchar) as session_id, count(*) as n from events where event_type = 'click' group by 1 having count(*) > 1"),
    _q(a12_dedup, "select l_suppkey as session_id, l_linenumber as turn_index, l_returnflag as model, min(l_orderkey * 10 + l_linenumber) as vec_id from lineitem group by 1, 2, 3"),
    _q(a13_projects, S_ + "select distinct project from sessions where project is not null"),
    _q(a14_by_project, S_ + "select coalesce(project, '(none)') as project, string_agg(id, ',' order by start_time, id) as ids from sessions group by 1"),
    _q(a15_session_agg, S_ + "select id as session_id, turn_count, tokens_in, (select sum(turn_index)::bigint from turns where session_id = id) as tokens_out, (select string_agg(distinct role, ',' order by role) from turns where session_id = id) as tools_used, summary from sessions"),
    _q(a17_max_norm, "select l_orderkey, l_linenumber, round(l_extendedprice / max(l_extendedprice) over (partition by l_suppkey), 9) as score from lineitem"),
    _q(w02_diversify, "select cast(l_suppkey as varchar) as session_id, l_orderkey * 10 + l_linenumber as turn_index, l_extendedprice as score from lineitem qualify row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey * 10 + l_linenumber) <= 2"),
    _q(w05_role_runs, T_ + "select session_id, turn_index, starts, sum(starts::int) over (partition by session_id order by turn_index)::bigint as run from (select *, coalesce(lag(role) over (partition by session_id order by turn_index) != role, true) as starts from turns)"),
    _q(w06_ffill, T_ + "select session_id, turn_index, last_value(case when turn_index % 3 = 0 then role end ignore nulls) over (partition by session_id order by turn_index rows unbounded preceding) as role from turns"),
    _q(w07_merge_islands, "with r as (select *, sum(case when lag is not distinct from event_type then 0 else 1 end) over (partition by user_id order by event_id) as run from (select *, lag(event_type) over (partition by user_id order by event_id) as lag from events)) select user_id as session_id, min(event_id) as event_id, min(event_type) as msg, string_agg('v', chr(10) || chr(10)) as merged, count(*) as n from r group by user_id, run"),
    _q(w09_budget, T_ + "select session_id, turn_index, used::bigint as used from (select *, sum(length(content)) over (partition by session_id order by turn_index desc) as used from turns) where used <= 1500"),
    _q(w10_prefix_budget, T_ + "select session_id, turn_index, before::bigint as before, length(" + bytes_sql("content", 1000) + ")::int as n from (select *, coalesce(sum(strlen(" + bytes_sql("content", 1000) + ")) over (partition by session_id order by turn_index rows between unbounded preceding and 1 preceding), 0) as before from turns) where before <= 3000"),
    _q(c01_classify, S_ + ", f as (select session_id, arg_min(content, turn_index) as c from turns where role = 'user' group by 1) select id, session_type as old, case when coalesce(regexp_matches(c, '^The|^Nicht'), false) then 'wiki' when project = 'proj3' then 'third' when coalesce(regexp_matches(c, '(?i)thes'), false) then 'long' else 'interactive' end as new from sessions left join f on id = session_id"),
    _q(r05_detail, S_ + ", g as (select session_id, count(*) filter (role = 'user') as user_turns, count(*) filter (role = 'assistant') as assistant_turns, count(*) filter (role = 'system') as system_turns, string_agg('## ' || role || chr(10) || content, chr(10) || chr(10) order by turn_index) as content from turns group by 1) select id, agent, user_turns, assistant_turns, system_turns, content from sessions left join g on id = session_id"),
    _q(r06_with_turns, T_ + "select session_id as id, string_agg(turn_index || role, ',' order by turn_index) as turns from turns group by 1"),
    _q(r09_summary_backfill, S_ + "select id, summary, case when is_favorite and summary is not null then 'kept' when summary is not null then 'filled' else 'no user turn' end as outcome from sessions"),
    _q(f21_render_roundtrip, T_ + "select session_id as id, turn_index, role, sha256(trim(content)) as sha from turns where length(trim(content)) > 0"),
    _q(m01_upsert, S_ + """select id, case when n and agent = 'codex' then 'm2' when o then agent end as model, case when n then turn_count + 1 else turn_count end as turn_count,
      case when o then summary else 'new' end as summary, case when o then array_to_string(tags, ',') else 'x' end as tags from (select *, agent != 'chatgpt' as o, coalesce(session_type = 'interactive', false) as n from sessions) where o or n"""),
    _q(m02_insert_ignore, T_ + "select session_id, turn_index, case when role = 'user' then role else 'new' end as role from turns"),
    _q(m04_cascade, SV + "select 'sessions' as name, count(*) as n from sessions where not is_archived union all select 'turns', count(*) from turns where session_id not in (select id from sessions where is_archived) union all select 'vectors', count(*) from vectors where session_id not in (select id from sessions where is_archived)"),
    _q(m05_set_tags, S_ + "select id, case when is_favorite then 's' || id else summary end as summary from sessions"),
    _q(m06_archive, S_ + "select id, is_archived or is_favorite as is_archived, case when is_archived then timestamp '2024-01-01' when is_favorite then timestamp '2024-02-01' end as archived_at from sessions"),
    _q(m07_relative, S_ + "select id, vault_path from sessions"),
    _q(s18_changed, "with u as (select url from pages group by url having count(*) = 1) select url as path, not (starts_with(url, 'https:') and not ends_with(url, '.html')) as changed from pages where url in (select url from u)"),
    _q(s19_decide, S_ + "select id, case when p > d + 10 and p > 2 * d then 'rebuild' when agent in ('claude-code', 'codex') and p > d then 'incremental' when agent in ('claude-code', 'codex') and p = d then 'skip' else 'rebuild' end as action from (select *, turn_count * case when conv_id % 6 = 0 then 4 else 1 end as p, conv_id % 9 as d from sessions)"),
])
