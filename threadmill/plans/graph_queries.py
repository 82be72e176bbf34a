"""Queries of the graph, the checks and the reports, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import markdown
from threadmill.operators import bm25
from threadmill.operators import graph as G
from threadmill.operators import lint as N
from threadmill.operators import reports as R
from threadmill.plans import saved
from threadmill.plans.saved import graph_edges, graph_nodes
from threadmill.plans.tables import GRAPH_SQL, SESSIONS_SQL, TURNS_SQL, VECTORS_SQL, bytes_sql, orders, sessions, table, turns, vectors

C = F.col


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with tools, a body that names issues and files, and a folder."""
    s = sessions(spark, sf)
    tools = F.when(C("conv_id") % 3 == 0, F.array(F.lit("Bash"), F.lit("Edit"))).otherwise(F.array(F.lit("Bash")))
    body = F.concat(F.lit("This fixes #"), C("conv_id") % 10, F.lit(", Task #5.\n> [!tool]- Edit `/w/src/"), C("conv_id") % 4, F.lit(".rs`\n"))
    return s.withColumn("tools_used", tools).withColumn("body", body).withColumn("cwd", F.lit("/w"))


def g01_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.base_nodes(_sessions(spark, sf)).select("id", "type", "label")


def g01_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.base_edges(_sessions(spark, sf))


def g02_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return G.semantic_edges(_sessions(spark, sf))


def w03_same_project(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacency(orders(spark, sf)).where("relation = 'same_project'").select("source", "target", "weight")


def w04_same_day(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacency(orders(spark, sf)).where("relation = 'same_day'").select("source", "target", "weight")


def g04_build(spark: SparkSession, sf: str) -> DataFrame:
    """One agent's sessions are stored; the rest is added, and adjacency is made anew."""
    s = _sessions(spark, sf)
    nodes, edges = G.build(s.where("agent = 'codex'"))
    nodes, edges = G.build(s, nodes, edges)
    return G.stats(nodes, edges)


def g06_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = G.base_edges(_sessions(spark, sf))
    return G.upsert_edges(e.where("relation != 'uses_tool'"), e.withColumn("weight", F.lit(9.0))).select("source", "target", "relation", "weight")


def g07_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbors(graph_edges(spark, sf)).where("id = 'project:7'").select("other", "relation", "direction")


def g08_bfs(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("1",), ("100",)], "session_id string")
    return G.related_sessions(saved.order_edges(spark, sf), seeds, 3)


def g09_khop(spark: SparkSession, sf: str) -> DataFrame:
    e = graph_edges(spark, sf)
    return G.query(graph_nodes(spark, sf), e, "project:7", 2).groupBy("node_id", "relation", "direction").agg(F.count("*").alias("n"))


def g09_khop3(spark: SparkSession, sf: str) -> DataFrame:
    e = graph_edges(spark, sf)
    return G.query(graph_nodes(spark, sf), e, "project:7", 3).groupBy("relation", "direction", "type").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("nodes"))


def g10_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    e = graph_edges(spark, sf)
    s = e.select(C("source").alias("id")).distinct().select("id", F.lit("session").alias("type"), F.expr("substring(id, 9)").alias("label"), F.lit(None).cast("string").alias("meta"))
    nodes = s.unionByName(graph_nodes(spark, sf))
    return G.snapshot(nodes, e, 40, 200)[1].select("source", "target", "relation", "priority")


def a10_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = graph_edges(spark, sf)
    return G.stats(graph_nodes(spark, sf), e)


def a11_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(graph_edges(spark, sf))


def p16_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    e = graph_edges(spark, sf)
    return G.filter_sessions(graph_nodes(spark, sf), e, "tool", "19", "uses_tool")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    t = '{"edges":[{"relation":"%s","target_type":"topic","target_label":"t%d"},{"relation":"bad","target_type":"x","target_label":"y"},{"relation":"fixes_bug","target_type":"issue","target_label":"%d"}]}'
    rel = F.element_at(F.array(F.lit("discusses_topic"), F.lit("introduces_tech")), (C("event_id") % 2 + 1).cast("int"))
    body = F.format_string(t, rel, C("event_id") % 11, C("event_id") % 5)
    answer = F.when(C("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(C("event_id") % 7 == 0, F.lit("no json")).otherwise(body)
    return table(spark, sf, "events").select(C("event_id").cast("string").alias("session_id"), answer.alias("answer"))


def g12_llm_parse(spark: SparkSession, sf: str) -> DataFrame:
    return G.llm_edges(_answers(spark, sf))


def g13_merge(spark: SparkSession, sf: str) -> DataFrame:
    rules = G.semantic_edges(_sessions(spark, sf))
    llm = rules.select("source", "target", "relation", F.lit("LLM").alias("confidence"), F.lit(0.8).alias("weight")).union(rules.select("source", F.lit("topic:x").alias("target"), F.lit("discusses_topic").alias("relation"), F.lit("LLM").alias("confidence"), F.lit(0.5).alias("weight")).distinct())
    return G.merge_rule_and_llm(rules, llm, rules.where("relation = 'fixes_bug'"))[0]


def g15_delete(spark: SparkSession, sf: str) -> DataFrame:
    e = graph_edges(spark, sf)
    kept = G.delete_session(G.target_nodes(e), G.delete_relations(e, "by_agent"), "1")[1]  # no node is made for the edges that stay
    return kept.groupBy("relation").agg(F.count("*").alias("n"))


def s23_graph_json(spark: SparkSession, sf: str) -> DataFrame:
    s = _sessions(spark, sf)
    j = G.node_link_json(G.base_nodes(s), G.base_edges(s))
    return j.select(F.size(F.from_json("json", "nodes array<struct<id:string>>")["nodes"]).alias("nodes"), F.size(F.from_json("json", "links array<struct<source:string>>")["links"]).alias("links"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).where("not is_archived and vault_path is not null").select(C("vault_path").alias("path"), C("id").alias("file_id")).union(spark.createDataFrame([("raw/zz.md", "zz")], "path string, file_id string"))


def _wiki(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    head = F.concat(F.lit("---\n"), F.when(C("doc_id") % 4 != 0, F.lit("title: T\n")).otherwise(""), F.lit("type: project\nsources: ["), C("doc_id") % 60, F.lit(", 'x"), C("doc_id") % 3, F.lit("']\n---\n"))
    return d.select(F.concat(F.lit("projects/"), "doc_id", F.lit(".md")).alias("path"), F.when(C("doc_id") % 10 != 0, F.concat(head, "text")).otherwise(C("text")).alias("text"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(C("user_id").cast("string").alias("session_id"), F.when(C("event_type") == "click", "ingest").otherwise("other").alias("action"))


def n01_vault_files(spark: SparkSession, sf: str) -> DataFrame:
    return N.vault_files(sessions(spark, sf), _files(spark, sf))


def n02_orphan_files(spark: SparkSession, sf: str) -> DataFrame:
    return N.orphan_files(_files(spark, sf), sessions(spark, sf))


def n03_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return N.duplicates(_log(spark, sf))


def n04_missing(spark: SparkSession, sf: str) -> DataFrame:
    return N.missing_embeddings(turns(spark, sf), vectors(spark, sf))


def n05_index_counts(spark: SparkSession, sf: str) -> DataFrame:
    """An index that lacks some turns."""
    return N.index_counts(turns(spark, sf), bm25.build(turns(spark, sf).where("turn_index < 5")).docs)


def n06_orphan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return N.orphan_vectors(vectors(spark, sf), sessions(spark, sf).where("conv_id % 4 != 1"))


def n07_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    return N.wiki_frontmatter(_wiki(spark, sf))


def n08_dead_sources(spark: SparkSession, sf: str) -> DataFrame:
    return N.dead_sources(_wiki(spark, sf), sessions(spark, sf))


def n09_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    return N.unreferenced(sessions(spark, sf), _wiki(spark, sf))


def n10_invocations(spark: SparkSession, sf: str) -> DataFrame:
    return N.wiki_invocations(sessions(spark, sf).withColumn("cwd", F.when(C("conv_id") % 2 == 0, "/vault").otherwise("/w")), "/vault")


def n11_report(spark: SparkSession, sf: str) -> DataFrame:
    s, t, v, w = sessions(spark, sf), turns(spark, sf), vectors(spark, sf), _wiki(spark, sf)
    return N.severities(N.report([N.vault_files(s, _files(spark, sf)), N.orphan_files(_files(spark, sf), s), N.duplicates(_log(spark, sf)), N.missing_embeddings(t, v), N.orphan_vectors(v, s), N.wiki_frontmatter(w), N.dead_sources(w, s), N.unreferenced(s, w)]))


def n12_fix_stale(spark: SparkSession, sf: str) -> DataFrame:
    return N.fix_stale(sessions(spark, sf), N.vault_files(sessions(spark, sf), _files(spark, sf))).select("id")


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).select(F.concat(F.lit("session:"), "id").alias("source"), F.concat(F.lit("topic:t"), C("conv_id") % 4).alias("target"), F.lit("discusses_topic").alias("relation"))


def r01_daily(spark: SparkSession, sf: str) -> DataFrame:
    d = R.daily(sessions(spark, sf), _topics(spark, sf), "2024-01-01")
    return d.select("project", F.array_join(F.transform("entries", lambda e: e["id"]), ",").alias("ids"), F.array_join("topics", ",").alias("topics"))


def r01_totals(spark: SparkSession, sf: str) -> DataFrame:
    return R.daily_totals(sessions(spark, sf), "2024-01-01")


def r02_diary(spark: SparkSession, sf: str) -> DataFrame:
    return R.diary_prompt(R.daily(sessions(spark, sf), _topics(spark, sf), "2024-01-01"))


def r04_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return R.turn_prompt(turns(spark, sf))


def r10_review(spark: SparkSession, sf: str) -> DataFrame:
    sev = F.element_at(F.array(F.lit("error"), F.lit("warn")), (C("event_id") % 2 + 1).cast("int"))
    a = F.when(C("event_id") % 3 == 0, F.lit('{"approved": true}')).when(C("event_id") % 3 == 1, F.concat(F.lit('```json\n{"issues":[{"severity":"'), sev, F.lit('","message":"m"}]}\n```'))).otherwise(F.lit("garbage"))
    return R.review(table(spark, sf, "events").select(C("event_id").alias("id"), a.alias("answer")))


def r11_page_path(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).select("id", R.page_path(F.concat("project", F.lit(" / x")), C("id")).alias("path"))


def r15_overview(spark: SparkSession, sf: str) -> DataFrame:
    e = graph_edges(spark, sf)
    return R.overview(sessions(spark, sf), graph_nodes(spark, sf), e, vectors(spark, sf))


def f37_merge_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    src = lambda *xs: F.array(*[F.concat(F.lit("s"), x) for x in xs])
    a = d.where("lang != 'fr'").select(C("doc_id").cast("string").alias("path"), src(C("doc_id") % 5, C("doc_id") % 7).alias("sources"), F.lit("old").alias("body"))
    b = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(C("doc_id").cast("string").alias("path"), src(C("doc_id") % 4).alias("sources"), F.lit("new").alias("body"))
    return markdown.merge_pages(a, b).select("path", F.array_join("sources", ",").alias("sources"), "body")


def t03_job_state(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("started", "running", "completed", "failed", "interrupted"))), (C("event_id") * 7 % 5 + 1).cast("int"))
    return R.latest_status(table(spark, sf, "events").select(C("user_id").alias("job_id"), C("event_id").alias("seq"), status.alias("status")))


def t05_retention(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "events").select("event_id", C("ts").alias("started_at"), F.when(C("event_type") != "click", C("ts")).alias("completed_at"))
    return R.expire_jobs(j, F.lit(datetime(2024, 1, 25))).select("event_id")


def _q(f, sql: str):  # noqa: ANN001, ANN202
    return f.__name__, (f, sql)


S_ = "with " + SESSIONS_SQL
GR = "with " + GRAPH_SQL
NEXT = "with n as (select o_orderkey, lead(o_orderkey) over (partition by {0} order by o_orderdate, o_orderkey::varchar) as nxt from orders) select 'session:' || o_orderkey as source, 'session:' || nxt as target, {1}::double as weight from n where nxt is not null"
TOOLED = ", tooled as (select *, case when conv_id % 3 = 0 then ['Bash', 'Edit'] else ['Bash'] end as tools from sessions)"
BASE = TOOLED + """, base as (select 'session:' || id as source, 'project:' || project as target, 'belongs_to' as relation from sessions where project is not null union all select 'session:' || id, 'agent:' || agent, 'by_agent' from sessions union all select 'session:' || id, 'tool:' || unnest(tools), 'uses_tool' from tooled)"""
SEM = """, sem as (select 'session:' || id as source, 'issue:' || (conv_id % 10) as target, 'fixes_bug' as relation, 'INFERRED' as confidence, 0.7::double as weight from sessions union all select 'session:' || id, 'file:src/' || (conv_id % 4) || '.rs', 'modifies_file', 'INFERRED', 0.9 from sessions where conv_id % 3 = 0)"""
ADJ = """, adj as (select id, lead(id) over (partition by project order by start_time, id) as nxt, 'same_project' as relation from sessions where project is not null union all select id, lead(id) over (partition by start_time::date order by start_time, id), 'same_day' from sessions)"""
NODES = ", nodes as (select distinct target as id from edges)"
FILES = ", files as (select vault_path as path, id as file_id from sessions where not is_archived and vault_path is not null union all select 'raw/zz.md', 'zz')"
WIKI = """, wiki as (select doc_id, 'projects/' || doc_id || '.md' as path from documents), src as (select path, unnest([(doc_id % 60)::varchar, 'x' || (doc_id % 3)]) as session_id from wiki where doc_id % 10 != 0)"""
NOISE = "turn_count >= 2 and coalesce(session_type, '') != 'automated' and not (starts_with(coalesce(summary, ''), 'Summarize this') or starts_with(coalesce(summary, ''), 'Write a wiki') or starts_with(coalesce(summary, ''), 'You are a'))"
L001 = "select 'L001' as code, 'error' as severity, id as session_id, case when vault_path is null then 'no path' else 'missing ' || vault_path end as detail from sessions where vault_path is null or vault_path not in (select path from files)"
L007 = "select 'L007' as code, 'warn' as severity, session_id, count(*) || ' vectors' as detail from vectors where session_id not in (select id from sessions) group by session_id"
L008 = "select 'L008' as code, 'warn' as severity, null::varchar as session_id, path || ' lacks ' || case when doc_id % 10 = 0 then 'frontmatter' else 'title' end as detail from wiki where doc_id % 10 = 0 or doc_id % 4 = 0"
L009 = "select 'L009' as code, 'error' as severity, session_id, path as detail from src where session_id not in (select id from sessions)"
L010 = "select 'L010' as code, 'info' as severity, id as session_id, 'in no wiki page' as detail from sessions where id not in (select session_id from src)"
L003 = "select 'L003' as code, 'error' as severity, cast(user_id as varchar) as session_id, count(*) || ' ingests' as detail from events where event_type = 'click' group by user_id having count(*) > 1"
L004 = "select distinct 'L004' as code, 'info' as severity, session_id, 'turns without vectors' as detail from turns t where not exists (select 1 from vectors v where v.session_id = t.session_id and v.turn_index = t.turn_index)"
QUERIES = dict([
    _q(g01_nodes, S_ + TOOLED + " select 'session:' || id as id, 'session' as type, left(id, 8) as label from sessions union select 'project:' || project, 'project', project from sessions where project is not null union select 'agent:' || agent, 'agent', agent from sessions union select 'tool:' || t, 'tool', t from (select unnest(tools) as t from tooled)"),
    _q(g01_edges, S_ + BASE + " select source, target, relation, 'EXTRACTED' as confidence, 1.0::double as weight from base"),
    _q(g02_semantic, S_ + SEM + " select * from sem"),
    _q(w03_same_project, NEXT.format("o_custkey", "1.0")),
    _q(w04_same_day, NEXT.format("o_orderdate::date", "0.5")),
    _q(g04_build, S_ + BASE + SEM + ADJ + """, e as (select source, target, relation from base union all select source, target, relation from sem union all select id, nxt, relation from adj where nxt is not null), n as (select source as id from base union select target from base union select target from sem)
      select 'edge' as kind, relation as name, count(*) as n from e group by relation union all select 'edge', null, count(*) from e union all select 'node', split_part(id, ':', 1), count(*) from n group by 2 union all select 'node', null, count(*) from n"""),
    _q(g06_upsert, S_ + BASE + " select source, target, relation, case when relation = 'uses_tool' then 9.0::double else 1.0 end as weight from base"),
    _q(g07_neighbors, GR + " select target as other, relation, 'out' as direction from edges where source = 'project:7' union all select source, relation, 'in' from edges where target = 'project:7'"),
    _q(g08_bfs, """with recursive n as (select o_orderkey::varchar as a, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey::varchar)::varchar as b, 'same_project' as r from orders union all select o_orderkey::varchar, lead(o_orderkey) over (partition by o_orderdate::date order by o_orderdate, o_orderkey::varchar)::varchar, 'same_day' from orders),
      u as (select a, b, r from n where b is not null union all select b, a, r from n where b is not null), w as (select s as id, 0 as hop, null::varchar as r from (values ('1'), ('100')) v(s) union select u.b, w.hop + 1, u.r from w join u on u.a = w.id where w.hop < 3),
      m as (select id, min(hop) as hop from w group by id) select id as session_id, min(r) as relation, hop::int as hop from w join m using (id, hop) where hop > 0 group by id, hop"""),
    _q(g09_khop, GR + """, u as (select source as id, target as other, relation, 'out' as direction from edges union all select target, source, relation, 'in' from edges), a as (select * from u where id = 'project:7'), b as (select * from u where id in (select other from a where other != 'project:7'))
      select other as node_id, relation, direction, count(*) as n from (select * from a union all select * from b) group by all"""),
    _q(g09_khop3, GR + """, u as (select source as id, target as other, relation, 'out' as direction from edges union all select target, source, relation, 'in' from edges), a as (select * from u where id = 'project:7'), f1 as (select distinct other as id from a where other != 'project:7'), b as (select * from u where id in (select id from f1)),
      f2 as (select distinct other as id from b where other != 'project:7' and other not in (select id from f1)), c as (select * from u where id in (select id from f2))
      select relation, direction, case when starts_with(other, 'session:') then null else split_part(other, ':', 1) end as type, count(*) as n, count(distinct other) as nodes from (select * from a union all select * from b union all select * from c) group by all"""),
    _q(g10_snapshot, GR + """, deg as (select id, count(*) as d from (select source as id from edges union all select target from edges) group by id), top as (select id from deg where starts_with(id, 'session:') order by d desc, id limit 40)
      select source, target, relation, case relation when 'uses_tool' then 1 else 2 end::int as priority from edges where source in (select id from top) order by priority, source, target, relation limit 200"""),
    _q(a10_stats, GR + NODES + " select 'edge' as kind, relation as name, count(*) as n from edges group by relation union all select 'edge', null, count(*) from edges union all select 'node', split_part(id, ':', 1), count(*) from nodes group by 2 union all select 'node', null, count(*) from nodes"),
    _q(a11_degrees, GR + " select id, count(*) as degree from (select source as id from edges union all select target from edges) group by id"),
    _q(p16_allowlist, GR + " select distinct substr(source, 9) as session_id from edges where relation = 'uses_tool' and contains(substr(target, 6), '19')"),
    _q(g12_llm_parse, """with e as (select event_id from events where event_id % 3 = 0 or event_id % 7 != 0) select 'session:' || event_id as source, 'topic:t' || (event_id % 11) as target, case when event_id % 2 = 0 then 'discusses_topic' else 'introduces_tech' end as relation, 'LLM' as confidence, case when event_id % 2 = 0 then 0.5::double else 0.6 end as weight from e
      union all select 'session:' || event_id, 'issue:' || (event_id % 5), 'fixes_bug', 'LLM', 0.8 from e"""),
    _q(g13_merge, S_ + SEM + " select source, target, relation, confidence, weight from sem where relation = 'modifies_file' union all select distinct source, 'topic:x', 'discusses_topic', 'LLM', 0.5::double from sem"),
    _q(g15_delete, GR + " select relation, count(*) as n from edges where relation != 'by_agent' and source != 'session:1' group by 1"),
    _q(s23_graph_json, S_ + BASE + " select (select count(*) from (select source as id from base union select target from base))::int as nodes, (select count(*) from base)::int as links"),
    _q(n01_vault_files, S_ + FILES + " " + L001),
    _q(n02_orphan_files, S_ + FILES + " select 'L002' as code, 'warn' as severity, file_id as session_id, path as detail from files where not exists (select 1 from sessions where (id = file_id or (length(file_id) <= 8 and starts_with(id, file_id))))"),
    _q(n03_duplicates, L003),
    _q(n04_missing, "with " + TURNS_SQL + ", " + VECTORS_SQL + " " + L004),
    _q(n05_index_counts, "with " + TURNS_SQL + " select 'L005' as code, 'error' as severity, null::varchar as session_id, count(*) || ' turns, ' || (select count(*) from turns where turn_index < 5) || ' indexed' as detail from turns"),
    _q(n06_orphan_vectors, S_ + ", " + VECTORS_SQL + " " + L007.replace("from sessions", "from sessions where conv_id % 4 != 1")),
    _q(n07_frontmatter, S_ + WIKI + " " + L008),
    _q(n08_dead_sources, S_ + WIKI + " " + L009),
    _q(n09_unreferenced, S_ + WIKI + " " + L010),
    _q(n10_invocations, S_ + " select 'L011' as code, 'info' as severity, id as session_id, '/vault' as detail from sessions where conv_id % 2 = 0 and agent in ('codex', 'claude-code')"),
    _q(n11_report, S_ + ", " + VECTORS_SQL + FILES + WIKI + f", f as ({L001} union all select 'L002', 'warn', file_id, path from files where not exists (select 1 from sessions where id = file_id or starts_with(id, file_id)) union all {L003} union all {L004} union all {L007} union all {L008} union all {L009} union all {L010}) select count(*) filter (severity = 'error') as n_error, count(*) filter (severity = 'warn') as n_warn, count(*) filter (severity = 'info') as n_info from f"),
    _q(n12_fix_stale, S_ + FILES + " select id from sessions where vault_path is null or vault_path in (select path from files)"),
    _q(r01_daily, S_ + f", d as (select * from sessions where start_time::date = '2024-01-01' and {NOISE}) select coalesce(project, '(none)') as project, string_agg(id, ',' order by start_time, id) as ids, string_agg(distinct 't' || (conv_id % 4), ',' order by 't' || (conv_id % 4)) as topics from d group by 1"),
    _q(r01_totals, S_ + f" select count(*) as total, count(*) filter ({NOISE}) as filtered from sessions where start_time::date = '2024-01-01'"),
    _q(r02_diary, S_ + f", d as (select coalesce(project, '(none)') as project, '## ' || coalesce(project, '(none)') || chr(10) || string_agg('- ' || coalesce(summary, '(no summary)'), chr(10) order by start_time, id) as b from sessions where start_time::date = '2024-01-01' and {NOISE} group by 1) select string_agg(b, chr(10) || chr(10) order by project) as prompt from d"),
    _q(r04_prompt, "with " + TURNS_SQL + ", b as (select *, coalesce(sum(strlen(" + bytes_sql("content", 1000) + ")) over (partition by session_id order by turn_index rows between unbounded preceding and 1 preceding), 0) as before from turns) select session_id, string_agg('[' || role || '] ' || " + bytes_sql("content", 1000) + ", chr(10) order by turn_index) as prompt from b where before <= 3000 group by 1"),
    _q(r10_review, "select event_id as id, event_id % 3 = 0 as approved, case when event_id % 3 = 1 then 1 else 0 end::int as n_issues, event_id % 3 = 1 and event_id % 2 = 0 as regenerate from events"),
    _q(r11_page_path, S_ + " select id, case when project is not null then 'projects/' || project || '---x.md' else 'sessions/' || left(id, 8) || '.md' end as path from sessions"),
    _q(r15_overview, S_ + "," + GRAPH_SQL + NODES + " select (select count(*) from sessions) || ' sessions; projects: ' || (select string_agg(distinct project, ', ' order by project) from sessions) || '; agents: ' || (select string_agg(distinct agent, ', ' order by agent) from sessions) || '; vectors: yes; graph: ' || (select count(*) from nodes) || ' nodes, ' || (select count(*) from edges) || ' edges' as overview"),
    _q(f37_merge_pages, """with d as (select doc_id::varchar as path, case when lang != 'fr' then list_sort(list_distinct(['s' || (doc_id % 5), 's' || (doc_id % 7)])) else [] end as a, case when doc_id in (select doc_id from labels) then ['s' || (doc_id % 4)] else [] end as b, lang != 'fr' as o, doc_id in (select doc_id from labels) as n from documents where lang != 'fr' or doc_id in (select doc_id from labels))
      select path, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as sources, case when o and (not n or list_contains(a, b[1])) then 'old' else 'new' end as body from d"""),
    _q(t03_job_state, """with e as (select user_id, event_id, (['started', 'running', 'completed', 'failed', 'interrupted'])[(event_id * 7 % 5 + 1)::int] as status from events) select user_id as job_id, coalesce(arg_min(status, event_id) filter (status in ('completed', 'failed', 'interrupted')), arg_max(status, event_id)) as status, count(*) as n_events from e group by 1"""),
    _q(t05_retention, "select event_id from events where not (event_type != 'click' and ts < timestamp '2024-01-18')"),
])
