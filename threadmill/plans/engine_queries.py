"""Queries of the facade, plugins, repairs and reports that the other modules don't cover, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.engine import Engine
from threadmill.functions import markdown, plugins
from threadmill.functions import text as X
from threadmill.model import ListFilter, SearchFilters
from threadmill.operators import bm25
from threadmill.operators import filters as P
from threadmill.operators import graph as G
from threadmill.operators import lint as N
from threadmill.operators import maintenance as M
from threadmill.operators import reports as R
from threadmill.operators import sessions as S
from threadmill.operators import vectors as V
from threadmill.plans import graph_queries as GQ
from threadmill.plans import saved
from threadmill.plans.search_queries import COS, PAGES, _asked, _pages, _r, _vector
from threadmill.plans.session_queries import RULES
from threadmill.plans.tables import SESSIONS_SQL, TURNS_SQL, VECTORS_SQL, bytes_sql, sessions, table, turns, vectors

C = F.col


def _analyser() -> Callable[[str], list[tuple[str, str]]]:
    """A stand-in for a morphological analyser: words of an even number of letters are nouns."""
    return lambda t: [(w, "NNG" if len(w) % 2 == 0 else "JX") for w in X.query_tokens(t)]


def f02_morphology(spark: SparkSession, sf: str) -> DataFrame:
    plugins.register_tokenizer("even", _analyser)
    words = plugins.tokenizer("even")[1]
    return turns(spark, sf).select("session_id", "turn_index", F.explode(words(C("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def f03_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The same plug with another set of tags."""
    plugins.register_tokenizer("odd", _analyser, ("JX",))
    words = plugins.tokenizer("odd")[1]
    return turns(spark, sf).select(F.explode(words(C("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def f04_fallback(spark: SparkSession, sf: str) -> DataFrame:
    name, words = plugins.tokenizer("no such", ("nor this",))
    return turns(spark, sf).select(F.explode(words(C("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).withColumn("tokenizer", F.lit(name))


def f10_budget(spark: SparkSession, sf: str) -> DataFrame:
    cases = [(m, o) for m in (1, 12, 13, 128, 512, 8192) for o in (None, 1, 10, 600, 99_999)]
    return spark.createDataFrame([(m, o, *X.chunk_budget(m, o)) for m, o in cases], "model_max int, asked int, size int, overlap int")


def f22_escape(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("text", F.lit(" k:: v `c:: d` e::f\n```\ng:: h\n```\n`open:: i\n```\nj:: k"))
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(markdown.escape_fields(t), 256).alias("sha"), (markdown.unescape_fields(markdown.escape_fields(t)) == t).alias("back"))


def f32_wiki_dates(spark: SparkSession, sf: str) -> DataFrame:
    i = C("doc_id")
    head = F.concat(F.lit("---\n"), F.when(i % 2 == 0, F.concat(F.lit("created: c"), i)).otherwise(F.concat(F.lit('created_at: "a'), i, F.lit('"'))), F.when(i % 3 == 0, F.concat(F.lit("\nupdated_at: 'u"), i, F.lit("'"))).otherwise(""), F.lit("\n---\n"), "text")
    created, updated = M.wiki_dates(head)
    return table(spark, sf, "documents").select("doc_id", created.alias("created"), updated.alias("updated"))


def f35_links(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("[[the]] "), "text").alias("text"))
    return markdown.linked(d, {"the": "t/the", "ing": "ing", "an": "too short"}).select("doc_id", F.sha2("text", 256).alias("sha"))


def f41_merge_conflict(spark: SparkSession, sf: str) -> DataFrame:
    i = C("doc_id")
    ours = F.concat(F.lit("---\ntitle: Ours\nsources:\n  - s"), i % 5, F.lit("\n  - s"), i % 3, F.lit("\n---\nold"))
    theirs = F.concat(F.lit("---\ntitle: Theirs\nsources: [s"), i % 4, F.lit("]\ntype: project\n---\n"), "text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(markdown.merge_conflict(ours, theirs), 256).alias("sha"))


def p05_since(spark: SparkSession, sf: str) -> DataFrame:
    """Bare dates, `since` and words for days, as seen from one moment."""
    now, out = datetime(2024, 1, 3, 12), None
    for word in ("2024-01-02", "since 2024-01-03", "today", "yesterday", "last week"):
        own = P.search_predicate(sessions(spark, sf), P.temporal(word, now)).select(F.lit(word).alias("word"), "id")
        out = own if out is None else out.union(own)
    return out


def p07_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = P.page(sessions(spark, sf), ListFilter(tags=tuple(P.split_tags(["even, three", ""])), page_size=100))
    return rows.select("id", F.array_join("tags", ",").alias("tags"))


def p17_filter(spark: SparkSession, sf: str) -> DataFrame:
    s = GQ._sessions(spark, sf)
    topics = GQ._topics(spark, sf).withColumns({"confidence": F.lit("LLM"), "weight": F.lit(0.5)})
    e = G.semantic_edges(s).unionByName(topics)
    n, out = G.target_nodes(e), None
    for name, args in (("topic", {"topic": "T1", "file": "x"}), ("file", {"file": "src/2"}), ("issue", {"issue": "3"})):
        own = G.graph_filter(n, e, **args).select(F.lit(name).alias("by"), "session_id")
        out = own if out is None else out.union(own)
    return out


def _engine(spark: SparkSession, sf: str, **more: object) -> Engine:
    return Engine(spark, saved.sessions(spark, sf), turns(spark, sf), vectors(spark, sf), index=saved.turn_index(spark, sf), **more)


def j09_ann_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vector of each query, in all cells, with its session; vectors of no session drop out."""
    index, q = saved.vector_index(spark, sf), _asked(spark, sf)[1]
    found = index.search(q, 1, len(index.centroids)).join(vectors(spark, sf).select("vec_id", "session_id", "turn_index"), "vec_id")
    own = sessions(spark, sf).where("conv_id % 4 != 1").select(C("id").alias("session_id"), "agent", "project")
    return found.join(own, "session_id").select("query_id", "vec_id", "session_id", "turn_index", "agent", "project")


def j10_related(spark: SparkSession, sf: str) -> DataFrame:
    s = saved.sessions(spark, sf)
    e = _engine(spark, sf, edges=G.adjacency(s))
    return e.related(spark.createDataFrame([("3",)], "session_id string"), 2, 50).select("session_id", "relation", "hop", "agent", "project")


def l06_wiki_order(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf, pages=_pages(spark, sf)).wiki_search("the1", "keyword").limit(25)


def l07_semantic_order(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in the order of a vector, found by name or not."""
    v = _vector(spark, sf)
    e = _engine(spark, sf, pages=_pages(spark, sf), embedder=lambda texts: [v] * len(texts))
    return e.wiki_search("the1", "semantic").limit(25).select("path", _r("score").alias("score"), "name_match")


def h08_mode_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Without an embedder, or with one that fails, every mode is that of keywords."""

    def broken(texts: list[str]) -> list[list[float]]:
        raise OSError("no server")

    out = None
    for mode, embedder in (("hybrid", None), ("semantic", broken), ("keyword", broken)):
        own = _engine(spark, sf, pages=_pages(spark, sf), embedder=embedder).wiki_search("the2", mode).select(F.lit(mode).alias("mode"), "path", "score")
        out = own if out is None else out.union(own)
    return out


def l09_clamps(spark: SparkSession, sf: str) -> DataFrame:
    cases = [(v, P.list_clamp(v, 10, 1, 50)) for v in (None, -5, 0, 1, 7, 50, 51, 10_000)]
    return spark.createDataFrame(cases, "asked int, clamped int")


def v04_query_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a query is embedded with its prefix and a passage with its own."""
    hashed = V.hash_embedder()
    e = plugins.Prefixed(hashed, "query: ", "passage: ")
    q, p = plugins.embed_query(e, "the and"), e(["the and"])[0]
    return spark.createDataFrame([(q == hashed(["query: the and"])[0], p == hashed(["passage: the and"])[0], q == p)], "query boolean, passage boolean, same boolean")


def v11_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of a vector, its double and one that is masked has the vector's direction."""
    e = table(spark, sf, "embeddings")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    tokens, mask = F.array(wide, F.transform(wide, lambda x: 2 * x), F.transform(wide, lambda x: x + 9)), F.array(F.lit(1), F.lit(1), F.lit(0))
    return e.select("vec_id", _r(F.get(V.mean_pool(tokens, mask), F.lit(0))).alias("first"))


def v12_backend(spark: SparkSession, sf: str) -> DataFrame:
    """The backend that is chosen where the preferred one can't be made or used."""

    def broken() -> plugins.Embedder:
        raise OSError("no server")

    factories = {"a": broken, "b": lambda: lambda texts: [[] for _ in texts], "hash": V.hash_embedder}
    tell = lambda *names: (plugins.choose_embedder(names[0], factories, names[1:]) or ("words only",))[0]
    return spark.createDataFrame([("a b hash", tell("a", "b", "hash")), ("hash", tell("hash")), ("a b", tell("a", "b")), ("none hash", tell("none", "hash"))], "asked string, chosen string")


def v13_codec(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    blob = V.encode_floats(C("embedding"))
    return e.select("vec_id", F.octet_length(blob).alias("bytes"), (V.decode_floats(blob) == C("embedding")).alias("same"))


def b06_expand(spark: SparkSession, sf: str) -> DataFrame:
    """A query that the model answers, one that is in the cache, one that is too old there, and one on which
    the model fails; then the cache without what is too old."""
    now = datetime(2024, 1, 20)
    cache = spark.createDataFrame([("known", "known words", now - timedelta(days=1)), ("old", "old words", now - timedelta(days=8)), ("gone", "gone words", now - timedelta(days=30))], "original string, expanded string, created_at timestamp")
    cache = cache.select(F.xxhash64("original").alias("query_hash"), "original", "expanded", "created_at")

    def model(system: str, q: str) -> str:
        if q == "bad":
            raise OSError("no server")
        return f" more\n{q} "

    said = []
    for q in ("new", "known", "old", "bad"):
        whole, cache = bm25.expand(q, cache, model, now)
        said.append((q, whole))
    left = bm25.expire_cache(cache, F.lit(now)).select("original", "expanded")
    return spark.createDataFrame(said, "original string, expanded string").withColumn("from", F.lit("search")).union(left.withColumn("from", F.lit("cache")))


def c03_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return S.backfill_types(sessions(spark, sf), turns(spark, sf), RULES).groupBy("old", "new").agg(F.count("*").alias("n"))


def g05_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Three quarters of the sessions are stored; the rest is extracted by itself and neighbours in time are
    mended where it falls."""
    s = GQ._sessions(spark, sf)
    nodes, edges = G.build(s.where("conv_id % 4 != 0"))
    nodes, edges = G.extract_incremental(s.where("conv_id % 4 = 0"), s, nodes, edges)
    return edges.select("source", "target", "relation")


def _model(system: str, text: str) -> str:
    """A stand-in for a language model."""
    if "#3," in text:
        raise OSError("no server")
    if "#4," in text:
        return "I can't tell."
    return '{"edges": [{"relation": "discusses_topic", "target_type": "topic", "target_label": "made"}]}'


def g17_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """The outcomes over sessions that have a vault path."""
    s = GQ._sessions(spark, sf).withColumn("body", F.when(C("conv_id") % 10 != 5, C("body"))).withColumn("summary", F.when(C("conv_id") % 10 != 5, C("summary")))
    edges, outcomes = G.ask_semantic(s, _model)
    n = edges.groupBy().agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n")
    return outcomes.groupBy(C("outcome").alias("what")).agg(F.count("*").alias("n")).union(n)


def g14_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions whose extraction had failed, extracted again; who has a stamp then, and which new edges."""
    s = GQ._sessions(spark, sf)
    nodes, edges = G.build(s)
    chosen = P.rebuild_selection(s, retry_failed=True)
    _, edges, stamped, outcomes = G.rebuild(chosen, s, nodes, edges, _model, F.lit(datetime(2024, 5, 1)))
    told = stamped.where("semantic_extracted_at = '2024-05-01'").select("id", F.lit("stamped").alias("what"))
    told = told.union(outcomes.select("id", "outcome"))
    return told.union(edges.where("target = 'topic:made'").select(F.expr("substring(source, 9)"), F.lit("topic")))


def g14_cancelled(spark: SparkSession, sf: str) -> DataFrame:
    """A rebuild that is cancelled at once does nothing."""
    s = GQ._sessions(spark, sf)
    nodes, edges = G.build(s)
    _, after, stamped, outcomes = G.rebuild(s.where("conv_id % 10 = 0"), s, nodes, edges, _model, F.lit(datetime(2024, 5, 1)), lambda: True)
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("stamped", F.lit(stamped.where("semantic_extracted_at = '2024-05-01'").count())).withColumn("edges_more", F.lit(after.count() - edges.count()))


def g16_user_content(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    shown = G.user_content(F.when(C("doc_id") % 2 == 0, F.concat(F.lit("About "), "doc_id")), C("text"), 101)
    return d.select("doc_id", shown.alias("content"))


def _wiki_files(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    s = sessions(spark, sf).withColumn("cwd", F.when(C("conv_id") % 2 == 0, "/vault").otherwise("/w"))
    docs = bm25.build(turns(spark, sf).where("turn_index < 5")).docs
    return s, turns(spark, sf), docs, vectors(spark, sf).withColumn("session_id", F.when(C("vec_id") % 50 == 0, "nobody").otherwise(C("session_id"))), GQ._files(spark, sf), GQ._log(spark, sf), GQ._wiki(spark, sf)


def n11_every_check(spark: SparkSession, sf: str) -> DataFrame:
    s, t, docs, v, files, log, wiki = _wiki_files(spark, sf)
    return N.run_all(s, t, docs, v, files, log, wiki, "/vault").groupBy("code", "severity").agg(F.count("*").alias("n"))


def a16_summary(spark: SparkSession, sf: str) -> DataFrame:
    s, t, docs, v, files, log, wiki = _wiki_files(spark, sf)
    told = N.summary(N.run_all(s, t, docs, v, files, log, wiki, "/vault"), s)
    agents = F.array_join(F.transform(F.map_entries("agents"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return told.select("n_error", "n_warn", "n_info", "total_sessions", agents.alias("agents"))


def n12_fix_invocations(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf).withColumn("cwd", F.when(C("conv_id") % 2 == 0, "/vault").otherwise("/w"))
    return N.fix_invocations(s, N.wiki_invocations(s, "/vault")).select("id", "is_archived")


def n12_move_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Files of no session are moved, and the vault read again."""
    import uuid
    from datetime import date

    from threadmill.sources import vault
    from threadmill.storage import shared_dir

    root = f"{shared_dir(spark)}/threadmill-vault-{uuid.uuid4().hex}"
    s = sessions(spark, sf)
    vault.write(s.select(F.concat(F.lit("raw/"), "id", F.lit(".md")).alias("path"), F.lit("x").alias("markdown")), root).count()
    files = vault.read(spark, root).select("path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("file_id"))
    found = N.orphan_files(files, s.where("conv_id % 6 != 0"))
    vault.move_orphans(found, root, date(2024, 2, 3)).count()
    return vault.read(spark, root).select("path")


def r08_wiki_list(spark: SparkSession, sf: str) -> DataFrame:
    pages = sessions(spark, sf).select(R.page_path(C("project"), C("id")).alias("path"), "conv_id")
    return R.wiki_list(pages).distinct().withColumn("what", F.lit("list")).union(R.wiki_get(pages, "proj3").select("path").distinct().withColumn("what", F.lit("get")))


def r13_job(spark: SparkSession, sf: str) -> DataFrame:
    """A job in memory, one in the table only, one in both, one in neither; and the active ones."""
    e = table(spark, sf, "events").select(C("event_id").cast("string").alias("id"), "event_type", "ts")
    active, stored = e.where("event_id < 3").withColumn("event_type", F.lit("active")), e.where("event_id > 1")
    out = None
    for i in ("1", "2", "7", "none"):
        own = R.job(active, stored, i).select(F.lit(i).alias("asked"), "event_type")
        out = own if out is None else out.union(own)
    return out


def r17_project_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return R.project_prompt(sessions(spark, sf), turns(spark, sf), 300, 700).select("project", F.sha2("prompt", 256).alias("sha"))


def _q(f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> tuple[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return f.__name__, (f, sql)


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from threadmill.plans.text_queries import WORDS_SQL

    s = "with " + SESSIONS_SQL
    words = "with " + TURNS_SQL + ", w as (select unnest(" + WORDS_SQL.format("content") + ") as term from turns)"
    zw = "'​'"
    base, sem, adj = GQ.BASE, GQ.SEM, GQ.ADJ
    adj_pairs = "adj2 as (select id, nxt, relation from adj where nxt is not null)"
    lost = "v2 as (select case when vec_id % 50 = 0 then 'nobody' else session_id end as session_id, turn_index from vectors)"
    l004 = "select distinct 'L004' as code, 'info' as severity, session_id, 'x' as detail from turns t where not exists (select 1 from v2 v where v.session_id = t.session_id and v.turn_index = t.turn_index)"
    l007 = "select 'L007', 'warn', session_id, 'x' from v2 where session_id not in (select id from sessions) group by session_id"
    l005 = "select 'L005', 'error', null, 'x' where (select count(*) from turns) != (select count(*) from turns where turn_index < 5)"
    l011 = "select 'L011', 'info', id, '/vault' from sessions where conv_id % 2 = 0 and agent in ('codex', 'claude-code')"
    l002 = "select 'L002', 'warn', file_id, path from files where not exists (select 1 from sessions where id = file_id or starts_with(id, file_id))"
    every = s + ", " + VECTORS_SQL + GQ.FILES + GQ.WIKI + f", {lost}, f as ({GQ.L001} union all {l002} union all {GQ.L003} union all {l004} union all {l005} union all {l007} union all {GQ.L008} union all {GQ.L009} union all {GQ.L010} union all {l011})"
    failed = "conv_id % 10 = 3"
    shown = bytes_sql("content", 300)
    return dict([
        _q(f02_morphology, words + " select term, count(*) as n from w where length(term) % 2 = 0 group by 1"),
        _q(f03_tags, words + " select term, count(*) as n from w where length(term) % 2 = 1 group by 1"),
        _q(f04_fallback, words + " select term, count(*) as n, 'words' as tokenizer from w group by 1"),
        _q(f10_budget, "with c as (select m::int as model_max, o::int as asked, greatest(1, m - 12) as top from (values (1), (12), (13), (128), (512), (8192)) a(m), (values (null), (1), (10), (600), (99999)) b(o)), s as (select *, case when asked is null then top else least(top, greatest(1, asked)) end as size from c) select model_max, asked, size::int as size, least(75, size - 1)::int as overlap from s"),
        _q(f22_escape, f"select doc_id, sha256(replace(text, '::', ':' || {zw} || ':') || ' k:' || {zw} || ': v `c:: d` e:' || {zw} || ':f' || chr(10) || '```' || chr(10) || 'g:: h' || chr(10) || '```' || chr(10) || '`open:' || {zw} || ': i' || chr(10) || '```' || chr(10) || 'j:: k') as sha, true as back from documents"),
        _q(f32_wiki_dates, "select doc_id, case when doc_id % 2 = 0 then 'c' else 'a' end || doc_id as created, case when doc_id % 3 = 0 then 'u' || doc_id end as updated from documents"),
        _q(f35_links, "select doc_id, sha256('[[the]] ' || replace(replace(replace(text, 'the', chr(1)), 'ing', '[[ing]]'), chr(1), '[[t/the|the]]')) as sha from documents"),
        _q(f41_merge_conflict, "with x as (select doc_id, text, list_distinct(['s' || (doc_id % 5), 's' || (doc_id % 3), 's' || (doc_id % 4)]) as d, ['s' || (doc_id % 5), 's' || (doc_id % 3), 's' || (doc_id % 4)] as l from documents), y as (select doc_id, text, list_filter(l, lambda e, i: list_position(l, e) = i) as u from x) select doc_id, sha256('---' || chr(10) || 'title: Theirs' || chr(10) || 'type: project' || chr(10) || 'sources:' || chr(10) || array_to_string(list_transform(u, lambda e: '  - ' || e), chr(10)) || chr(10) || '---' || chr(10) || text) as sha from y"),
        _q(p05_since, s + ", o as (select * from sessions where not is_archived) select '2024-01-02' as word, id from o where start_time >= '2024-01-02' union all select 'since 2024-01-03', id from o where start_time >= '2024-01-03' union all select 'today', id from o where start_time >= '2024-01-03' union all select 'yesterday', id from o where start_time >= '2024-01-02' and start_time < '2024-01-03' union all select 'last week', id from o where start_time >= '2023-12-27 12:00'"),
        _q(p07_tags, s + " select id, array_to_string(tags, ',') as tags from sessions where session_type != 'automated' and not is_archived and list_contains(tags, 'even') and list_contains(tags, 'three') order by start_time desc, id limit 100"),
        _q(p17_filter, s + " select 'topic' as by, id as session_id from sessions where conv_id % 4 = 1 union all select 'file', id from sessions where conv_id % 3 = 0 and conv_id % 4 = 2 union all select 'issue', id from sessions where conv_id % 10 = 3"),
        _q(j09_ann_metadata, s + ", " + VECTORS_SQL + " select vec_id as query_id, vec_id, session_id, turn_index, agent, project from vectors join sessions on id = session_id where vec_id % 50 = 0 and conv_id % 4 != 1"),
        _q(j10_related, s + adj + ", u as (select id as a, nxt as b, relation as r from adj where nxt is not null union all select nxt, id, relation from adj where nxt is not null), h1 as (select b as id, min(r) as relation, 1 as hop from u where a = '3' and b != '3' group by 1), h2 as (select b as id, min(r) as relation, 2 as hop from u where a in (select id from h1) and b != '3' and b not in (select id from h1) group by 1), h as (select * from h1 union all select * from h2) select id as session_id, relation, hop::int as hop, agent, project from h join sessions using (id) order by hop, relation, session_id limit 50"),
        _q(l06_wiki_order, f"with {PAGES} select path, case when contains(stem, 'the1') then 2.0::double else 1.0 end as score, contains(stem, 'the1') as name_match from p where contains(stem, 'the1') or contains(lower(body), 'the1') order by name_match desc, score desc, path limit 25"),
        _q(l07_semantic_order, f"with {PAGES}, q as (select path, 1 - ({COS.format('p.embedding')}) as score, contains(stem, 'the1') as name_match from p) select path, round(score, 6) + 0.0 as score, name_match from q order by q.score desc, name_match desc, path limit 25"),
        _q(h08_mode_fallback, f"with {PAGES}, k as (select path, case when contains(stem, 'the2') then 2.0::double else 1.0 end as score from p where contains(stem, 'the2') or contains(lower(body), 'the2')) select mode, path, score from k, (values ('hybrid'), ('semantic'), ('keyword')) m(mode)"),
        _q(l09_clamps, "select a::int as asked, least(50, greatest(1, coalesce(a, 10)))::int as clamped from (values (null), (-5), (0), (1), (7), (50), (51), (10000)) v(a)"),
        _q(v04_query_prefix, "select true as query, true as passage, false as same"),
        _q(v11_mean_pool, "select vec_id, round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) + 0.0 as first from embeddings"),
        _q(v12_backend, "select * from (values ('a b hash', 'hash'), ('hash', 'hash'), ('a b', 'words only'), ('none hash', 'words only')) v(asked, chosen)"),
        _q(v13_codec, "select vec_id, (4 * len(embedding))::int as bytes, true as same from embeddings"),
        _q(b06_expand, "select * from (values ('new', 'new more new', 'search'), ('known', 'known words', 'search'), ('old', 'old more old', 'search'), ('bad', 'bad', 'search'), ('new', 'new more new', 'cache'), ('known', 'known words', 'cache'), ('old', 'old more old', 'cache')) v(original, expanded, \"from\")"),
        _q(c03_backfill, s + ", f as (select session_id, arg_min(content, turn_index) as u from turns where role = 'user' group by 1) select session_type as old, case when regexp_matches(u, '^The|^Nicht') then 'wiki' when project = 'proj3' then 'third' when regexp_matches(u, '(?i)thes') then 'long' else 'interactive' end as new, count(*) as n from sessions left join f on session_id = id group by 1, 2"),
        _q(g05_incremental, s + base + sem + adj + f", {adj_pairs} select source, target, relation from base union all select source, target, relation from sem union all select 'session:' || id, 'session:' || nxt, relation from adj2"),
        _q(g17_semantic, s + f", o as (select case when conv_id % 10 = 5 then 'skipped' when {failed} or conv_id % 10 = 4 then 'failed' else 'ok' end as what from sessions where vault_path is not null) select what, count(*) as n from o group by 1 union all select 'edges', count(*) from o where what = 'ok'"),
        _q(g14_rebuild, s + ", o as (select * from sessions where conv_id % 10 = 0 and vault_path is not null) select id, 'stamped' as what from o union all select id, 'ok' from o union all select id, 'topic' from o"),
        _q(g14_cancelled, s + " select 'skipped' as outcome, count(*) as n, 0 as stamped, 0 as edges_more from sessions where conv_id % 10 = 0 and vault_path is not null"),
        _q(g16_user_content, "select doc_id, case when doc_id % 2 = 0 then 'About ' || doc_id || chr(10) || chr(10) else '' end || " + bytes_sql("text", 101) + " as content from documents"),
        _q(n11_every_check, every + " select code, severity, count(*) as n from f group by 1, 2"),
        _q(a16_summary, every + ", a as (select agent, count(*) as n from sessions group by 1) select count(*) filter (severity = 'error') as n_error, count(*) filter (severity = 'warn') as n_warn, count(*) filter (severity = 'info') as n_info, (select count(*) from sessions) as total_sessions, (select string_agg(agent || '=' || n, ',' order by agent) from a) as agents from f"),
        _q(n12_fix_invocations, s + " select id, is_archived or (conv_id % 2 = 0 and agent in ('codex', 'claude-code')) as is_archived from sessions"),
        _q(n12_move_orphans, s + " select case when exists (select 1 from sessions b where b.conv_id % 6 != 0 and (b.id = a.id or (length(a.id) <= 8 and starts_with(b.id, a.id)))) then 'raw/' || id || '.md' else 'archive/orphan-2024-02-03/raw/' || id || '.md' end as path from sessions a"),
        _q(r08_wiki_list, s + " select distinct 'projects/' || project || '.md' as path, 'list' as what from sessions where project is not null union all select 'projects/proj3.md', 'get' from (select 1) where exists (select 1 from sessions where project = 'proj3')"),
        _q(r13_job, "select '1' as asked, 'active' as event_type union all select '2', 'active' union all select '7', event_type from events where event_id = 7"),
        _q(r17_project_prompt, s + f""", l as (select session_id, turn_index, '**' || case role when 'user' then 'User' when 'assistant' then 'Assistant' else 'System' end || '**: ' || {shown} || case when strlen(content) > 300 then '...' else '' end || chr(10) as line from turns),
          u as (select *, sum(strlen(line)) over (partition by session_id order by turn_index rows unbounded preceding) as upto from l), k as (select session_id as id, string_agg(line, '' order by turn_index) || case when max(upto) > 700 then '...(truncated)' || chr(10) else '' end as t from u where upto - strlen(line) <= 700 group by 1)
          select project, sha256('## Project: ' || project || chr(10) || '## Sessions: ' || count(*) || chr(10) || chr(10) || string_agg('### ' || left(id, 8) || ' (' || strftime(start_time, '%Y-%m-%d') || ', ' || turn_count || ' turns, ' || agent || ')' || chr(10) || left(coalesce(summary, '(no summary)'), 200) || chr(10) || chr(10) || coalesce(t || chr(10), ''), '' order by start_time, id)) as sha from sessions left join k using (id) where project is not null group by project"""),
    ])


QUERIES = _queries()
