"""Queries of full-text, vector and hybrid search, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import text as X
from threadmill.model import QueryItem, SearchFilters
from threadmill.operators import bm25, fusion, graph
from threadmill.operators import vectors as V
from threadmill.plans import saved
from threadmill.plans.saved import sessions
from threadmill.plans.tables import SESSIONS_SQL, TURNS_SQL, VECTORS_SQL, documents_turns, table, tooled_turns, turns, vectors
from threadmill.plans.text_queries import WORDS_SQL

C = F.col
QUERY = "the and of"


def _r(c: Column | str, n: int = 6) -> Column:
    """Rounded, and 0 without a sign."""
    x = F.round(c, n)
    return F.when(x == 0, 0.0).otherwise(x)


def _vector(spark: SparkSession, sf: str, vec_id: int = 7) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where(C("vec_id") == vec_id).select("embedding").first()[0]]


def _scores(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return bm25.scores(saved.document_index(spark, sf), X.query_tokens(QUERY), mode).select("session_id", "turn_index", F.round("score", 6).alias("score"))


def b02_bm25_and(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "and")


def b02_bm25_or(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "or")


def b02_search(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf)
    f = SearchFilters(exclude_session_types=("automated",))
    return bm25.search(saved.turn_index(spark, sf), t, sessions(spark, sf), "the and", 10, f).select("session_id", "turn_index", F.round("score", 6).alias("score"), "snippet")


def b01_postings(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.build(turns(spark, sf)).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def b01_index_text(spark: SparkSession, sf: str) -> DataFrame:
    """Postings over content and tool calls."""
    return bm25.build(tooled_turns(spark, sf)).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def b02_tool_search(spark: SparkSession, sf: str) -> DataFrame:
    """Turns found by what their tools were asked."""
    return bm25.scores(bm25.build(tooled_turns(spark, sf)), X.query_tokens("cargo test tool_user")).select("session_id", "turn_index", F.round("score", 6).alias("score"))


def b07_query_cache(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    cache = e.select(F.xxhash64(F.concat(F.lit("q"), C("user_id"))).alias("query_hash"), C("event_type").alias("original"), C("props").alias("expanded"), C("ts").alias("created_at"))
    return bm25.expand_query("q7", cache, F.lit(datetime(2024, 1, 20)))


def v01_cosine(spark: SparkSession, sf: str) -> DataFrame:
    q = V.literal(_vector(spark, sf))
    return table(spark, sf, "embeddings").select("vec_id", _r(V.cosine_distance(C("embedding"), q)).alias("distance"))


def v02_knn(spark: SparkSession, sf: str) -> DataFrame:
    return V.knn(vectors(spark, sf), _vector(spark, sf), 20, ("vec_id",)).select("vec_id", _r("distance").alias("distance"))


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those of ids that 50 divides as queries."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e, e.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), "embedding")


def v02_knn_all(spark: SparkSession, sf: str) -> DataFrame:
    e, q = _asked(spark, sf)
    return V.knn_join(e, q, 5).select("query_id", "vec_id", _r("distance").alias("distance"))


def v03_knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    f = SearchFilters(agent="codex", since=datetime(2024, 1, 1, 3))
    found = V.search(vectors(spark, sf), turns(spark, sf), sessions(spark, sf), _vector(spark, sf), 10, f)
    return found.select("session_id", "turn_index", _r("score").alias("score"), "snippet")


def v05_ann(spark: SparkSession, sf: str) -> DataFrame:
    return saved.vector_index(spark, sf).search(_asked(spark, sf)[1], 10).select("query_id", "vec_id", _r("distance").alias("distance"))


def v05_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index against the exact join: queries, neighbours found, whether 0.9 of them are right,
    and whether every row is indexed."""
    e, q = _asked(spark, sf)
    index = saved.vector_index(spark, sf)
    exact, found = V.knn_join(e, q, 10).select("query_id", "vec_id"), index.search(q, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_neighbors"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))
    return both.crossJoin(F.broadcast(index.sizes().agg(F.sum("n").alias("n_indexed"))))  # one row each


def v06_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return V.chunks(documents_turns(spark, sf)).select("session_id", "turn_index", "seq", F.length("text").alias("n"))


def v06_index_text(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of content and tool calls."""
    return V.chunks(tooled_turns(spark, sf)).select("session_id", "turn_index", "seq", F.sha2("text", 256).alias("sha"))


def v07_pending(spark: SparkSession, sf: str) -> DataFrame:
    return V.pending(V.chunks(turns(spark, sf)), vectors(spark, sf), "m0").select("session_id", "turn_index", "seq")


def v07_embed(spark: SparkSession, sf: str) -> DataFrame:
    todo = V.pending(V.chunks(turns(spark, sf)), vectors(spark, sf), "hash64")
    return V.embed(todo, V.hash_embedder(), "hash64").groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("session_id", "turn_index").alias("turns"))


def v08_insert(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("session_id", "turn_index", "chunk_seq", "model", "embedding")
    new = v.withColumn("chunk_seq", (C("turn_index") % 2).cast("int"))
    return V.insert_vectors(v, new).groupBy("model").agg(F.count("*").alias("n"))


def v09_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    out = None
    for allow in (True, False):
        state, kept = V.reconcile(v, "m0", allow)
        own = kept.agg(F.count("*").alias("n")).select(F.lit(state).alias("state"), "n")
        out = own if out is None else out.union(own)
    return out


def h01_rrf(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").groupBy(C("l_suppkey").cast("string").alias("session_id"), C("l_linenumber").alias("turn_index")).agg(F.sum("l_quantity").alias("score"))
    b = table(spark, sf, "lineitem").where("l_discount > 0.05").groupBy(C("l_suppkey").cast("string").alias("session_id"), C("l_linenumber").alias("turn_index")).agg(F.max("l_quantity").alias("score"))
    return fusion.rrf({"bm25": a, "vector": b}).select("session_id", "turn_index", F.round("score", 9).alias("score"), "bm25_score", "vector_score")


def h03_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: both searches, fusion, the penalty for short sessions, diversity."""
    t = turns(spark, sf)
    return fusion.hybrid(saved.turn_index(spark, sf), t, sessions(spark, sf), vectors(spark, sf), "the and", _vector(spark, sf), 10).select("session_id", "turn_index", F.round("score", 6).alias("score"))


def h04_multi(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf)
    items = [QueryItem("keyword", "the and"), QueryItem("keyword", "of"), QueryItem("semantic", vector=_vector(spark, sf))]
    return fusion.recall(items, saved.turn_index(spark, sf), t, sessions(spark, sf), vectors(spark, sf), 10).select("session_id", "turn_index", F.round("score", 6).alias("score"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.concat(F.lit("the"), C("doc_id") % 3).alias("stem"), C("text").alias("body"), "doc_id")
    return d.join(table(spark, sf, "embeddings").select(C("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


def h05_wiki_kw(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.wiki_keyword(_pages(spark, sf), "The1")


def h05_wiki_body(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.wiki_keyword(_pages(spark, sf), "tion of")


def h06_wiki_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.wiki_semantic(_pages(spark, sf), _vector(spark, sf), "src3").select("path", _r("score").alias("score"))


def h07_wiki_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    near = fusion.wiki_semantic(p, _vector(spark, sf)).withColumn("score", F.round("score", 9))
    return fusion.wiki_hybrid(fusion.wiki_keyword(p, "the1"), near).select("path", F.round("score", 6).alias("score"))


def h09_related_mix(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf)
    near = graph.neighbors(graph.adjacency(s)).where("id = 'session:6'").select(F.expr("substring(other, 9)").alias("id")).distinct()
    return fusion.related_mix(s, near, "6")


def _q(f, sql: str | None):  # noqa: ANN001, ANN202
    return f.__name__, (f, sql)


def _bm25_sql(source: str, terms: list[str], mode: str) -> str:
    t = ", ".join(f"'{x}'" for x in sorted(terms))
    having = f"having count(*) = {len(terms)}" if mode == "and" else ""
    return f"""w as (select session_id, turn_index, {WORDS_SQL.format("content")} as w from ({source})), docs as (select session_id, turn_index, len(w) as dl from w),
  tf as (select session_id, turn_index, term, count(*) as tf from (select session_id, turn_index, unnest(w) as term from w) where term in ({t}) group by all),
  df as (select term, count(*) as df from tf group by term), st as (select count(*) as n, avg(dl) as avgdl from docs),
  scored as (select session_id, turn_index, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
    from tf join df using (term) join docs using (session_id, turn_index) cross join st group by 1, 2 {having})"""


DOCS = "select source as session_id, doc_id as turn_index, text as content from documents"
TURNS = "select session_id, turn_index, content from turns"
TOOLED = "select session_id, turn_index, coalesce(content, '') || case when turn_index % 3 = 0 then case when coalesce(content, '') = '' then '' else chr(10) || chr(10) end || '[Tool: tool_' || role || '] cargo test case' || turn_index || ' ' || role else '' end as content from turns"
Q7 = "(select embedding from embeddings where vec_id = 7)"
COS = "case when {0} is null or len({0}) != len(" + Q7 + ") then 1.0 else 1 - list_dot_product({0}::double[], " + Q7 + "::double[]) / (sqrt(list_dot_product({0}::double[], {0}::double[])) * sqrt(list_dot_product(" + Q7 + "::double[], " + Q7 + "::double[]))) end"
SV = "with " + SESSIONS_SQL + ", " + VECTORS_SQL


def _best_bm25(terms: list[str], limit: int, name: str) -> str:
    """The normalised best of a search over unarchived sessions."""
    return f", {_bm25_sql(TURNS, terms, 'and').replace('w as', f'{name}w as', 1).replace('from w', f'from {name}w').replace('docs', f'{name}docs').replace('tf as (select', f'{name}tf as (select').replace('from tf', f'from {name}tf').replace(' df as', f' {name}df as').replace('join df', f'join {name}df').replace(' st as', f' {name}st as').replace('cross join st', f'cross join {name}st').replace('scored as', f'{name}scored as')}, {name} as (select *, row_number() over (order by score desc, session_id, turn_index) - 1 as r from {name}scored join sessions s on s.id = session_id and not s.is_archived qualify r < {limit})"


VEC_BEST = f""", vd as (select session_id, turn_index, min({COS.format("embedding")}) as distance from vectors group by 1, 2), vb as (
  select session_id, turn_index, distance, row_number() over (order by distance, session_id, turn_index) as k from vd join sessions s on s.id = session_id and not is_archived where true qualify k <= 30),
  vec as (select session_id, turn_index, row_number() over (order by 1 - distance desc, session_id, turn_index) - 1 as r from vb join turns using (session_id, turn_index))"""
FUSE = """, f as (select session_id, turn_index, sum(1.0 / (60 + r + 1)) as score from ({0}) group by 1, 2), g as (select session_id, turn_index, score * case when turn_count < 3 then 0.5 else 1 end as score from f join sessions on id = session_id),
  n as (select session_id, turn_index, score / max(score) over () as score from g), d as (select *, row_number() over (partition by session_id order by score desc, turn_index) as nth from n)
select session_id, turn_index, round(score, 6) as score from d where nth <= 2 order by d.score desc, session_id, turn_index limit 10"""
PAGES = "p as (select source || '/' || doc_id as path, 'the' || (doc_id % 3) as stem, text as body, embedding from documents left join embeddings on vec_id = doc_id)"
QUERIES = dict([
    _q(b01_postings, "with " + SESSIONS_SQL.split(", sess0")[0] + ", x as (select session_id, turn_index, unnest(" + WORDS_SQL.format("content") + ") as term from turns) select term, count(distinct (session_id, turn_index)) as df, count(*) as cf from x group by term"),
    _q(b01_index_text, "with " + TURNS_SQL + f", s as ({TOOLED}), x as (select session_id, turn_index, unnest(" + WORDS_SQL.format("content") + ") as term from s) select term, count(distinct (session_id, turn_index)) as df, count(*) as cf from x group by term"),
    _q(b02_tool_search, "with " + TURNS_SQL + ", " + _bm25_sql(TOOLED, ["cargo", "test", "tool", "user"], "and") + " select session_id, turn_index, round(score, 6) as score from scored"),
    _q(b02_bm25_and, "with " + _bm25_sql(DOCS, ["the", "and", "of"], "and") + " select session_id, turn_index, round(score, 6) as score from scored"),
    _q(b02_bm25_or, "with " + _bm25_sql(DOCS, ["the", "and", "of"], "or") + " select session_id, turn_index, round(score, 6) as score from scored"),
    _q(b02_search, "with " + SESSIONS_SQL + ", " + _bm25_sql(TURNS, ["the", "and"], "and") + """, best as (select session_id, turn_index, score from scored join sessions on id = session_id where not is_archived and (session_type is null or session_type != 'automated') order by score desc, session_id, turn_index limit 10)
      select session_id, turn_index, round(score / max(score) over (), 6) as score, case when length(content) <= 200 then content else substr(content, (case when position('the and' in lower(content)) > 0 then greatest(position('the and' in lower(content)) - 31, 0) else 0 end + 1)::int, 200) end as snippet from best join turns using (session_id, turn_index)"""),
    _q(b07_query_cache, "select event_type as original, props as expanded from events where user_id = 7 and ts + interval 7 day > timestamp '2024-01-20'"),
    _q(v01_cosine, f"select vec_id, round({COS.format('embedding')}, 6) + 0.0 as distance from embeddings"),
    _q(v02_knn, f"select vec_id, round({COS.format('embedding')}, 6) + 0.0 as distance from embeddings order by {COS.format('embedding')}, vec_id limit 20"),
    _q(v02_knn_all, "with e as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings), d as (select a.vec_id as query_id, b.vec_id, 1 - list_dot_product(a.e, b.e) / (a.n * b.n) as distance from e a, e b where a.vec_id % 50 = 0) select query_id, vec_id, round(distance, 6) + 0.0 as distance from d qualify row_number() over (partition by query_id order by round(distance, 12), vec_id) <= 5"),
    _q(v03_knn_filtered, SV + f", vd as (select session_id, turn_index, min({COS.format('embedding')}) as distance from vectors group by 1, 2), b as (select session_id, turn_index, distance from vd join sessions on id = session_id where not is_archived and agent = 'codex' and start_time >= '2024-01-01 03:00' order by distance, session_id, turn_index limit 10) select session_id, turn_index, round(1 - distance, 6) + 0.0 as score, left(content, 200) as snippet from b join turns using (session_id, turn_index)"),
    _q(v05_ann, None),
    _q(v05_recall, "select count(*) filter (vec_id % 50 = 0) as n_queries, 10 * count(*) filter (vec_id % 50 = 0) as n_neighbors, true as enough, count(*) as n_indexed from embeddings"),
    _q(v06_chunks, "select source as session_id, doc_id as turn_index, i::int as seq, length(substr(text, (i * 850 + 1)::int, 1000))::int as n from (select source, doc_id, text, unnest(range(0, greatest(ceil((length(text) - 1000) / 850.0), 0)::bigint + 1)) as i from documents where text != '')"),
    _q(v06_index_text, "with " + TURNS_SQL + f", s as ({TOOLED}) select session_id, turn_index, i::int as seq, sha256(substr(content, (i * 850 + 1)::int, 1000)) as sha from (select session_id, turn_index, content, unnest(range(0, greatest(ceil((length(content) - 1000) / 850.0), 0)::bigint + 1)) as i from s where content != '')"),
    _q(v07_pending, "with " + SESSIONS_SQL.split(", sess0")[0] + ", " + VECTORS_SQL + ", c as (select session_id, turn_index, unnest(range(0, greatest(ceil((length(content) - 1000) / 850.0), 0)::bigint + 1))::int as seq from turns where content != '') select session_id, turn_index, seq from c where (session_id, turn_index, seq) not in (select session_id, turn_index, chunk_seq from vectors where model = 'm0')"),
    _q(v07_embed, "with c as (select conv_id, turn, unnest(range(0, greatest(ceil((length(text) - 1000) / 850.0), 0)::bigint + 1)) as seq from conversations where text != '') select 'hash64' as model, count(*) as n, count(distinct (conv_id, turn)) as turns from c"),
    _q(v08_insert, "with " + VECTORS_SQL + ", k as (select session_id, turn_index, chunk_seq, model from vectors) select model, (select count(*) from k a where a.model = k.model) + count(*) filter (turn_index % 2 = 1) as n from k group by model"),
    _q(v09_reconcile, "with " + VECTORS_SQL + " select 'wiped' as state, count(*) as n from vectors where model = 'm0' union all select 'refused', count(*) from vectors"),
    _q(h01_rrf, """with a as (select cast(l_suppkey as varchar) as session_id, l_linenumber as turn_index, sum(l_quantity) as s from lineitem group by 1, 2), b as (select cast(l_suppkey as varchar) as session_id, l_linenumber as turn_index, max(l_quantity) as s from lineitem where l_discount > 0.05 group by 1, 2),
      x as (select session_id, turn_index, 1.0 / (60 + row_number() over (order by s desc, session_id, turn_index)) as p, s as bm25_score, null::double as vector_score from a union all select session_id, turn_index, 1.0 / (60 + row_number() over (order by s desc, session_id, turn_index)), null, s from b),
      g as (select session_id, turn_index, sum(p) as score, max(bm25_score) as bm25_score, max(vector_score) as vector_score from x group by 1, 2) select session_id, turn_index, round(score / max(score) over (), 9) as score, bm25_score, vector_score from g"""),
    _q(h03_hybrid, SV + _best_bm25(["the", "and"], 30, "a") + VEC_BEST + FUSE.format("select session_id, turn_index, r from a union all select session_id, turn_index, r from vec")),
    _q(h04_multi, SV + _best_bm25(["the", "and"], 30, "a") + _best_bm25(["of"], 30, "b") + VEC_BEST + ", ab as (select session_id, turn_index, score / max(score) over () as score from a union all select session_id, turn_index, score / max(score) over () from b), abr as (select session_id, turn_index, row_number() over (order by score desc, session_id, turn_index) - 1 as r from ab)" + FUSE.format("select session_id, turn_index, r from abr union all select session_id, turn_index, r from vec")),
    _q(h05_wiki_kw, f"with {PAGES} select path, case when contains(stem, 'the1') then 2.0::double else 1.0 end as score, contains(stem, 'the1') as name_match from p where contains(stem, 'the1') or contains(lower(body), 'the1')"),
    _q(h05_wiki_body, f"with {PAGES} select path, 1.0::double as score, false as name_match from p where contains(lower(body), 'tion of')"),
    _q(h06_wiki_semantic, f"with {PAGES} select path, round(1 - ({COS.format('p.embedding')}), 6) + 0.0 as score from p where starts_with(path, 'src3/')"),
    _q(h07_wiki_hybrid, f"""with {PAGES}, k as (select path, case when contains(stem, 'the1') then 2.0 else 1.0 end as s from p where contains(stem, 'the1') or contains(lower(body), 'the1')), v as (select path, round(1 - ({COS.format('p.embedding')}), 9) as s from p),
      x as (select path, 1.0 / (60 + row_number() over (order by s desc, path)) as p from k union all select path, 1.0 / (60 + row_number() over (order by s desc, path)) from v), g as (select path, sum(p) as score from x group by 1) select path, round(score / max(score) over (), 6) as score from g"""),
    _q(h09_related_mix, "with " + SESSIONS_SQL + """, adj as (select id as a, lead(id) over (partition by project order by start_time, id) as b from sessions where project is not null union all select id, lead(id) over (partition by start_time::date order by start_time, id) from sessions),
      near as (select b as id from adj where a = '6' and b is not null union select a from adj where b = '6'), me as (select project, tags[1] as t from sessions where id = '6'), x as (select * from (select id, 0 as o from near order by id limit 5) union all select * from (select s.id, 1 from sessions s, me where s.id != '6' and s.project = me.project order by start_time desc, id limit 5)
      union all select * from (select s.id, 2 from sessions s, me where s.id != '6' and list_contains(s.tags, me.t) order by start_time desc, id limit 5)) select id, (['graph', 'project', 'tag'])[min(o) + 1] as origin from x group by id order by min(o), id limit 10"""),
])
