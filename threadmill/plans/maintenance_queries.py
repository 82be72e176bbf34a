"""Queries of wiki vectors, outcomes, versions and prompts, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators import filters as P
from threadmill.operators import maintenance as M
from threadmill.operators import reports as R
from threadmill.plans.tables import SESSIONS_SQL, bytes_sql, sessions, table, turns

C = F.col


def _wiki(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select(F.concat(F.lit("p/"), "doc_id").alias("path"), C("text").alias("body"), "doc_id", "lang")
    old = d.join(table(spark, sf, "labels"), "doc_id").select(
        "path", F.sha2(F.when(C("quality") == 0, F.concat("body", F.lit("x"))).otherwise(C("body")), 256).alias("content_hash"),
        F.when(C("toxic") == 1, "old").otherwise("new").alias("model_id"), F.array(F.lit(1.0)).alias("embedding"),
    )
    return d.where("lang != 'de'"), old


def m08_wiki_vectors(spark: SparkSession, sf: str) -> DataFrame:
    pages, old = _wiki(spark, sf)
    return M.wiki_changes(pages, old, "new").select("path", "action")


def m08_wiki_apply(spark: SparkSession, sf: str) -> DataFrame:
    pages, old = _wiki(spark, sf)
    changes = M.wiki_changes(pages, old, "new")
    made = changes.where("action = 'embed'").select("path", "content_hash", F.lit("new").alias("model_id"), F.array(F.lit(2.0)).alias("embedding"))
    return M.apply_wiki_changes(old, changes, made).select("path", "content_hash", F.element_at("embedding", 1).alias("v"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).select("id", F.when(C("conv_id") % 4 == 0, "failed").when(C("conv_id") % 5 == 0, "skipped").otherwise("ok").alias("outcome"))


def g14_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return M.outcomes(_results(spark, sf))


def g14_stamp(spark: SparkSession, sf: str) -> DataFrame:
    return M.stamp(sessions(spark, sf).select("id", "semantic_extracted_at"), _results(spark, sf), F.lit(datetime(2024, 3, 1)))


def v10_run_status(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf)
    return M.run_status(r).withColumn("what", F.lit("all")).union(M.run_status(r.where("outcome = 'failed'")).withColumn("what", F.lit("failed"))).union(M.run_status(r.where("outcome = 'ok'")).withColumn("what", F.lit("ok")))


def p09_local_since(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).where(C("start_time") >= F.lit(M.local_since("2024-01-02", "Asia/Seoul"))).select("id")


def p14_embeddable(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).withColumn("content", F.when(C("turn_index") % 3 != 0, C("content"))).withColumn("actions", F.when(C("turn_index") % 2 == 0, F.array(F.lit("a"))))
    return t.where(P.embeddable()).select("session_id", "turn_index")


def m09_migrate(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions(spark, sf).select("id", "is_archived")
    return M.migrate(s, 1)[0].select("id", "is_archived", "session_type", "status", "is_favorite", "source_size")


def s26_text(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf)
    return M.as_text(t.select("session_id", "turn_index", (1 / (1.1 + C("turn_index"))).alias("score"), C("content").alias("snippet")))


def r03_project_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return M.project_prompts(sessions(spark, sf), R.turn_prompt(turns(spark, sf)), F.lit(datetime(2024, 1, 1, 3))).select("id", F.sha2("prompt", 256).alias("sha"))


def r12_page_count(spark: SparkSession, sf: str) -> DataFrame:
    return M.page_count(table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path")))


def _q(f, sql: str):  # noqa: ANN001, ANN202
    return f.__name__, (f, sql)


ACTION = "case when lang = 'de' then 'delete' when quality = 1 and toxic = 0 then 'skip' else 'embed' end"
RES = "res as (select id, conv_id, semantic_extracted_at, case when conv_id % 4 = 0 then 'failed' when conv_id % 5 = 0 then 'skipped' else 'ok' end as outcome from sessions)"
PREFIX = "b as (select *, coalesce(sum(strlen(" + bytes_sql("content", 1000) + ")) over (partition by session_id order by turn_index rows between unbounded preceding and 1 preceding), 0) as before from turns), pr as (select session_id, string_agg('[' || role || '] ' || " + bytes_sql("content", 1000) + ", chr(10) order by turn_index) as prompt from b where before <= 3000 group by 1)"
S_ = "with " + SESSIONS_SQL
QUERIES = dict([
    _q(m08_wiki_vectors, f"select 'p/' || doc_id as path, {ACTION} as action from documents left join labels using (doc_id) where lang != 'de' or quality is not null"),
    _q(m08_wiki_apply, f"select 'p/' || doc_id as path, sha256(text) as content_hash, case when {ACTION} = 'skip' then 1.0::double else 2.0 end as v from documents left join labels using (doc_id) where {ACTION} != 'delete'"),
    _q(g14_outcomes, S_ + f", {RES} select outcome, count(*) as n from res group by 1"),
    _q(g14_stamp, S_ + f", {RES} select id, case when outcome = 'ok' then timestamp '2024-03-01' else semantic_extracted_at end as semantic_extracted_at from res"),
    _q(v10_run_status, S_ + f", {RES}, c as (select count(*) filter (outcome = 'ok') as ok, count(*) filter (outcome = 'failed') as failed from res) select ok, failed, 'partial' as status, 'all' as what from c union all select 0, failed, 'failed', 'failed' from c union all select ok, 0, 'ok', 'ok' from c"),
    _q(p09_local_since, S_ + " select id from sessions where start_time >= timestamp '2024-01-01 15:00'"),
    _q(p14_embeddable, "select cast(conv_id as varchar) as session_id, turn::int as turn_index from conversations where (turn % 3 != 0 and coalesce(text, '') != '') or turn % 2 = 0"),
    _q(m09_migrate, S_ + " select id, is_archived, 'interactive' as session_type, 'raw' as status, false as is_favorite, null::bigint as source_size from sessions"),
    _q(s26_text, r"select printf('%.2f', 1.0 / (1.1 + turn)) || '  ' || conv_id || ':' || turn || '  ' || regexp_replace(text, '\s+', ' ', 'g') as line from conversations"),
    _q(r03_project_prompts, S_ + f", {PREFIX} select project as id, sha256(string_agg('### ' || left(coalesce(summary, ''), 200) || chr(10) || left(coalesce(prompt, ''), 3000), chr(10) || chr(10) order by start_time, id)) as sha from sessions left join pr on session_id = id where project is not null and start_time >= '2024-01-01 03:00' group by 1"),
    _q(r12_page_count, "select source as category, count(*) as n from documents group by 1"),
])
