"""Wiki vectors, outcomes of runs, versions of tables, forms of output."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions import text as X


def wiki_changes(pages: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """(path, action, content_hash) of wiki vectors (path, content_hash, model_id): embed where text or
    model is new, skip where neither is, delete where the page has gone."""
    now = pages.select("path", F.sha2("body", 256).alias("content_hash"))
    old = stored.select("path", F.col("content_hash").alias("old_hash"), F.col("model_id").alias("old_model"), F.lit(True).alias("there"))
    both = now.join(old, "path", "full")
    action = F.when(F.col("content_hash").isNull(), "delete").when(F.col("there") & (F.col("old_hash") == F.col("content_hash")) & (F.col("old_model") == model), "skip").otherwise("embed")
    return both.select("path", action.alias("action"), F.coalesce("content_hash", "old_hash").alias("content_hash"))


def apply_wiki_changes(stored: DataFrame, changes: DataFrame, made: DataFrame) -> DataFrame:
    """The stored vectors that stay, and those made (path, content_hash, model_id, embedding)."""
    return stored.join(changes.where("action = 'skip'").select("path"), "path", "left_semi").unionByName(made.select(*stored.columns))


def outcomes(results: DataFrame, column: str = "outcome") -> DataFrame:
    return results.groupBy(column).agg(F.count("*").alias("n"))


def run_status(results: DataFrame) -> DataFrame:
    """(ok, failed, status): failed only if something failed and nothing went well."""
    g = results.agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return g.withColumn("status", F.when((F.col("failed") > 0) & (F.col("ok") == 0), "failed").when(F.col("failed") > 0, "partial").otherwise("ok"))


def stamp(sessions: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """semantic_extracted_at set for the sessions (id, outcome) that went well; others keep theirs."""
    ok = results.where("outcome = 'ok'").select("id", F.lit(True).alias("hit"))
    return sessions.join(ok, "id", "left").withColumn("semantic_extracted_at", F.when(F.col("hit"), at).otherwise(F.col("semantic_extracted_at"))).drop("hit")


def local_since(day: str, zone: str) -> datetime:
    """Midnight of a day in a time zone, or an instant as it is."""
    t = datetime.fromisoformat(day)
    return t if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone))


Migration = Callable[[DataFrame], DataFrame]


def _add(**columns: tuple[object, str]) -> Migration:
    return lambda df: df.withColumns({n: F.lit(v).cast(t) for n, (v, t) in columns.items() if n not in df.columns})


#: What each version added to sessions; a step that was done already changes nothing.
MIGRATIONS: dict[int, Migration] = {
    2: _add(status=("raw", "string")),
    3: _add(session_type=("interactive", "string")),
    4: _add(is_favorite=(False, "boolean")),
    5: _add(notes=(None, "string")),
    6: _add(semantic_extracted_at=(None, "timestamp")),
    7: _add(is_archived=(False, "boolean"), archived_at=(None, "timestamp")),
    8: _add(source_size=(None, "bigint"), source_mtime=(None, "timestamp")),
}


def migrate(sessions: DataFrame, version: int) -> tuple[DataFrame, int]:
    """Sessions of a version brought to the newest."""
    for v in sorted(MIGRATIONS):
        if v > version:
            sessions = MIGRATIONS[v](sessions)
    return sessions, max(MIGRATIONS)


def as_text(results: DataFrame) -> DataFrame:
    """One line for each result (session_id, turn_index, score, snippet), best first."""
    line = F.format_string("%.2f  %s:%d  %s", "score", "session_id", "turn_index", F.regexp_replace(F.coalesce("snippet", F.lit("")), r"\s+", " "))
    return results.orderBy(F.desc("score"), "session_id", "turn_index").select(line.alias("line"))


def as_json(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("score"), "session_id", "turn_index").select(F.to_json(F.struct(*results.columns)).alias("json"))


def wiki_dates(text: Column) -> tuple[Column, Column]:
    h = X.frontmatter(text)
    return F.coalesce(X.yaml_field(h, "created_at"), X.yaml_field(h, "created")), F.coalesce(X.yaml_field(h, "updated_at"), X.yaml_field(h, "updated"))


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.substring_index("path", "/", 1).alias("category")).agg(F.count("*").alias("n"))


def project_prompts(sessions: DataFrame, turn_prompts: DataFrame, since: Column, budget: int = 3000) -> DataFrame:
    """(id, prompt) for each project's sessions since a time: a line of at most 200 characters and the
    turns of each, in order of time."""
    own = sessions.where((F.col("start_time") >= since) & F.col("project").isNotNull())
    part = F.concat(F.lit("### "), F.substring(F.coalesce("summary", F.lit("")), 1, 200), F.lit("\n"), F.substring(F.coalesce("prompt", F.lit("")), 1, budget))
    rows = own.join(turn_prompts.withColumnRenamed("session_id", "id"), "id", "left").select("project", F.struct("start_time", "id", part.alias("p")).alias("x"))
    g = rows.groupBy("project").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.select(F.col("project").alias("id"), F.array_join(F.transform("x", lambda r: r["p"]), "\n\n").alias("prompt"))
