"""Daily reports, prompts with budgets, reviews, overviews and job views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import text as X
from threadmill.operators import filters as P
from threadmill.operators import sessions as S


def daily(sessions: DataFrame, edges: DataFrame, day: str, prefixes: tuple[str, ...] = P.NOISE_PREFIXES) -> DataFrame:
    """(project, entries, topics) of a day: its sessions without noise by project, in order of time."""
    own = sessions.where(P.on_day(day) & P.daily_noise(prefixes=prefixes))
    entries = S.by_project(own)
    topics = edges.where("relation = 'discusses_topic'").select(F.expr("substring(source, 9)").alias("id"), F.expr("substring(target, locate(':', target) + 1)").alias("topic"))
    named = own.select("id", F.coalesce("project", F.lit("(none)")).alias("project")).join(topics, "id").groupBy("project").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    return entries.join(named, "project", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def daily_totals(sessions: DataFrame, day: str, prefixes: tuple[str, ...] = P.NOISE_PREFIXES) -> DataFrame:
    return sessions.where(P.on_day(day)).agg(F.count("*").alias("total"), F.count_if(P.daily_noise(prefixes=prefixes)).alias("filtered"))


def diary_prompt(entries: DataFrame, budget: int = 400_000) -> DataFrame:
    """One row: a heading for each project and a line for each of its sessions; the oldest are left out
    until the text is within the budget."""
    one = entries.select("project", F.explode("entries").alias("e")).select("project", "e.start_time", "e.id", F.concat(F.lit("- "), F.coalesce("e.summary", F.lit("(no summary)"))).alias("line"))
    w = Window.partitionBy().orderBy(F.desc("start_time"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)  # one day's sessions
    kept = one.withColumn("used", F.sum(F.length("line") + F.length("project") + 8).over(w)).where(F.col("used") <= budget)
    lines = kept.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("start_time", "id", "line"))).alias("l"))
    block = F.concat(F.lit("## "), "project", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return lines.select("project", block.alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("project", "b"))), lambda x: x["b"]), "\n\n").alias("prompt"))


def turn_prompt(turns: DataFrame, budget: int = 3000, each: int = 1000) -> DataFrame:
    """(session_id, prompt): turns under their roles, cut to `each`, up to the budget."""
    own = S.budget_prefix(turns, budget, each)
    parts = own.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn_index", F.concat(F.lit("["), "role", F.lit("] "), "shown").alias("t")))).alias("l"))
    return parts.select("session_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("prompt"))


def project_prompt(sessions: DataFrame, turns: DataFrame, each: int = 1000, stop: int = 3000) -> DataFrame:
    """(project, prompt) for every project: a heading for each of its sessions in order of time, with the
    first 200 characters of its summary's first line, and its turns, each cut to `each` bytes, until
    they are more than `stop` bytes."""
    shown = F.when(F.octet_length("content") > each, F.concat(X.truncate_bytes(F.col("content"), each), F.lit("..."))).otherwise(F.coalesce("content", F.lit("")))
    label = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    line = turns.select("session_id", "turn_index", F.concat(F.lit("**"), label, F.lit("**: "), shown, F.lit("\n")).alias("line"))
    w = Window.partitionBy("session_id").orderBy("turn_index")
    line = line.withColumn("upto", F.sum(F.octet_length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.octet_length("line")).where(F.col("before") <= stop)
    own = line.groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn_index", "line"))).alias("l"), (F.max("upto") > stop).alias("over"))
    told = own.select("id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), ""), F.when(F.col("over"), "...(truncated)\n").otherwise("")).alias("turns"))
    first = F.substring(F.coalesce(F.split("summary", "\n")[0], F.lit("(no summary)")), 1, 200)
    head = F.concat(F.lit("### "), F.substring("id", 1, 8), F.lit(" ("), F.date_format("start_time", "yyyy-MM-dd"), F.lit(", "), F.col("turn_count").cast("string"), F.lit(" turns, "), "agent", F.lit(")\n"), first, F.lit("\n\n"))
    part = F.concat(head, F.coalesce(F.concat("turns", F.lit("\n")), F.lit("")))
    rows = sessions.where("project is not null").join(told, "id", "left").select("project", F.struct("start_time", "id", part.alias("p")).alias("x"))
    g = rows.groupBy("project").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.select("project", F.concat(F.lit("## Project: "), "project", F.lit("\n## Sessions: "), F.size("x").cast("string"), F.lit("\n\n"), F.array_join(F.transform("x", lambda r: r["p"]), "")).alias("prompt"))


def review_source(turns: DataFrame, n: int = 5, each: int = 500, budget: int = 2000) -> DataFrame:
    return turn_prompt(turns.where(F.col("turn_index") < n), budget, each)


def page_path(project: Column, session_id: Column) -> Column:
    """Where a session's wiki page goes."""
    safe = F.nullif(X.wiki_safe(project), F.lit(""))
    return F.coalesce(F.concat(F.lit("projects/"), safe, F.lit(".md")), F.concat(F.lit("sessions/"), F.substring(session_id, 1, 8), F.lit(".md")))


def review(answers: DataFrame) -> DataFrame:
    """(id, approved, n_issues, regenerate) of reviews (id, answer): not approved unless it says so;
    any issue that is an error asks for another page."""
    schema = "approved boolean, issues array<struct<severity:string,message:string>>"
    r = F.from_json(X.json_block(F.col("answer")), schema)
    issues = F.coalesce(r["issues"], F.array().cast("array<struct<severity:string,message:string>>"))
    return answers.select("id", F.coalesce(r["approved"], F.lit(False)).alias("approved"), F.size(issues).alias("n_issues"), F.exists(issues, lambda i: i["severity"] == "error").alias("regenerate"))


def overview(sessions: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of text on what is indexed."""
    s = sessions.agg(F.count("*").alias("s"), F.array_join(F.array_sort(F.collect_set("project")), ", ").alias("p"), F.array_join(F.array_sort(F.collect_set("agent")), ", ").alias("a"))
    n, e, v = (df.agg(F.count("*").alias(c)) for df, c in ((nodes, "n"), (edges, "e"), (vectors.limit(1), "v")))
    text = F.format_string("%d sessions; projects: %s; agents: %s; vectors: %s; graph: %d nodes, %d edges", "s", "p", "a", F.when(F.col("v") > 0, "yes").otherwise("no"), "n", "e")
    return s.crossJoin(n).crossJoin(e).crossJoin(v).select(text.alias("overview"))


def wiki_list(pages: DataFrame) -> DataFrame:
    return pages.where(F.startswith("path", F.lit("projects/"))).select("path").orderBy("path")


def wiki_get(pages: DataFrame, project: str) -> DataFrame:
    return pages.where(F.col("path") == F.concat(F.lit("projects/"), X.wiki_safe(F.lit(project)), F.lit(".md")))


def job(active: DataFrame, stored: DataFrame, job_id: str) -> DataFrame:
    """A job as it is in memory, else as stored."""
    own = active.where(F.col("id") == job_id).withColumn("o", F.lit(0)).unionByName(stored.where(F.col("id") == job_id).withColumn("o", F.lit(1)))
    return own.orderBy("o").limit(1).drop("o")


def recent_jobs(stored: DataFrame, limit: int = 50) -> DataFrame:
    return stored.orderBy(F.desc("started_at"), "id").limit(min(200, max(1, limit)))


def expire_jobs(jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Without finished jobs older than `days`."""
    old = F.col("completed_at").isNotNull() & (F.col("started_at") < now - F.make_interval(days=F.lit(days)))
    return jobs.where(~F.coalesce(old, F.lit(False)))


def latest_status(events: DataFrame) -> DataFrame:
    """(job_id, status, n_events) from job events (job_id, seq, status): the last one counts, except
    that nothing follows completed, failed or interrupted."""
    final = F.col("status").isin("completed", "failed", "interrupted")
    g = events.groupBy("job_id").agg(F.max_by("status", "seq").alias("last"), F.min_by("status", F.when(final, F.col("seq"))).alias("end"), F.count("*").alias("n_events"))
    return g.select("job_id", F.coalesce("end", "last").alias("status"), "n_events")
