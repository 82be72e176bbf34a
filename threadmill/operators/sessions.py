"""Aggregates, listings, classification and maintenance of sessions and turns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import text as X


# aggregates


def session_aggregates(turns: DataFrame) -> DataFrame:
    """What is kept of a session's turns (session_id, turn_index, role, content, and where they are
    there tokens and tool_names): counts, sums, distinct tools, summary."""
    user = F.when(F.col("role") == "user", F.col("turn_index"))
    extra = []
    if "tokens" in turns.columns:
        extra += [F.coalesce(F.sum("tokens.input"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens.output"), F.lit(0)).alias("tokens_out")]
    if "tool_names" in turns.columns:
        extra += [F.array_sort(F.array_distinct(F.flatten(F.collect_set("tool_names")))).alias("tools_used")]
    g = turns.groupBy("session_id").agg(F.count("*").alias("turn_count"), F.min_by("content", user).alias("first_user"), *extra)
    return g.withColumn("summary", X.first_line(F.col("first_user"))).drop("first_user")


def role_histogram(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(*[F.count_if(F.col("role") == r).alias(f"{r}_turns") for r in ("user", "assistant", "system")])


def top_tools(turns: DataFrame, n: int = 8) -> DataFrame:
    """(session_id, tool, uses): the n most used tools of each session, ties by name."""
    uses = turns.select("session_id", F.explode("tool_names").alias("tool")).groupBy("session_id", "tool").agg(F.count("*").alias("uses"))
    w = Window.partitionBy("session_id").orderBy(F.desc("uses"), "tool")
    return uses.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def tag_counts(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def agent_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("agent").agg(F.count("*").alias("n"))


def duplicate_ingests(log: DataFrame) -> DataFrame:
    """Sessions that were ingested more than once."""
    return log.where("action = 'ingest'").groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1")


def dedup_vectors(vectors: DataFrame, keys: tuple[str, ...] = ("session_id", "turn_index", "chunk_seq", "model"), order: str = "vec_id") -> DataFrame:
    """The row of least `order` for each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return vectors.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def status(sessions: DataFrame, turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: counts of everything, and the share of embeddable turns that have a vector."""
    can = F.coalesce(F.col("content"), F.lit("")) != ""
    s = sessions.agg(F.count("*").alias("sessions"))
    t = turns.agg(F.count("*").alias("turns"), F.count_if(can).alias("embeddable"))
    v = vectors.agg(F.count("*").alias("vectors"), F.count_distinct("session_id", "turn_index").alias("embedded"))
    share = F.when(F.col("embeddable") > 0, 100 * F.col("embedded") / F.col("embeddable")).otherwise(100.0)
    return s.crossJoin(t).crossJoin(v).withColumn("coverage", share)


def projects(sessions: DataFrame) -> DataFrame:
    return sessions.where("project is not null").select("project").distinct()


def by_project(sessions: DataFrame, none: str = "(none)") -> DataFrame:
    """(project, entries): the sessions of each project in order of time."""
    entry = F.struct("start_time", "id", "summary")
    return sessions.groupBy(F.coalesce("project", F.lit(none)).alias("project")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def latest(sessions: DataFrame) -> DataFrame:
    """The start node of a graph view."""
    return sessions.orderBy(F.desc("start_time"), "id").limit(1).select(F.when(F.startswith("id", F.lit("session:")), F.col("id")).otherwise(F.concat(F.lit("session:"), "id")).alias("node"))


def first_user_turn(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "turn_index").alias("content"), F.min("turn_index").alias("turn_index"))


# windows


def role_runs(turns: DataFrame) -> DataFrame:
    """Whether a turn starts a run of its role, and the number of the run."""
    w = Window.partitionBy("session_id").orderBy("turn_index")
    new = F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True))
    return turns.withColumn("starts", new).withColumn("run", F.sum(F.col("starts").cast("int")).over(w))


def carry_forward(turns: DataFrame, column: str) -> DataFrame:
    """Nulls filled with the last value before them in the session."""
    w = Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn(column, F.last(column, ignorenulls=True).over(w))


def merge_islands(events: DataFrame, key: str, order: str, value: Column, by: str = "session_id") -> DataFrame:
    """Consecutive events of one key as one: values joined by blank lines, the first order kept."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce(~F.col(key).eqNullSafe(F.lag(key).over(w)), F.lit(True)) | F.col(key).isNull()
    runs = events.withColumn("run", F.sum(new.cast("int")).over(w))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return runs.groupBy(by, "run").agg(F.min(order).alias(order), F.min(key).alias(key), F.array_join(F.transform(parts, lambda x: x["v"]), "\n\n").alias("merged"), F.count("*").alias("n"))


def budget_suffix(entries: DataFrame, budget: int, by: str, order: str, length: Column) -> DataFrame:
    """The newest entries of each group whose lengths sum to at most the budget."""
    w = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("used", F.sum(length).over(w)).where(F.col("used") <= budget)


def budget_prefix(turns: DataFrame, budget: int = 3000, each: int = 1000, by: str = "session_id", order: str = "turn_index", content: str = "content") -> DataFrame:
    """Turns in order, each cut to `each` bytes at the end of a character, until more than `budget` bytes
    are used; the one that goes over is the last."""
    cut = turns.withColumn("shown", X.truncate_bytes(F.col(content), each))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("before", F.coalesce(F.sum(F.octet_length("shown")).over(w), F.lit(0))).where(F.col("before") <= budget)


# classification


@dataclass(frozen=True)
class Rule:
    type: str
    pattern: str | None = None
    project: str | None = None

    def __post_init__(self) -> None:
        if self.pattern is None and self.project is None:
            raise ValueError(f"the rule for {self.type} has neither pattern nor project")
        if self.pattern is not None:
            re.compile(self.pattern)


def classify(rules: list[Rule], first_user: Column, project: Column, default: str = "interactive") -> Column:
    """The type of the first rule that matches."""
    out = None
    for r in rules:
        hit = F.coalesce(first_user.rlike(r.pattern) if r.pattern is not None else F.lit(False), F.lit(False))
        if r.project is not None:
            hit = hit | F.coalesce(project == r.project, F.lit(False))
        out = F.when(hit, r.type) if out is None else out.when(hit, r.type)
    return F.lit(default) if out is None else out.otherwise(default)


def backfill_types(sessions: DataFrame, turns: DataFrame, rules: list[Rule], default: str = "interactive") -> DataFrame:
    """(id, old, new) of every session."""
    first = first_user_turn(turns).select(F.col("session_id").alias("id"), F.col("content").alias("first_user"))
    return sessions.join(first, "id", "left").select("id", F.col("session_type").alias("old"), classify(rules, F.col("first_user"), F.col("project"), default).alias("new"))


# maintenance: tables are rewritten by joins, as Parquet has no update


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", refreshed: tuple[str, ...] = ("end_time", "turn_count", "tokens_in", "tokens_out", "tools_used"), kept_new: tuple[str, ...] = ("model",)) -> DataFrame:
    """Stored rows with `refreshed` taken from new ones, and `kept_new` where they aren't null there;
    all else stays. New keys are added."""
    old, fresh = stored.alias("o"), new.alias("n")

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        if c not in new.columns:
            return F.col(f"o.{c}").alias(c)
        have, come = F.col(f"o.{c}"), F.col(f"n.{c}")
        there, comes = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
        if c in refreshed:
            return F.when(comes, come).otherwise(have).alias(c)
        if c in kept_new:
            return F.coalesce(come, have).alias(c)
        return F.when(there, have).otherwise(come).alias(c)

    return old.join(fresh, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[pick(c) for c in stored.columns])


def insert_ignore(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("session_id", "turn_index")) -> tuple[DataFrame, DataFrame]:
    """Stored rows with those of `new` whose keys aren't stored, and these alone."""
    added = new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns)
    return stored.unionByName(added), added


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame, cascade_graph: bool = False) -> dict[str, DataFrame]:
    """Every table without the sessions of `gone` (session_id). Graph rows stay unless asked for."""
    out = {}
    for name, df in tables.items():
        if name in ("nodes", "edges"):
            if not cascade_graph:
                out[name] = df
                continue
            node = gone.select(F.concat(F.lit("session:"), "session_id").alias("x"))
            for c in ("id",) if name == "nodes" else ("source", "target"):
                df = df.join(node, df[c] == node["x"], "left_anti")
            out[name] = df
        else:
            c = "id" if name == "sessions" else "session_id"
            out[name] = df.join(gone.select(F.col("session_id").alias(c)), c, "left_anti")
    return out


def set_fields(sessions: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """`column` set from changes (id, value); others stay."""
    return sessions.join(changes.select("id", F.col("value"), F.lit(True).alias("hit")), "id", "left").withColumn(column, F.when(F.col("hit"), F.col("value")).otherwise(F.col(column))).select(*sessions.columns)


def set_archived(sessions: DataFrame, ids: DataFrame, archived: bool, at: Column) -> DataFrame:
    """Archives or restores; a session that is so already keeps its time."""
    hit = sessions.join(ids.select("id", F.lit(True).alias("hit")), "id", "left")
    change = F.coalesce("hit", F.lit(False)) & (F.coalesce("is_archived", F.lit(False)) != archived)
    when = F.when(change, at if archived else F.lit(None).cast("timestamp")).otherwise(F.col("archived_at"))
    return hit.withColumn("archived_at", when).withColumn("is_archived", F.when(F.coalesce("hit", F.lit(False)), archived).otherwise(F.col("is_archived"))).select(*sessions.columns)


def relative_paths(sessions: DataFrame, root: str) -> DataFrame:
    prefix = root if root.endswith("/") else root + "/"
    return sessions.withColumn("vault_path", F.when(F.startswith("vault_path", F.lit(prefix)), F.expr(f"substring(vault_path, {len(prefix) + 1})")).otherwise(F.col("vault_path")))


def source_changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, changed): size and time against the last snapshot; files not seen before are changed."""
    old = stored.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    return files.join(old, "path", "left").select("path", (~same).alias("changed"))


APPEND_ONLY = ("claude-code", "codex")


def decide_reingest(agent: Column, parsed: Column, stored: Column) -> Column:
    """rebuild, incremental or skip."""
    return (
        F.when((parsed > stored + 10) & (parsed > 2 * stored), "rebuild")
        .when(agent.isin(*APPEND_ONLY) & (parsed > stored), "incremental")
        .when(agent.isin(*APPEND_ONLY) & (parsed == stored), "skip")
        .otherwise("rebuild")
    )


def summary_backfill(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, summary, outcome): filled where it was null and a user turn has text."""
    first = first_user_turn(turns).select(F.col("session_id").alias("id"), X.first_line(F.col("content")).alias("made"))
    outcome = F.when(F.col("summary").isNotNull(), "kept").when(F.col("made").isNotNull(), "filled").otherwise("no user turn")
    return sessions.join(first, "id", "left").select("id", F.coalesce("summary", "made").alias("summary"), outcome.alias("outcome"))


def with_turns(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with their ordered turns as an array."""
    own = turns.groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn_index", "role", "content"))).alias("turns"))
    return sessions.join(own, "id", "left")


def detail(sessions: DataFrame, turns: DataFrame, full: bool = False) -> DataFrame:
    """Metadata, role counts and, with `full`, all turns under headings of their roles."""
    out = sessions.join(role_histogram(turns).withColumnRenamed("session_id", "id"), "id", "left")
    if full:
        own = turns.groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn_index", "role", "content"))).alias("t"))
        text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), F.coalesce(x["content"], F.lit("")))), "\n\n")
        out = out.join(own, "id", "left").withColumn("content", text).drop("t")
    return out
