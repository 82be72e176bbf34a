"""Integrity checks: each gives findings (code, severity, session_id, detail); all are one union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions import text as X
from threadmill.operators.sessions import agent_counts, duplicate_ingests

REQUIRED = ("title", "type", "sources")


def _finding(df: DataFrame, code: str, severity: str, session_id: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), session_id.alias("session_id"), detail.alias("detail"))


def vault_files(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """L001: no path, or a path without a file."""
    gone = sessions.join(files.select(F.col("path").alias("vault_path")), "vault_path", "left_anti")
    return _finding(gone, "L001", "error", F.col("id"), F.when(F.col("vault_path").isNull(), "no path").otherwise(F.concat(F.lit("missing "), "vault_path")))


def orphan_files(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """L002: files (path, file_id) of no session; an id of at most 8 characters may start a session's id."""
    prefix = sessions.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("id"), F.lit(8))), lambda n: F.substring(F.col("id"), F.lit(1), n))).alias("file_id"))
    known = prefix.union(sessions.select(F.col("id").alias("file_id"))).distinct()
    return _finding(files.join(known, "file_id", "left_anti"), "L002", "warn", F.col("file_id"), F.col("path"))


def duplicates(log: DataFrame) -> DataFrame:
    return _finding(duplicate_ingests(log), "L003", "error", F.col("session_id"), F.concat(F.col("n").cast("string"), F.lit(" ingests")))


def missing_embeddings(turns: DataFrame, vectors: DataFrame) -> DataFrame:
    missing = turns.join(vectors.select("session_id", "turn_index"), ["session_id", "turn_index"], "left_anti").select("session_id").distinct()
    return _finding(missing, "L004", "info", F.col("session_id"), F.lit("turns without vectors"))


def index_counts(turns: DataFrame, docs: DataFrame) -> DataFrame:
    """L005: as many indexed turns as turns."""
    both = turns.agg(F.count("*").alias("t")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("d"))))  # one row each
    return _finding(both.where("t != d"), "L005", "error", F.lit(None).cast("string"), F.concat(F.col("t").cast("string"), F.lit(" turns, "), F.col("d").cast("string"), F.lit(" indexed")))


def orphan_vectors(vectors: DataFrame, sessions: DataFrame) -> DataFrame:
    lost = vectors.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("n"))
    return _finding(lost, "L007", "warn", F.col("session_id"), F.concat(F.col("n").cast("string"), F.lit(" vectors")))


def wiki_frontmatter(pages: DataFrame) -> DataFrame:
    """L008: pages (path, text) without frontmatter, or without one of its fields."""
    head = X.frontmatter(F.col("text"))
    has = lambda k: F.regexp_like(head, F.lit(rf"(?m)^{k}:"))
    lacks = F.when(head == "", F.array(F.lit("frontmatter"))).otherwise(F.filter(F.array(*[F.when(~has(k), F.lit(k)) for k in REQUIRED]), lambda k: k.isNotNull()))
    return _finding(pages.select("path", F.explode(lacks).alias("k")), "L008", "warn", F.lit(None).cast("string"), F.concat("path", F.lit(" lacks "), "k"))


def wiki_sources(pages: DataFrame) -> DataFrame:
    """(path, session_id) of every source of every page."""
    return pages.select("path", F.explode(X.yaml_list(X.frontmatter(F.col("text")), "sources")).alias("session_id"))


def dead_sources(pages: DataFrame, sessions: DataFrame) -> DataFrame:
    dead = wiki_sources(pages).join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    return _finding(dead, "L009", "error", F.col("session_id"), F.col("path"))


def unreferenced(sessions: DataFrame, pages: DataFrame) -> DataFrame:
    free = sessions.join(wiki_sources(pages).select(F.col("session_id").alias("id")), "id", "left_anti")
    return _finding(free, "L010", "info", F.col("id"), F.lit("in no wiki page"))


def wiki_invocations(sessions: DataFrame, vault: str) -> DataFrame:
    own = sessions.where(F.col("agent").isin("codex", "claude-code") & (F.col("cwd") == vault))
    return _finding(own, "L011", "info", F.col("id"), F.col("cwd"))


def report(findings: list[DataFrame]) -> DataFrame:
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def severities(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warn", "info")])


def run_all(sessions: DataFrame, turns: DataFrame, docs: DataFrame, vectors: DataFrame, files: DataFrame, log: DataFrame, pages: DataFrame, vault: str) -> DataFrame:
    """The findings of every check, L001 to L011."""
    return report([
        vault_files(sessions, files), orphan_files(files, sessions), duplicates(log), missing_embeddings(turns, vectors), index_counts(turns, docs), orphan_vectors(vectors, sessions),
        wiki_frontmatter(pages), dead_sources(pages, sessions), unreferenced(sessions, pages), wiki_invocations(sessions, vault),
    ])


def summary(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: the number of sessions, of findings by severity, and sessions by agent."""
    agents = agent_counts(sessions).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("agent", "n")))).alias("agents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_sessions"))  # a row for each agent
    return severities(findings).crossJoin(F.broadcast(agents))  # one row each


def fix_stale(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """Sessions without those whose file is missing (not those that never had one)."""
    stale = findings.where("code = 'L001' and detail != 'no path'").select(F.col("session_id").alias("id"))
    return sessions.join(stale, "id", "left_anti")


def fix_invocations(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    own = findings.where("code = 'L011'").select(F.col("session_id").alias("id"), F.lit(True).alias("hit")).distinct()
    return sessions.join(own, "id", "left").withColumn("is_archived", F.coalesce("hit", F.lit(False)) | F.coalesce("is_archived", F.lit(False))).drop("hit")
