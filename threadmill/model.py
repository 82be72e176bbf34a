"""The session model: schemas and query parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import types as T

AGENTS = ("claude-code", "claude-ai", "chatgpt", "codex", "gemini-cli", "gemini-web", "opencode")
ROLES = ("user", "assistant", "system")

ACTION = T.StructType([
    T.StructField(n, t)
    for n, t in (("kind", T.StringType()), ("name", T.StringType()), ("input_summary", T.StringType()), ("output_summary", T.StringType()), ("tool_use_id", T.StringType()), ("path", T.StringType()), ("cmd", T.StringType()), ("exit_code", T.IntegerType()))
])
TOKENS = T.StructType([T.StructField("input", T.LongType()), T.StructField("output", T.LongType()), T.StructField("cached", T.LongType())])
TURN = T.StructType([
    T.StructField("turn_index", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("content", T.StringType()),
    T.StructField("actions", T.ArrayType(ACTION)), T.StructField("thinking", T.StringType()), T.StructField("tokens", TOKENS), T.StructField("is_sidechain", T.BooleanType()),
])
PARSED_SESSION = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("id", T.StringType()), T.StructField("agent", T.StringType()), T.StructField("model", T.StringType()), T.StructField("project", T.StringType()),
    T.StructField("cwd", T.StringType()), T.StructField("git_branch", T.StringType()), T.StructField("title", T.StringType()), T.StructField("start_time", T.TimestampType()), T.StructField("end_time", T.TimestampType()),
    T.StructField("turns", T.ArrayType(TURN)), T.StructField("error", T.StringType()),
])
SESSION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("agent", T.StringType()), T.StructField("model", T.StringType()), T.StructField("project", T.StringType()), T.StructField("cwd", T.StringType()),
    T.StructField("start_time", T.TimestampType()), T.StructField("end_time", T.TimestampType()), T.StructField("turn_count", T.LongType()), T.StructField("tokens_in", T.LongType()), T.StructField("tokens_out", T.LongType()),
    T.StructField("tools_used", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("vault_path", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("session_type", T.StringType()), T.StructField("is_favorite", T.BooleanType()), T.StructField("notes", T.StringType()), T.StructField("semantic_extracted_at", T.TimestampType()),
    T.StructField("is_archived", T.BooleanType()), T.StructField("archived_at", T.TimestampType()), T.StructField("source_size", T.LongType()), T.StructField("source_mtime", T.TimestampType()),
])
EDGE = "source string, target string, relation string, confidence string, weight double"
NODE = "id string, type string, label string, meta string"


@dataclass
class SearchFilters:
    """What a search may return. `allowlist` is a DataFrame with a session_id column, or None for all."""

    project: str | None = None
    agent: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    max_per_session: int = 2
    exclude_session_types: tuple[str, ...] = ()
    include_archived: bool = False
    allowlist: object | None = None


@dataclass
class ListFilter:
    project: str | None = None
    agent: str | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    tags: tuple[str, ...] = ()
    favorite: bool | None = None
    q: str | None = None
    include_archived: bool = False
    page: int = 1
    page_size: int = 20


@dataclass
class QueryItem:
    """One item of a multi-query recall: kind is hybrid, keyword, semantic or temporal."""

    kind: str
    text: str = ""
    vector: list[float] | None = field(default=None)
