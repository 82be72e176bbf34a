"""Predicates of searches and listings, as Columns that reach the scan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions import text as X
from threadmill.model import ListFilter, SearchFilters


def search_predicate(sessions: DataFrame, f: SearchFilters) -> DataFrame:
    """Sessions that a search may return. A null type isn't excluded; an empty allowlist allows none."""
    if not f.include_archived:
        sessions = sessions.where(~F.coalesce(F.col("is_archived"), F.lit(False)))
    for name in ("project", "agent"):
        if getattr(f, name) is not None:
            sessions = sessions.where(F.col(name) == getattr(f, name))
    if f.since is not None:
        sessions = sessions.where(F.col("start_time") >= F.lit(f.since))
    if f.until is not None:
        sessions = sessions.where(F.col("start_time") < F.lit(f.until))
    if f.exclude_session_types:
        sessions = sessions.where(F.col("session_type").isNull() | ~F.col("session_type").isin(*f.exclude_session_types))
    if isinstance(f.allowlist, DataFrame):
        sessions = sessions.join(f.allowlist.select(F.col("session_id").alias("id")), "id", "left_semi")
    return sessions


def list_predicate(f: ListFilter) -> Column:
    """Sessions that a listing shows; a null type is excluded. `q` is literal text, case ignored."""
    p = F.col("session_type") != "automated"
    if not f.include_archived:
        p &= ~F.coalesce(F.col("is_archived"), F.lit(False))
    for name in ("project", "agent"):
        if getattr(f, name) is not None:
            p &= F.col(name) == getattr(f, name)
    if f.date_from is not None:
        p &= F.col("start_time") >= F.lit(f.date_from)
    if f.date_to is not None:
        p &= F.col("start_time") <= F.lit(f.date_to)
    for t in f.tags:
        p &= F.array_contains("tags", t)
    if f.favorite is not None:
        p &= F.col("is_favorite") == f.favorite
    if f.q:
        has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(f.q.lower()))
        p &= has("summary") | has("project")
    return p


def page(sessions: DataFrame, f: ListFilter) -> tuple[DataFrame, DataFrame]:
    """One page, newest first, and the one-row total."""
    found = sessions.where(list_predicate(f))
    number, size = max(1, f.page), min(100, max(1, f.page_size))
    return found.orderBy(F.desc("start_time"), "id").offset((number - 1) * size).limit(size), found.agg(F.count("*").alias("total"))


def temporal(text: str, now: datetime) -> SearchFilters | None:
    """today, yesterday, last week, this week, `since YYYY-MM-DD` or a bare date; else None."""
    t, midnight = text.strip().lower(), now.replace(hour=0, minute=0, second=0, microsecond=0)
    if t == "today":
        return SearchFilters(since=midnight)
    if t == "yesterday":
        return SearchFilters(since=midnight - timedelta(days=1), until=midnight)
    if t in ("last week", "this week"):
        return SearchFilters(since=now - timedelta(days=7))
    try:
        return SearchFilters(since=datetime.strptime(t.removeprefix("since "), "%Y-%m-%d").replace(tzinfo=now.tzinfo))
    except ValueError:
        return None


def date_range(name: str, today: datetime) -> tuple[datetime | None, datetime | None]:
    """today, week (from Monday), month, all."""
    day = today.replace(hour=0, minute=0, second=0, microsecond=0)
    start = {"today": day, "week": day - timedelta(days=day.weekday()), "month": day.replace(day=1)}.get(name)
    return (start, day) if start is not None else (None, None)


def split_tags(values: list[str]) -> list[str]:
    """Repeated or comma-separated tags as one list."""
    return [t.strip() for v in values for t in v.split(",") if t.strip()]


def on_day(day: str) -> Column:
    return F.to_date("start_time") == F.lit(day).cast("date")


def by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """(status, id) of an id prefix: found, ambiguous or missing."""
    own = sessions.where(F.startswith("id", F.lit(prefix))).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return own.select(F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"), "n")


def exists(sessions: DataFrame, session_id: str) -> bool:
    return sessions.where(F.col("id") == session_id).limit(1).count() > 0


def exists_by_prefix(sessions: DataFrame, prefix: str) -> bool:
    return sessions.where(F.startswith("id", F.lit(prefix))).limit(1).count() > 0


def is_open(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("end_time").isNull())


def rebuild_selection(sessions: DataFrame, session: str | None = None, everything: bool = False, retry_failed: bool = False, since: datetime | None = None) -> DataFrame:
    """Sessions of which to build the graph again, newest first; the first choice that is set counts."""
    if session is not None:
        chosen = F.col("id") == session
    elif everything:
        chosen = F.lit(True)
    elif retry_failed:
        chosen = F.col("semantic_extracted_at").isNull()
    elif since is not None:
        chosen = F.col("start_time") >= F.lit(since)
    else:
        chosen = F.lit(False)
    return sessions.where(chosen).orderBy(F.desc("start_time"), "id")


NOISE_PREFIXES = ("Summarize this", "Write a wiki", "You are a")


def daily_noise(min_turns: int = 2, prefixes: tuple[str, ...] = NOISE_PREFIXES) -> Column:
    """Sessions worth a daily report."""
    line = F.coalesce(X.first_line(F.col("summary"), 200), F.lit(""))
    quiet = F.lit(True)
    for p in prefixes:
        quiet &= ~F.startswith(line, F.lit(p))
    return (F.col("turn_count") >= min_turns) & (F.coalesce(F.col("session_type"), F.lit("")) != "automated") & quiet


def embeddable() -> Column:
    return (F.coalesce(F.col("content"), F.lit("")) != "") | (F.size(F.coalesce(F.col("actions"), F.array())) > 0)


def skip_reason(cwd: Column, first_user: Column, n_turns: Column, all_sidechain: Column, prompt: str, marker: str) -> Column:
    """Why a parsed session isn't a conversation of its own; null where it is."""
    tmp = F.startswith(cwd, F.lit("/private/var/folders/")) | F.startswith(cwd, F.lit("/var/folders/")) | F.startswith(cwd, F.lit("/tmp/"))
    return (
        F.when(n_turns == 0, "no turns")
        .when(all_sidechain, "sidechain")
        .when(tmp, "temporary folder")
        .when(F.startswith(F.ltrim(first_user), F.lit(prompt)), "summary prompt")
        .when(F.contains(first_user, F.lit(marker)), "wiki invocation")
    )


def list_clamp(value: int | None, default: int, low: int, high: int) -> int:
    return min(high, max(low, default if value is None else value))
