"""Sessions as markdown and back."""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import text as X

ZWSP = "​"
HEADER = r"^#{2,3} Turn (\d+)(?: — (User|Assistant|System))?(?: \((\d{2}:\d{2})\))?\s*$"


def vault_path(start: Column, agent: Column, project: Column, session_id: Column) -> Column:
    name = F.concat(agent, F.lit("_"), F.coalesce(X.sanitize_project(project), F.lit("unknown")), F.lit("_"), F.substring(session_id, 1, 8), F.lit(".md"))
    return F.concat(F.lit("raw/.sessions/"), F.date_format(start, "yyyy-MM-dd"), F.lit("/"), name)


def render(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, path, markdown): frontmatter and a heading for each turn; a turn of the same role as the
    one before has a lower heading without its role."""
    w = Window.partitionBy("session_id").orderBy("turn_index")
    same = F.coalesce(F.lag("role").over(w) == F.col("role"), F.lit(False))
    time = F.coalesce(F.concat(F.lit(" ("), F.date_format("ts", "HH:mm"), F.lit(")")), F.lit("")) if "ts" in turns.columns else F.lit("")
    n = (F.col("turn_index") + 1).cast("string")
    head = F.when(same, F.concat(F.lit("### Turn "), n, time)).otherwise(F.concat(F.lit("## Turn "), n, F.lit(" — "), F.initcap("role"), time))
    parts = [head, F.nullif(escape_fields(F.coalesce(F.col("content"), F.lit(""))), F.lit(""))]
    if "thinking" in turns.columns:
        parts.insert(1, F.when(F.col("thinking").isNotNull(), F.concat(F.lit("> [!thinking]- Thinking\n> "), F.replace(escape_fields(F.col("thinking")), F.lit("\n"), F.lit("\n> ")))))
    if "actions" in turns.columns:
        tool = lambda a: F.concat(F.lit("> [!tool]- "), a["name"], F.lit("\n> ```\n> "), F.replace(F.coalesce(a["input_summary"], F.lit("")), F.lit("\n"), F.lit("\n> ")), F.lit("\n> ```"))
        parts.append(F.nullif(F.array_join(F.transform(F.filter("actions", lambda a: a["kind"] == "tool_use"), tool), "\n\n"), F.lit("")))
    block = F.concat_ws("\n\n", *parts)
    body = turns.withColumn("block", block).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn_index", "block"))).alias("b"))
    body = body.select(F.col("session_id").alias("id"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("body"))
    quoted = lambda c: F.concat(F.lit('"'), X.yaml_escape(F.coalesce(c, F.lit(""))), F.lit('"'))
    head = F.concat(
        F.lit("---\nsession_id: "), "id", F.lit("\nagent: "), "agent", F.coalesce(F.concat(F.lit("\nproject: "), "project"), F.lit("")),
        F.lit("\ndate: "), F.date_format("start_time", "yyyy-MM-dd"), F.lit("\nstart_time: "), F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\nturns: "), F.col("turn_count").cast("string"), F.lit("\nsummary: "), quoted(F.col("summary")), F.lit("\n---\n\n"),
    )
    joined = sessions.join(body, "id")
    return joined.select("id", vault_path(F.col("start_time"), F.col("agent"), F.col("project"), F.col("id")).alias("path"), X.collapse_blank_lines(F.concat(head, "body", F.lit("\n"))).alias("markdown"))


def parse_turns(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """(id, turn_index, role, content): the inverse of render(). Lines are numbered by headings seen
    so far; a heading without role takes the last one's."""
    lines = docs.select("id", F.posexplode(F.split(X.body(F.col(text)), "\n")).alias("no", "line"))
    at = F.regexp_extract("line", HEADER, 1)
    w = Window.partitionBy("id").orderBy("no")
    marked = lines.withColumn("head", at != "").withColumn("group", F.sum((at != "").cast("int")).over(w))
    marked = marked.withColumn("turn_index", F.when(F.col("head"), at.cast("int") - 1)).withColumn("own", F.when(F.col("head"), F.lower(F.nullif(F.regexp_extract("line", HEADER, 2), F.lit("")))))
    marked = marked.withColumn("role", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("group") > 0)
    content = F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("no", "line"))))
    done = marked.groupBy("id", "group").agg(F.max("turn_index").alias("turn_index"), F.first("role", ignorenulls=True).alias("role"), F.array_join(F.transform(content, lambda x: x["line"]), "\n").alias("raw"))
    return done.select("id", "turn_index", "role", unescape_fields(F.regexp_replace("raw", r"^\n+|\n+$", "")).alias("content"))


def summary_of_body(text: Column) -> Column:
    """The first line of the first user turn in markdown."""
    section = F.regexp_extract(text, r"(?ms)^## Turn \d+ — User[^\n]*\n(.*?)(?=^## |\z)", 1)
    return X.first_line(section)


def session_fields(text: Column) -> dict[str, Column]:
    """The fields of a session's frontmatter; all may be null."""
    h = X.frontmatter(text)
    names = ("session_id", "agent", "model", "project", "cwd", "date", "start_time", "end_time", "host", "status", "session_type", "archived_at")
    whole = {n: X.yaml_field(h, n).try_cast("bigint") for n in ("tokens_in", "tokens_out")}
    lists = {n: X.yaml_list(h, n) for n in ("tools_used", "tags")}
    archived = F.lower(X.yaml_field(h, "archived")) == "true"
    return {n: X.yaml_field(h, n) for n in names} | {"summary": X.yaml_unescape(X.yaml_field(h, "summary")), "turns": X.yaml_field(h, "turns").try_cast("int"), "archived": archived} | whole | lists


#: Fenced blocks, to the end of the text where they aren't closed, and code in a line.
CODE = r"(?s)```.*?(?:```|\z)|`[^`\n]*`"


def escape_fields(text: Column) -> Column:
    """`::` outside of code is broken by a zero-width space."""
    between, code = F.split(text, CODE, -1), F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    shown = F.zip_with(between, code, lambda a, c: F.concat(F.replace(a, F.lit("::"), F.lit(f":{ZWSP}:")), F.coalesce(c, F.lit(""))))
    return F.when(F.contains(text, F.lit("::")), F.array_join(shown, "")).otherwise(text)


def unescape_fields(text: Column) -> Column:
    """The inverse of escape_fields(): `::` as it was."""
    return F.replace(text, F.lit(f":{ZWSP}:"), F.lit("::"))


def insert_links(text: str, names: dict[str, str]) -> str:
    """Names of at least 3 bytes become links to their pages, unless they are in a link already."""
    usable = sorted((n for n in names if len(n.encode()) >= 3), key=lambda n: (-len(n), n))
    if not usable:
        return text
    pattern = re.compile("|".join(map(re.escape, usable)))
    put = lambda m: f"[[{names[m[0]]}|{m[0]}]]" if names[m[0]] != m[0] else f"[[{m[0]}]]"
    return "".join(p if i % 2 else pattern.sub(put, p) for i, p in enumerate(re.split(r"(\[\[.*?\]\])", text)))


def linked(pages: DataFrame, names: dict[str, str]) -> DataFrame:
    """`pages` (text) with names linked as insert_links() does, a batch of pages at a time."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else insert_links(t, names))

    return pages.withColumn("text", F.pandas_udf(run, "string")("text"))


def merge_conflict(ours: Column, theirs: Column) -> Column:
    """The text of a page of which two versions exist: theirs, with the sources of both as a block list."""
    sources = F.array_distinct(F.concat(X.yaml_list(X.frontmatter(ours), "sources"), X.yaml_list(X.frontmatter(theirs), "sources")))
    block = F.concat(F.lit("sources:\n"), F.array_join(F.transform(sources, lambda x: F.concat(F.lit("  - "), x)), "\n"))
    head = F.regexp_replace(X.frontmatter(theirs), r"(?m)^sources:.*(?:\n[ \t]+-.*)*\n?", "")
    head = F.regexp_replace(head, r"\n+$", "")
    return F.concat(F.lit("---\n"), F.when(head != "", F.concat(head, F.lit("\n"))).otherwise(""), F.when(F.size(sources) > 0, F.concat(block, F.lit("\n"))).otherwise(""), F.lit("---\n"), X.body(theirs))


def merge_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(path, sources, body): a page that has all the new sources stays; else sources are joined and
    the body is new. Pages on one side only stay as they are."""
    o, n = existing.alias("o"), new.alias("n")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("o.sources", none), F.coalesce("n.sources", none)
    has_all = F.col("o.path").isNotNull() & (F.size(F.array_except(b, a)) == 0)
    return o.join(n, F.col("o.path") == F.col("n.path"), "full").select(
        F.coalesce("o.path", "n.path").alias("path"), F.array_sort(F.array_union(a, b)).alias("sources"), F.when(has_all, F.col("o.body")).otherwise(F.coalesce("n.body", "o.body")).alias("body")
    )


def page_defaults(pages: DataFrame, today: str) -> DataFrame:
    return pages.withColumn("type", F.coalesce("type", F.lit("project"))).withColumn("status", F.coalesce("status", F.lit("draft"))).withColumn("updated_at", F.coalesce("updated_at", F.lit(today)))


def parse_frontmatter(text: str) -> dict[str, Any]:
    """Frontmatter of any YAML, for one file at a time; empty where there is none or it is broken."""
    import yaml

    m = re.match(r"---\r?\n(.*?)\r?\n---", text, re.S)
    try:
        found = yaml.safe_load(m[1]) if m else None
    except yaml.YAMLError:
        found = None
    return found if isinstance(found, dict) else {}
