"""Text functions as Column expressions; no Python runs for each row."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: White space as Unicode has it; the \s of Java's and of Python's expressions are others.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"[{WHITE}!-/:-@\[-`{{-~]+"
JAVA_SPLIT = r"[\p{IsWhite_Space}!-/:-@\[-`{-~]+"  # the same class, which Java tests faster by its name
ISSUE = r"(?i)(?:fixes|closes|resolves|close|fix|resolve)\s+#(\d+)"
EDIT_INLINE = r">\s*\[!tool\]-\s*Edit\s+`([^`]+)`"
EDIT_BLOCK = r">\s*\[!tool\]-\s*(?:Edit|Write)\s*\n>\s*```\n>\s*([^\n`]+)\n>\s*```"


def tokens(text: Column) -> Column:
    """Lower-case words of more than one character, split at Unicode white space and ASCII punctuation."""
    return F.filter(F.split(F.lower(text), JAVA_SPLIT), lambda x: F.length(x) > 1)


def query_tokens(text: str) -> list[str]:
    """tokens() for a query that the caller holds."""
    return [t for t in re.split(SPLIT, text.lower()) if len(t) > 1]


def query_terms(spark: SparkSession, text: str) -> list[str]:
    """tokens() of a query, by Spark itself: also where its version of Unicode isn't Python's."""
    return spark.sql("select 1").select(tokens(F.lit(text))).first()[0]


def fts_text(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def index_text(content: Column, actions: Column) -> Column:
    """What is indexed of a turn: its content and a line for each tool use."""
    tools = F.transform(F.filter(actions, lambda a: a["kind"] == "tool_use"), lambda a: F.concat(F.lit("[Tool: "), a["name"], F.lit("] "), F.coalesce(a["input_summary"], F.lit(""))))
    parts = F.concat(F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(content)), F.coalesce(tools, F.array().cast("array<string>")))
    return F.array_join(parts, "\n\n")


def turn_text(columns: list[str]) -> Column:
    """What is indexed of a table of turns: with tool calls where it has `actions`, else the content."""
    return index_text(F.col("content"), F.col("actions")) if "actions" in columns else F.col("content")


def snippet(content: Column, query: Column, size: int = 200) -> Column:
    """All of a short text; else a window that starts 30 characters before the first hit, or at 0."""
    at = F.position(F.lower(query), F.lower(content))
    start = F.when(at > 0, F.greatest(at - 31, F.lit(0))).otherwise(0)
    return F.when(F.length(content) <= size, content).otherwise(F.substring(content, start + 1, F.lit(size)))


def char_chunks(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """An array of windows of `size` characters, each starting `size - overlap` after the last; the
    last one reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), lambda i: F.substring(text, i * step + 1, F.lit(size))))


def token_windows(words: Column, size: int = 500, overlap: int = 75) -> Column:
    """The same over an array of tokens; the step is 1 at least."""
    step = max(1, size - min(overlap, size - 1))
    last = F.greatest(F.ceil((F.size(words) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, F.lit(size)))


def chunk_budget(model_max: int, override: int | None = None, overlap: int = 75) -> tuple[int, int]:
    """Tokens and overlap of a chunk: 12 are left for the prefix, an override can only lower it."""
    top = max(1, model_max - 12)
    size = min(top, max(1, override)) if override is not None else top
    return size, min(overlap, size - 1)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def truncate_bytes(text: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that ends between characters."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    k = F.length(F.regexp_replace(head, "\ufffd+$", ""))  # what is cut off may be a character of the text's own
    k = F.when(F.octet_length(F.substring(text, F.lit(1), k + 1)) <= n, k + 1).otherwise(k)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(text, F.lit(1), k))


def sanitize_project(name: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_ -]", "_")), 1, 50)


def wiki_safe(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")


def normalize_tag(tag: Column) -> Column:
    lower = F.regexp_replace(F.lower(F.trim(tag)), r"\s", "-")
    return F.substring(F.regexp_replace(lower, r"[^\p{L}\p{N}_-]", ""), 1, 32)


def normalize_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, normalize_tag), lambda t: t != "")))


def first_line(text: Column, n: int = 80) -> Column:
    """The first line that isn't blank, trimmed and cut; null where there is none."""
    line = F.regexp_extract(text, r"^\s*([^\r\n]*)", 1)
    return truncate(F.nullif(F.trim(F.rtrim(line)), F.lit("")), n)


def issue_refs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ISSUE), F.lit(1)))


def relative_path(path: Column, cwd: Column) -> Column:
    prefix = F.when(F.endswith(cwd, F.lit("/")), cwd).otherwise(F.concat(cwd, F.lit("/")))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def edited_files(body: Column, cwd: Column) -> Column:
    """Paths of edited files, relative to cwd; those of the block form must not have spaces."""
    rel = lambda p: relative_path(F.trim(p), cwd)
    inline = F.transform(F.regexp_extract_all(body, F.lit(EDIT_INLINE), F.lit(1)), rel)
    block = F.filter(F.transform(F.regexp_extract_all(body, F.lit(EDIT_BLOCK), F.lit(1)), rel), lambda p: ~F.contains(p, F.lit(" ")))
    return F.array_distinct(F.filter(F.concat(inline, block), lambda p: p != ""))


def humanize(n: Column) -> Column:
    """From 1000 on in thousands with one decimal. What lies halfway between two decimals goes where the
    64-bit float next to it lies, as printf has it: its 53 bits times 1000 are compared with n."""
    n = n.cast("bigint")
    x = n / 1000
    scale = F.pow(F.lit(2.0), 52 - F.floor(F.log2(x)))
    bits, exact = (x * scale).cast("bigint") * 1000, n * scale.cast("bigint")
    tenths = F.floor(n / 100)
    over = (bits > exact) | ((bits == exact) & (tenths % 2 == 1))
    tenths = tenths + F.when((n % 100 > 50) | ((n % 100 == 50) & over), 1).otherwise(0)
    return F.when(n >= 1000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def json_block(text: Column) -> Column:
    """The JSON inside a fenced block, or from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(F.trim(fenced), F.lit("")), F.nullif(bare, F.lit("")), F.trim(text))


def split_id(key: Column) -> tuple[Column, Column]:
    """`id:turn` split at the last colon where a number follows; else the whole and null."""
    turn = F.regexp_extract(key, r"^.*:(\d{1,9})$", 1)
    return F.when(turn != "", F.regexp_extract(key, r"^(.*):\d{1,9}$", 1)).otherwise(key), F.nullif(turn, F.lit("")).cast("int")


def highlight(text: Column, query: str, left: str = "<mark>", right: str = "</mark>") -> Column:
    """Every query term of more than one character marked, longer terms first, case ignored."""
    terms = sorted(set(query_tokens(query)), key=lambda t: (-len(t), t))
    if not terms:
        return text
    quoted = "|".join(re.sub(r"([^\w])", r"\\\1", t) for t in terms)
    return F.regexp_replace(text, f"(?i)({quoted})", f"{left}$1{right}")


def tool_summary(name: Column, args: Column) -> Column:
    """What a tool was asked, from its JSON arguments."""
    get = lambda k: F.coalesce(F.get_json_object(args, f"$.{k}"), F.lit(""))
    low = F.lower(name)
    return (
        F.when(low == "bash", get("command"))
        .when(low.isin("read", "edit", "write", "multiedit"), get("file_path"))
        .when(low == "grep", F.concat(get("pattern"), F.lit(" in "), get("path")))
        .when(low == "glob", get("pattern"))
        .otherwise(truncate(args, 200))
    )


def epoch_to_timestamp(seconds: Column) -> Column:
    """Null for values that aren't finite."""
    ok = ~F.isnan(seconds) & (F.abs(seconds) < 2.0**53)
    return F.when(ok, F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")))


def collapse_blank_lines(text: Column) -> Column:
    """Runs of blank lines become one."""
    return F.regexp_replace(text, r"\n([ \t]*\n){2,}", "\n\n")


def yaml_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def yaml_unescape(text: Column) -> Column:
    return F.regexp_replace(text, r'\\(["\\])', "$1")


def yaml_field(head: Column, key: str) -> Column:
    """A scalar of simple frontmatter, without quotes; null if it isn't there."""
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*\r?$", 1)), r"""^["']|["']$""", ""), F.lit(""))


def yaml_list(head: Column, key: str) -> Column:
    """The items of `key: [a, b]`, or of a block list under `key:`."""
    inner = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*?)\]", 1)
    block = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\n|$))*)", 1)
    clean = lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")
    one = F.transform(F.split(inner, ","), clean)
    many = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t]*\r?$"), F.lit(1)), clean)
    return F.filter(F.concat(one, many), lambda x: x != "")


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n|$)", 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---(?:\r?\n|$)", "")


def wiki_title(text: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^# (.*)$", 1), F.lit("")), stem)


def encode_cwd(cwd: Column) -> Column:
    return F.translate(cwd, "/\\", "--")


def valid_embedding(e: Column) -> Column:
    return ~F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
