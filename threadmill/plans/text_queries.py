"""Queries of the text functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import text as X
from threadmill.plans.tables import table, turns

C = F.col
WHITE_SQL = r"\t-\r\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}"
WORDS_SQL = rf"list_filter(regexp_split_to_array(lower({{0}}), '[{WHITE_SQL}[:punct:]]+'), lambda x: length(x) > 1)"


def f01_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.explode(X.tokens(C("text"))).alias("term"))
    return d.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


#: White space of every kind between words of a text, one after another.
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def f01_unicode(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of texts whose spaces are of every kind that Unicode has: which one follows from the word's
    place in the text."""
    some = F.split("text", " ")
    spaced = F.array_join(F.transform(some, lambda w, i: F.concat(w, F.substring(F.lit(SPACES), (i % len(SPACES) + 1).cast("int"), F.lit(1)))), "")
    d = table(spark, sf, "documents").select("doc_id", F.explode(X.tokens(spaced)).alias("term"))
    return d.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def f05_fts_text(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("session_id", "turn_index", X.fts_text(C("content")).alias("fts"))


def f06_index_text(spark: SparkSession, sf: str) -> DataFrame:
    action = F.struct(F.lit("tool_use").alias("kind"), C("role").alias("name"), C("content").alias("input_summary"))
    none = F.array().cast("array<struct<kind:string,name:string,input_summary:string>>")
    actions = F.when(C("turn_index") % 2 == 0, F.array(action)).otherwise(none)
    return turns(spark, sf).select("session_id", "turn_index", X.index_text(C("content"), actions).alias("shown"))


def f07_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.snippet(C("text"), F.lit("THE "), 200).alias("snippet"))


def f08_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.char_chunks(C("text"))).alias("seq", "chunk"))


def f09_token_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split(C("text"), " ")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.token_windows(w)).alias("seq", "w")).select("doc_id", "seq", F.size("w").alias("n"), F.element_at("w", 1).alias("first_word"), F.element_at("w", -1).alias("last_word"))


def f11_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.truncate(C("text"), 80).alias("short"))


def f12_truncate_bytes(spark: SparkSession, sf: str) -> DataFrame:
    cut = X.truncate_bytes(C("text"), 101)
    return table(spark, sf, "documents").select("doc_id", cut.alias("cut"), F.octet_length(cut).alias("n_bytes"))


def f13_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.sanitize_project(C("text")).alias("name"))


def f14_wiki_safe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.wiki_safe(C("text")).alias("name"))


def f15_tag_norm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normalize_tag(C("text")).alias("tag"))


def f16_tag_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.normalize_tags(F.split("text", " ")), ",").alias("tags"))


def f17_summary(spark: SparkSession, sf: str) -> DataFrame:
    u = F.when(C("role") == "user", C("turn_index"))
    return turns(spark, sf).groupBy("session_id").agg(F.min_by("content", u).alias("c")).select("session_id", X.first_line(C("c")).alias("summary"))


def f23_blank_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.collapse_blank_lines(F.replace("text", F.lit("."), F.lit(".\n\n\n"))), 256).alias("sha"))


def f25_vault_path(spark: SparkSession, sf: str) -> DataFrame:
    from threadmill.functions.markdown import vault_path
    from threadmill.plans.tables import sessions

    return sessions(spark, sf).select("id", vault_path(C("start_time"), C("agent"), C("project"), C("id")).alias("path"))


def f26_yaml_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(X.yaml_escape(C("html")), 256).alias("sha"))


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with issue references put in: 'the' becomes one, so that a document has many."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("Fixes #"), C("doc_id") % 17, F.lit(" and closes  #"), C("doc_id") % 5, F.lit(". Task #5 "), C("text")).alias("text"))


def f27_issue_refs(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", F.explode(X.issue_refs(C("text"))).alias("issue"))


def f28_edited_files(spark: SparkSession, sf: str) -> DataFrame:
    b = F.concat(F.lit("> [!tool]- Edit `/w/p/src/"), C("doc_id") % 9, F.lit(".rs`\n> [!tool]- Write\n> ```\n> /w/p/doc/"), C("doc_id") % 4, F.lit(".md\n> ```\n"), "text")
    return table(spark, sf, "documents").select("doc_id", F.explode(X.edited_files(b, F.lit("/w/p"))).alias("file"))


def f29_relpath(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.relative_path(C("url"), F.when(C("page_id") % 2 == 0, "http://ththre.example.com").otherwise("https://blog.tionsh.example.net/")).alias("rel"))


def f33_wiki_title(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(C("doc_id") % 3 == 0, F.concat(F.lit("# Page "), C("doc_id"), F.lit("\n"), "text")).otherwise(C("text"))
    return table(spark, sf, "documents").select("doc_id", X.wiki_title(text, F.concat(F.lit("stem-"), "doc_id")).alias("title"), F.substring(text, 1, 500).alias("preview"))


def f34_humanize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.humanize(C("n_chars")).alias("shown"))


def f36_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.lit('---\ntitle: "T'), "doc_id", F.lit('"\nsources: [s'), C("doc_id") % 7, F.lit(', "s'), C("doc_id") % 3, F.lit('"]\n---\n'), "text")
    h = X.frontmatter(head)
    return table(spark, sf, "documents").select("doc_id", X.yaml_field(h, "title").alias("title"), F.array_join(X.yaml_list(h, "sources"), ",").alias("sources"), F.length(X.body(head)).alias("n"))


def f38_json_block(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, sf, "events").select("event_id", X.json_block(t).alias("block"))


def f39_sha(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


def f40_idsplit(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(C("turn_index") % 2 == 0, F.concat(F.lit("a:"), "session_id", F.lit(":"), "turn_index")).otherwise(F.concat(F.lit("x:"), "role"))
    sid, turn = X.split_id(key)
    return turns(spark, sf).select("session_id", "turn_index", sid.alias("sid"), turn.alias("turn"))


def f42_highlight(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("session_id", "turn_index", X.highlight(C("content"), "the, and of-the").alias("marked"))


def s05_encode_cwd(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.encode_cwd(C("url")).alias("folder"))


def s08_tool_summary(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("Bash", "Read", "Grep", "Glob", "Other"))), (C("event_id") % 5 + 1).cast("int"))
    args = F.concat(F.lit('{"command":"run '), "event_id", F.lit('","file_path":"/f/'), "user_id", F.lit('","pattern":"p'), C("user_id") % 10, F.lit('","path":"/r"}'))
    return table(spark, sf, "events").select("event_id", X.tool_summary(name, args).alias("summary"))


def s15_epoch(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(C("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.lit(1.7e9) + C("event_id") + 0.25)
    return table(spark, sf, "events").select("event_id", X.epoch_to_timestamp(x).alias("ts"))


def _both(f, sql: str | None):  # noqa: ANN001, ANN202
    return f.__name__, (f, sql)


WORD = r"\p{L}\p{N}"
TAGS = r"left(regexp_replace(regexp_replace(lower(trim({0})), '\s', '-', 'g'), '[^\p{{L}}\p{{N}}_-]', '', 'g'), 32)"
QUERIES = dict([
    _both(f01_tokens, "select doc_id, term, count(*) as tf from (select doc_id, unnest(" + WORDS_SQL.format("text") + ") as term from documents) group by all"),
    _both(f01_unicode, "with s as (select doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: w || (" + "[" + ", ".join(f"chr({ord(c)})" for c in SPACES) + "])[(i - 1) % " + str(len(SPACES)) + " + 1]), '') as text from documents) select doc_id, term, count(*) as tf from (select doc_id, unnest(" + WORDS_SQL.format("text") + ") as term from s) group by all"),
    _both(f05_fts_text, "select cast(conv_id as varchar) as session_id, turn::int as turn_index, array_to_string(" + WORDS_SQL.format("text") + ", ' ') as fts from conversations"),
    _both(f06_index_text, "select cast(conv_id as varchar) as session_id, turn::int as turn_index, concat_ws(chr(10) || chr(10), nullif(text, ''), case when turn % 2 = 0 then '[Tool: ' || role || '] ' || text end) as shown from conversations"),
    _both(f07_snippet, "select doc_id, case when length(text) <= 200 then text else substr(text, (case when position('the ' in lower(text)) > 0 then greatest(position('the ' in lower(text)) - 31, 0) else 0 end + 1)::int, 200) end as snippet from documents"),
    _both(f08_chunks, "select doc_id, i::int as seq, substr(text, (i * 850 + 1)::int, 1000) as chunk from (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 1000) / 850.0), 0)::bigint + 1)) as i from documents)"),
    _both(f09_token_windows, "with w as (select doc_id, string_split(text, ' ') as w from documents), x as (select doc_id, w, unnest(range(0, greatest(ceil((len(w) - 500) / 425.0), 0)::bigint + 1)) as i from w) select doc_id, i::int as seq, len(w[i * 425 + 1:i * 425 + 500])::int as n, w[i * 425 + 1] as first_word, w[least(i * 425 + 500, len(w))] as last_word from x"),
    _both(f11_truncate, "select doc_id, case when length(text) > 80 then left(text, 80) || '...' else text end as short from documents"),
    _both(f12_truncate_bytes, "with c as (select doc_id, text, list_max(list_filter(range(0, least(length(text), 101) + 1), lambda i: strlen(left(text, i)) <= 101)) as k from documents) select doc_id, left(text, k) as cut, strlen(left(text, k))::int as n_bytes from c"),
    _both(f13_sanitize, rf"select doc_id, left(trim(regexp_replace(text, '[^{WORD}_ -]', '_', 'g')), 50) as name from documents"),
    _both(f14_wiki_safe, rf"select doc_id, regexp_replace(regexp_replace(text, '[^{WORD}]', '-', 'g'), '^-+|-+$', '', 'g') as name from documents"),
    _both(f15_tag_norm, "select doc_id, " + TAGS.format("text") + " as tag from documents"),
    _both(f16_tag_list, "select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda t: " + TAGS.format("t") + "), lambda t: t != ''))), ',') as tags from documents"),
    _both(f17_summary, r"with t as (select conv_id, trim(regexp_extract(arg_min(text, turn) filter (role = 'user'), '^\s*([^\r\n]*)', 1)) as line from conversations group by conv_id) select cast(conv_id as varchar) as session_id, nullif(case when length(line) > 80 then left(line, 80) || '...' else line end, '') as summary from t"),
    _both(f23_blank_lines, r"select doc_id, sha256(regexp_replace(replace(text, '.', '.' || chr(10) || chr(10) || chr(10)), '\n([ \t]*\n){2,}', chr(10) || chr(10), 'g')) as sha from documents"),
    _both(f25_vault_path, "select cast(conv_id as varchar) as id, 'raw/.sessions/' || strftime(make_timestamp((1704067200 + conv_id * 3600) * 1000000), '%Y-%m-%d') || '/' || (['claude-code', 'codex', 'gemini-cli', 'chatgpt'])[(conv_id % 4 + 1)::int] || '_' || case when conv_id % 13 != 0 then 'proj' || (conv_id % 7) else 'unknown' end || '_' || left(cast(conv_id as varchar), 8) || '.md' as path from (select distinct conv_id from conversations)"),
    _both(f26_yaml_escape, r"""select page_id, sha256(replace(replace(html, '\', '\\'), '"', '\"')) as sha from pages"""),
    _both(f27_issue_refs, r"select distinct doc_id, unnest(regexp_extract_all('Fixes #' || (doc_id % 17) || ' and closes  #' || (doc_id % 5) || '. Task #5 ' || text, '(?i)(?:fixes|closes|resolves|close|fix|resolve)\s+#(\d+)', 1)) as issue from documents"),
    _both(f28_edited_files, "select doc_id, 'src/' || (doc_id % 9) || '.rs' as file from documents union all select doc_id, 'doc/' || (doc_id % 4) || '.md' from documents"),
    _both(f29_relpath, "select page_id, case when page_id % 2 = 0 and starts_with(url, 'http://ththre.example.com/') then substr(url, 27) when page_id % 2 = 1 and starts_with(url, 'https://blog.tionsh.example.net/') then substr(url, 33) else url end as rel from pages"),
    _both(f33_wiki_title, r"with t as (select doc_id, case when doc_id % 3 = 0 then '# Page ' || doc_id || chr(10) || text else text end as t from documents) select doc_id, coalesce(nullif(regexp_extract(t, '(?m)^# (.*)$', 1), ''), 'stem-' || doc_id) as title, left(t, 500) as preview from t"),
    _both(f34_humanize, "select doc_id, case when n_chars >= 1000 then printf('%.1fk', n_chars / 1000.0) else n_chars::varchar end as shown from documents"),
    _both(f36_frontmatter, "select doc_id, 'T' || doc_id as title, 's' || (doc_id % 7) || ',s' || (doc_id % 3) as sources, length(text)::int as n from documents"),
    _both(f38_json_block, "select event_id, props as block from events"),
    _both(f39_sha, "select doc_id, sha256(text) as sha from documents"),
    _both(f40_idsplit, "select cast(conv_id as varchar) as session_id, turn::int as turn_index, case when turn % 2 = 0 then 'a:' || conv_id else 'x:' || role end as sid, case when turn % 2 = 0 then turn::int end as turn from conversations"),
    _both(f42_highlight, r"select cast(conv_id as varchar) as session_id, turn::int as turn_index, regexp_replace(text, '(and|the|of)', '<mark>\1</mark>', 'gi') as marked from conversations"),
    _both(s05_encode_cwd, r"select page_id, translate(url, '/\', '--') as folder from pages"),
    _both(s08_tool_summary, """select event_id, case event_id % 5 when 0 then 'run ' || event_id when 1 then '/f/' || user_id when 2 then 'p' || (user_id % 10) || ' in /r' when 3 then 'p' || (user_id % 10)
      else '{"command":"run ' || event_id || '","file_path":"/f/' || user_id || '","pattern":"p' || (user_id % 10) || '","path":"/r"}' end as summary from events"""),
    _both(s15_epoch, "select event_id, case when event_id % 7 != 0 then make_timestamp((1700000000 + event_id) * 1000000 + 250000) end as ts from events"),
])
