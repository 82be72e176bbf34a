"""Transcripts of seven formats as one table of sessions.

Files are read as binary, told apart by path and content, and parsed one at a time on the executors;
one bad file gives a row with an error and no more.
"""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import PurePosixPath
from typing import Any

import pandas as pd
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from threadmill.model import PARSED_SESSION
from threadmill.storage import file_system, hadoop

RESULT_CHARS = 500
Json = Any


def dig(x: Json, *keys: str | int) -> Json:
    """The value under the keys, None where there is none."""
    for k in keys:
        if isinstance(k, int):
            x = x[k] if isinstance(x, list) and -len(x) <= k < len(x) else None
        else:
            x = x.get(k) if isinstance(x, dict) else None
    return x


def text_of(x: Json) -> str:
    return x if isinstance(x, str) else ""


def when(x: Json) -> datetime | None:
    """An RFC 3339 time in UTC."""
    if not isinstance(x, str):
        return None
    try:
        t = datetime.fromisoformat(x)
    except ValueError:
        return None
    return t.astimezone(UTC) if t.tzinfo else None


def from_epoch(x: Json, scale: float = 1.0) -> datetime | None:
    if not isinstance(x, (int, float)) or isinstance(x, bool):
        return None
    try:
        return datetime.fromtimestamp(x / scale, UTC)
    except (ValueError, OverflowError, OSError):
        return None


def cut_chars(s: str, n: int) -> str:
    return s if len(s) <= n else s[:n] + "..."


def cut_bytes(s: str, n: int) -> str:
    return s.encode()[:n].decode(errors="ignore")


def safe_project(name: str | None) -> str | None:
    return "".join(c if c.isalnum() or c in "-_ " else "_" for c in name).strip()[:50] if name else None


def base_name(path: str | None) -> str | None:
    return (PurePosixPath(path.replace("\\", "/")).name or None) if path else None


def tool(name: str | None, asked: str = "", answer: str = "", use_id: str | None = None) -> dict[str, Any]:
    return {"kind": "tool_use", "name": name or "unknown", "input_summary": asked, "output_summary": answer, "tool_use_id": use_id, "path": None, "cmd": None, "exit_code": None}


class Draft:
    """A session while its file is read."""

    def __init__(self, agent: str) -> None:
        self.row: dict[str, Any] = dict.fromkeys(("id", "model", "project", "cwd", "git_branch", "title", "start_time", "end_time"), None) | {"agent": agent}
        self.turns: list[dict[str, Any]] = []

    def say(self, role: str, content: str, ts: datetime | None = None, **more: Any) -> dict[str, Any]:
        turn = {"turn_index": len(self.turns), "role": role, "ts": ts, "content": content, "actions": [], "thinking": None, "tokens": None, "is_sidechain": False} | more
        self.turns.append(turn)
        return turn

    def first(self, name: str, value: Json) -> None:
        if self.row[name] is None and isinstance(value, str):
            self.row[name] = value

    def done(self) -> dict[str, Any]:
        return self.row | {"turns": self.turns}


def lines_of(data: bytes) -> Iterator[Json]:
    """The JSON objects of the lines; lines that don't parse are passed over."""
    for line in data.decode(errors="replace").splitlines():
        try:
            x = json.loads(line)
        except ValueError:
            continue
        if isinstance(x, dict):
            yield x


def summarize_input(name: str, args: Json) -> str:
    low = name.lower()
    if low == "bash":
        return text_of(dig(args, "command"))
    if low in ("read", "edit", "write", "multiedit"):
        return text_of(dig(args, "file_path"))
    if low == "grep":
        return f"{text_of(dig(args, 'pattern'))} in {text_of(dig(args, 'path'))}"
    if low == "glob":
        return text_of(dig(args, "pattern"))
    return cut_chars(json.dumps(args, ensure_ascii=False, separators=(",", ":")), 200)


def parse_event_log(path: str, data: bytes) -> list[dict[str, Any]]:
    """A: user and assistant events. Events of one message are one turn; a tool's result goes to the
    call of its id, if that is in the last turn."""
    if not data.strip():
        raise ValueError("empty file")
    s, open_calls, message = Draft("claude-code"), {}, None
    for e in lines_of(data):
        kind, ts, body = e.get("type"), when(e.get("timestamp")), dig(e, "message", "content")
        if isinstance(kind, str) and ts is not None:
            s.row["start_time"] = s.row["start_time"] or ts
            s.row["end_time"] = ts
        side = e.get("isSidechain") is True
        parts = [p for p in body if isinstance(p, dict)] if isinstance(body, list) else []
        if kind == "user":
            s.first("id", e.get("sessionId")), s.first("cwd", e.get("cwd")), s.first("git_branch", e.get("gitBranch"))
            results = [p for p in parts if p.get("type") == "tool_result"]
            for p in results:
                at = open_calls.get(text_of(p.get("tool_use_id")))
                if at is not None and s.turns and at < len(s.turns[-1]["actions"]):
                    out = p.get("content")
                    out = out if isinstance(out, str) else "\n".join(text_of(dig(x, "text")) for x in out or [])
                    s.turns[-1]["actions"][at]["output_summary"] = cut_chars(out, RESULT_CHARS)
            if results:
                open_calls = {}
                continue
            said = body if isinstance(body, str) else "\n".join(text_of(p.get("text")) for p in parts if p.get("type") == "text")
            if said:
                s.say("user", said, ts, is_sidechain=side)
        elif kind == "assistant":
            s.first("model", dig(e, "message", "model"))
            by = lambda t, k: "\n\n".join(p[k] for p in parts if p.get("type") == t and isinstance(p.get(k), str))  # noqa: E731, B023
            said, thought, usage = by("text", "text"), by("thinking", "thinking") or None, dig(e, "message", "usage")
            calls = [tool(p.get("name"), summarize_input(text_of(p.get("name")), p.get("input")), use_id=text_of(p.get("id"))) for p in parts if p.get("type") == "tool_use"]
            tokens = {"input": usage.get("input_tokens") or 0, "output": usage.get("output_tokens") or 0, "cached": usage.get("cache_read_input_tokens") or 0} if isinstance(usage, dict) else None
            mid = dig(e, "message", "id")
            if mid is not None and mid == message and s.turns and s.turns[-1]["role"] == "assistant":
                turn = s.turns[-1]
                turn["content"] = "\n\n".join(x for x in (turn["content"], said) if x)
                turn["thinking"] = "\n\n".join(x for x in (turn["thinking"], thought) if x) or None
                turn["tokens"] = tokens or turn["tokens"]
            else:
                turn, open_calls = s.say("assistant", said, ts, thinking=thought, tokens=tokens, is_sidechain=side), {}
            open_calls |= {c["tool_use_id"]: len(turn["actions"]) + i for i, c in enumerate(calls) if c["tool_use_id"]}
            turn["actions"] += calls
            message = mid
    s.row["id"] = s.row["id"] or PurePosixPath(path).stem
    s.row["project"] = base_name(s.row["cwd"])
    return [s.done()]


def parse_rollout(path: str, data: bytes) -> list[dict[str, Any]]:
    """B: typed records with a payload. The last time of any record is the session's end."""
    s, calls = Draft("codex"), {}
    s.row["id"] = PurePosixPath(path).stem.removeprefix("rollout-")
    as_text = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)
    for e in lines_of(data):
        ts, p = when(e.get("timestamp")), e.get("payload")
        if ts is not None:
            s.row["end_time"] = max(ts, s.row["end_time"] or ts)
        kind = dig(p, "type")
        if e.get("type") == "session_meta" and isinstance(dig(p, "id"), str):
            s.row |= {"id": p["id"], "cwd": dig(p, "cwd"), "start_time": when(dig(p, "timestamp"))}
        elif e.get("type") != "response_item":
            continue
        elif kind == "message" and dig(p, "role") in ("user", "assistant"):
            body = p.get("content")
            said = body if isinstance(body, str) else "\n".join(text_of(dig(x, "text")) for x in body or [] if dig(x, "type") in ("input_text", "output_text", "text"))
            if p["role"] == "user" and (not said or said.lstrip().startswith("# AGENTS.md instructions")):
                continue
            s.say(p["role"], said, ts)
        elif kind == "function_call" and s.turns:
            call = tool(p.get("name"), as_text(p.get("arguments")), use_id=text_of(p.get("call_id")))
            s.turns[-1]["actions"].append(call)
            if call["tool_use_id"]:
                calls[call["tool_use_id"]] = call
        elif kind == "function_call_output" and (call := calls.pop(text_of(p.get("call_id")), None)):
            call["output_summary"] = as_text(p.get("output"))
    if not s.turns:
        raise ValueError("no turns")
    s.row["project"] = base_name(s.row["cwd"])
    return [s.done()]


def _parts_text(body: Json) -> str:
    return body if isinstance(body, str) else "\n".join(text_of(dig(p, "text")) for p in body or [])


def parse_messages(path: str, data: bytes) -> list[dict[str, Any]]:
    """C: one JSON object with messages of user and model."""
    x = json.loads(data)
    s = Draft("gemini-cli")
    s.row |= {"id": dig(x, "sessionId"), "start_time": when(dig(x, "startTime")), "end_time": when(dig(x, "lastUpdated"))}
    m = re.search(r"/tmp/([^/]+)/chats/", path)
    s.row["project"] = m[1] if m else dig(x, "projectHash")
    for e in dig(x, "messages") or []:
        said, ts = _parts_text(dig(e, "content")), when(dig(e, "timestamp"))
        if dig(e, "type") == "user" and said:
            s.say("user", said, ts)
        elif dig(e, "type") == "gemini":
            s.first("model", dig(e, "model"))
            thought = "\n\n".join(t["description"] for t in dig(e, "thoughts") or [] if isinstance(dig(t, "description"), str)) or None
            use = dig(e, "tokens")
            tokens = {k: use.get(k) or 0 for k in ("input", "output", "cached")} if isinstance(use, dict) else None
            calls = []
            for c in dig(e, "toolCalls") or []:
                back = dig(c, "result", 0, "functionResponse", "response")
                calls.append(tool(dig(c, "name"), json.dumps(dig(c, "args"), ensure_ascii=False), text_of(dig(back, "output") if dig(back, "output") is not None else dig(back, "error"))))
            s.say("assistant", said, ts, thinking=thought, tokens=tokens, actions=calls)
    if not s.turns:
        raise ValueError("no turns")
    return [s.done()]


def _zip_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if name.endswith(".json"):
                yield name, z.read(name)


def is_zip(data: bytes) -> bool:
    return data[:4] == b"PK\x03\x04"


def parse_web_export(path: str, data: bytes) -> list[dict[str, Any]]:
    """D: an archive of JSON files, each a session; those that don't parse are passed over."""
    out = []
    for _, raw in _zip_members(data) if is_zip(data) else [("", data)]:
        try:
            x = json.loads(raw)
        except ValueError:
            continue
        if not isinstance(dig(x, "messages"), list):
            continue
        s = Draft("gemini-web")
        models = [dig(e, "model") for e in x["messages"] if dig(e, "type") == "gemini"]
        s.row |= {"id": dig(x, "sessionId"), "title": dig(x, "title"), "start_time": when(dig(x, "startTime")), "end_time": when(dig(x, "lastUpdated")), "model": models[-1] if models else None}
        for e in x["messages"]:
            s.say({"user": "user", "gemini": "assistant"}.get(dig(e, "type"), "system"), _parts_text(dig(e, "content")), when(dig(e, "timestamp")))
        out.append(s.done())
    return out


def _conversations(data: bytes) -> list[Json]:
    if is_zip(data):
        data = dict(_zip_members(data)).get("conversations.json") or b""
    x = json.loads(data)
    if not isinstance(x, list):
        raise ValueError("not a list of conversations")
    return x


def parse_chat_export(path: str, data: bytes) -> list[dict[str, Any]]:
    """E: conversations of messages made of blocks; results and attachments are cut to a number of bytes."""
    out = []
    for c in _conversations(data):
        s = Draft("claude-ai")
        messages = dig(c, "chat_messages") or []
        s.row |= {"id": dig(c, "uuid"), "title": dig(c, "name"), "project": safe_project(dig(c, "name")), "start_time": when(dig(c, "created_at")), "end_time": when(dig(messages, -1, "created_at"))}
        for m in messages:
            texts, thought, calls = [], None, []
            for b in dig(m, "content") or []:
                kind = dig(b, "type")
                if kind == "text":
                    texts.append(text_of(dig(b, "text")))
                elif kind == "thinking":
                    thought = dig(b, "thinking")
                elif kind == "tool_use":
                    title = dig(b, "input", "title")
                    calls.append(tool(dig(b, "name"), title if isinstance(title, str) else text_of(dig(b, "input", "query"))))
                elif kind == "tool_result":
                    texts += [cut_bytes(x["text"], 500) for x in dig(b, "content") or [] if isinstance(dig(x, "text"), str)]
            said = "\n".join(t for i, t in enumerate(texts) if t or i == 0)
            for a in dig(m, "attachments") or []:
                if text_of(dig(a, "extracted_content")):
                    name = f": {a['file_name']}" if isinstance(dig(a, "file_name"), str) else ""
                    said += f"\n\n[Attachment{name}]\n{cut_bytes(a['extracted_content'], 2000)}"
            s.say({"human": "user", "assistant": "assistant"}.get(dig(m, "sender"), "system"), said or text_of(dig(m, "text")), when(dig(m, "created_at")), thinking=thought, actions=calls)
        out.append(s.done())
    return out


def path_to_root(mapping: dict[str, Json], node: Json) -> list[Json]:
    """The messages from the root to the node; a cycle ends where it would begin again."""
    seen, chain = set(), []
    while isinstance(node, str) and node not in seen and isinstance(mapping.get(node), dict):
        seen.add(node)
        if mapping[node].get("message") is not None:
            chain.append(mapping[node]["message"])
        node = mapping[node].get("parent")
    return chain[::-1]


def _tree_content(m: Json) -> tuple[str, str | None]:
    c = dig(m, "content")
    kind = dig(c, "content_type") or "text"
    parts = "\n".join(p if isinstance(p, str) else "[attachment]" for p in dig(c, "parts") or [] if p not in ("", None))
    if kind in ("text", "code", "multimodal_text"):
        return parts, None
    if kind == "execution_output":
        return text_of(dig(c, "text")), None
    if kind == "reasoning_recap":
        return text_of(dig(c, "content")), text_of(dig(c, "content"))
    if kind == "thoughts":
        said = "\n".join(t["content"] for t in dig(c, "thoughts") or [] if text_of(dig(t, "content")))
        return said, said or text_of(dig(m, "metadata", "reasoning_title")) or "thinking"
    if kind == "tether_browsing_display":
        return text_of(dig(c, "result")), None
    if kind == "user_editable_context":
        return "\n".join(x for x in (text_of(dig(c, "user_profile")), text_of(dig(c, "user_instructions"))) if x), None
    return parts or text_of(dig(c, "text")) or text_of(dig(c, "content")), None


def parse_tree_export(path: str, data: bytes) -> list[dict[str, Any]]:
    """F: conversations as trees of messages; the branch of the current node is the session."""
    out = []
    for c in _conversations(data):
        s = Draft("chatgpt")
        chain = path_to_root(dig(c, "mapping") or {}, dig(c, "current_node"))
        slugs = [x for m in reversed(chain) for x in (dig(m, "metadata", "model_slug"), dig(m, "metadata", "resolved_model_slug")) if isinstance(x, str)]
        s.row |= {"id": dig(c, "conversation_id"), "title": dig(c, "title"), "project": safe_project(dig(c, "title")), "start_time": from_epoch(dig(c, "create_time")), "model": dig(c, "default_model_slug") or (slugs[0] if slugs else None)}
        for m in chain:
            role = dig(m, "author", "role")
            said, thought = _tree_content(m)
            if role == "system" or (not said and thought is None):
                continue
            ts = from_epoch(dig(m, "create_time"))
            s.row["end_time"] = ts or s.row["end_time"]
            s.say(role if role in ("user", "assistant") else "system", said, ts, thinking=thought)
        out.append(s.done())
    return out


def parse_session_export(path: str, data: bytes) -> list[dict[str, Any]]:
    """G: an object with info and messages; times are milliseconds."""
    x = json.loads(data)
    s = Draft("opencode")
    folder = dig(x, "info", "directory")
    s.row |= {"id": dig(x, "info", "id"), "title": dig(x, "info", "title"), "cwd": folder, "project": base_name(folder), "start_time": from_epoch(dig(x, "info", "time", "created"), 1000), "end_time": from_epoch(dig(x, "info", "time", "updated"), 1000)}
    for m in dig(x, "messages") or []:
        role = dig(m, "info", "role")
        if role == "assistant":
            s.first("model", dig(m, "info", "model", "modelID"))
        said = "\n".join(p["text"] for p in dig(m, "parts") or [] if dig(p, "type") == "text" and isinstance(dig(p, "text"), str))
        if said:
            s.say(role if role in ("user", "assistant") else "system", said, from_epoch(dig(m, "info", "time", "created"), 1000))
    if not s.turns:
        raise ValueError("no turns")
    return [s.done()]


PARSERS: dict[str, Callable[[str, bytes], list[dict[str, Any]]]] = {
    "claude-code": parse_event_log,
    "codex": parse_rollout,
    "gemini-cli": parse_messages,
    "gemini-web": parse_web_export,
    "claude-ai": parse_chat_export,
    "chatgpt": parse_tree_export,
    "opencode": parse_session_export,
}


def _list_kind(x: Json) -> str | None:
    if isinstance(dig(x, 0, "chat_messages"), list) and isinstance(dig(x, 0, "uuid"), str):
        return "claude-ai"
    if isinstance(dig(x, 0, "mapping"), dict) and isinstance(dig(x, 0, "conversation_id"), str):
        return "chatgpt"
    return None


def detect(path: str, data: bytes) -> str:
    """The format of a file: by its path, as an archive, by its first line, as a whole."""
    p = path.replace("\\", "/")
    if "/.claude/projects/" in p:
        return "claude-code"
    if "/.codex/sessions/" in p:
        return "codex"
    if "/.gemini/" in p and p.endswith(".json"):
        return "gemini-cli"
    if is_zip(data):
        for name, raw in _zip_members(data):
            try:
                x = json.loads(raw)
            except ValueError:
                continue
            if dig(x, "projectHash") == "gemini-web":
                return "gemini-web"
            if name == "conversations.json" and (kind := _list_kind(x)):
                return kind
        raise ValueError("unknown archive")
    for x in [next(lines_of(data.split(b"\n", 1)[0]), None)]:
        if isinstance(dig(x, "sessionId"), str) and dig(x, "type") in ("user", "assistant"):
            return "claude-code"
        if isinstance(dig(x, "type"), str) and isinstance(dig(x, "payload"), dict):
            return "codex"
    try:
        x = json.loads(data)
    except ValueError:
        raise ValueError("unknown format") from None
    if isinstance(dig(x, "info", "id"), str) and isinstance(dig(x, "messages"), list):
        return "opencode"
    if dig(x, "projectHash") == "gemini-web":
        return "gemini-web"
    if isinstance(dig(x, "messages"), list):
        return "gemini-cli"
    if kind := _list_kind(x):
        return kind
    raise ValueError("unknown format")


def parse_file(path: str, data: bytes) -> list[dict[str, Any]]:
    """The sessions of a file; a row with an error where it can't be read."""
    try:
        return [{"path": path, "error": None} | s for s in PARSERS[detect(path, data)](path, data)]
    except Exception as e:  # noqa: BLE001 - any bad file is a finding, not a failure
        none = dict.fromkeys(("id", "agent", "model", "project", "cwd", "git_branch", "title", "start_time", "end_time"), None)
        return [{"path": path, "error": f"{type(e).__name__}: {e}"[:300], "turns": []} | none]


def hidden_folders(root: str) -> list[str]:
    """Folders below the root whose names start with a dot or an underscore: Spark's listing passes
    over them unless they are named, and agents keep their files in such."""
    fs, base = file_system(root) if ":/" in root else (pfs.LocalFileSystem(), os.path.abspath(root))
    prefix = root[: len(root) - len(base)] if ":/" in root else ""
    found = [x.path for x in fs.get_file_info(pfs.FileSelector(base, recursive=True, allow_not_found=True)) if x.type == pfs.FileType.Directory and PurePosixPath(x.path).name[0] in "._"]
    return [prefix + p for p in sorted(found)]


def find_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below the root as (path, modificationTime, length, content), without those of subagents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load([root, *hidden_folders(root)])
    return found.where(~F.contains("path", F.lit("/subagents/")))


def discover(spark: SparkSession, root: str, agent: str) -> DataFrame:
    """The files of one agent: *.jsonl of the two line formats, session-*.json of the third."""
    return find_files(spark, root, {"claude-code": "*.jsonl", "codex": "*.jsonl", "gemini-cli": "session-*.json"}.get(agent, "*"))


def find_session(files: DataFrame, session_id: str) -> DataFrame:
    """Files named by the id, alone or before `_` or `-`."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.where((stem == session_id) | F.startswith(stem, F.lit(session_id + "_")) | F.startswith(stem, F.lit(session_id + "-")))


def resolve(spark: SparkSession, target: str, root: str, agent: str = "claude-code") -> DataFrame:
    """The paths that are meant by `target`: "auto" for the agent's files below the root, the files of a
    folder, a file, the files of a session id below the root, or else the path as it is."""
    if target == "auto":
        return discover(spark, root, agent).select("path")
    fs, at = hadoop(spark, target)
    if fs.exists(at):
        return find_files(spark, target).select("path") if fs.getFileStatus(at).isDirectory() else spark.createDataFrame([(target,)], "path string")
    if "/" not in target and "." not in target:
        return find_session(find_files(spark, root), target).select("path")
    return spark.createDataFrame([(target,)], "path string")


TOGETHER, TOGETHER_BYTES = 256, 4 << 20  # sessions, and bytes of their files, that go to Spark as one frame


def _frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sessions of files, TOGETHER of them in a frame: one for each file takes longer than its parsing."""
    for pdf in frames:
        rows, size = [], 0
        for path, data in zip(pdf["path"], pdf["content"], strict=True):
            rows += parse_file(path, bytes(data))
            size += len(data)
            if len(rows) >= TOGETHER or size >= TOGETHER_BYTES:
                yield pd.DataFrame(rows, columns=PARSED_SESSION.names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=PARSED_SESSION.names)


def parse_all(files: DataFrame) -> DataFrame:
    """Sessions of files (path, content); several paths to one file count once."""
    return files.select("path", "content").dropDuplicates(["path"]).mapInPandas(_frames, PARSED_SESSION)


def read_sessions(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return parse_all(find_files(spark, root, glob))


def turns_of(parsed: DataFrame) -> DataFrame:
    """One row for each turn, with the names of its tools."""
    names = F.array_distinct(F.transform("actions", lambda a: a["name"]))
    return parsed.where("error is null").select(F.col("id").alias("session_id"), F.explode("turns").alias("t")).select("session_id", "t.*").withColumn("tool_names", names).withColumn("has_tool", F.size("actions") > 0)


class TranscriptSource(DataSource):
    """spark.read.format("transcripts").load(folder): a partition for each 64 files of a folder that
    all machines see."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> StructType:
        return PARSED_SESSION

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options.get("path", ".")
        return _Reader(path if ":/" in path else "file://" + os.path.abspath(path), int(self.options.get("filesPerPartition", "64")))


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, each: int) -> None:
        self.root, self.each = root, each

    def partitions(self) -> list[InputPartition]:
        fs, base = file_system(self.root)
        found = fs.get_file_info(pfs.FileSelector(base, recursive=True))
        paths = sorted(x.path for x in found if x.type == pfs.FileType.File and "subagents" not in PurePosixPath(x.path).parts)
        return [_Files(paths[i : i + self.each]) for i in range(0, len(paths), self.each)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = file_system(self.root)

        def value(x: Any, kind: Any) -> Any:
            if isinstance(x, list):
                return [value(y, kind.elementType) for y in x]
            return tuple(value(x.get(f.name), f.dataType) for f in kind.fields) if isinstance(x, dict) else x

        for p in partition.paths:
            with fs.open_input_file(p) as f:
                data = f.read()
            for s in parse_file(p, data):
                yield tuple(value(s[f.name], f.dataType) for f in PARSED_SESSION.fields)
