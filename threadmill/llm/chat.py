"""Chat formatting with typed content parts.

A turn's content is plain text, or a JSON array of parts: objects with a `type` of text, image, audio
or document, or with nested parts in `content`. A visitor walks the parts in order; text is copied,
each attachment becomes a numbered placeholder, and its reference and expanded token count are noted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only
from .packing import token_counts

IMAGE_PATCH = 28
IMAGE_SIDE = 448
AUDIO_TOKENS_A_SECOND = 25
PAGE_TOKENS = 512
TURN_TOKENS = 2  # the markers around a turn
PIECE, TURN_BYTES = 2 << 20, 100  # bytes of text worked on at once, and what a turn counts besides its text
MAX_TOKENS = 1 << 31  # more tokens of one attachment count as so many
SCHEMA = "conv_id bigint, prompt string, n_turns bigint, n_tokens bigint, n_attachments bigint, attachments string"


def _number(value: Any, default: float) -> float:
    """A finite positive number, or the default; numbers over MAX_TOKENS count as that."""
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and value > 0
    return float(min(value, MAX_TOKENS)) if ok and value not in (math.inf,) else default


def _clean(text: str) -> str:
    """Half a surrogate pair, which JSON can hold and UTF-8 can't, becomes the replacement character."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Visitor:
    """Flattens the parts of one conversation."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.texts: list[str] = []
        self.attachments: list[dict[str, Any]] = []
        self.count = {"image": 0, "audio": 0, "document": 0}
        self.turn: int | None = None

    def visit(self, part: Any) -> None:
        """Parts in order; the stack is explicit, so that nesting has no limit."""
        stack = [part]
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                self.visit_text({"text": part})
            elif isinstance(part, list):
                stack += part[::-1]
            elif isinstance(part, dict):
                kind = part.get("type")
                if kind in ("text", "image", "audio", "document"):
                    getattr(self, f"visit_{kind}")(part)
                else:
                    stack.append(part.get("content"))

    def visit_text(self, part: dict[str, Any]) -> None:
        text = part.get("text")
        if isinstance(text, str):
            text = _clean(text)
            self.out.append(text.replace("<|", "< |"))  # no text can pass for a marker
            self.texts.append(text)

    def visit_image(self, part: dict[str, Any]) -> None:
        w, h = _number(part.get("width"), IMAGE_SIDE), _number(part.get("height"), IMAGE_SIDE)
        self._attach("image", part, math.ceil(w / IMAGE_PATCH) * math.ceil(h / IMAGE_PATCH))

    def visit_audio(self, part: dict[str, Any]) -> None:
        self._attach("audio", part, math.ceil(_number(part.get("seconds"), 0) * AUDIO_TOKENS_A_SECOND))

    def visit_document(self, part: dict[str, Any]) -> None:
        text = part.get("text")
        n = int(token_counts(pa.array([_clean(text)]))[0]) if isinstance(text, str) else math.ceil(_number(part.get("pages"), 1)) * PAGE_TOKENS
        self._attach("document", part, n)

    def _attach(self, kind: str, part: dict[str, Any], tokens: int) -> None:
        self.count[kind] += 1
        mark = f"<|{kind}_{self.count[kind]}|>"
        ref = next((_clean(part[k]) for k in ("url", "file", "name", "id") if isinstance(part.get(k), str)), None)
        self.out.append(mark)
        self.attachments.append({"placeholder": mark, "kind": kind, "ref": ref, "turn": self.turn, "n_tokens": min(tokens, MAX_TOKENS)})


def parts_of(text: str | None) -> Any:
    """The parts of a content string: those of a JSON array that holds an object with a type or
    content, else the string itself."""
    if text is None:
        return []
    if text.lstrip()[:1] == "[":
        try:
            parts = json.loads(text)
        except (ValueError, RecursionError):
            return text
        if isinstance(parts, list) and any(isinstance(p, dict) and ("type" in p or "content" in p) for p in parts):
            return parts
    return text


def render(turns: list[dict[str, Any]]) -> tuple[str, list[str], list[dict[str, Any]], int]:
    """The prompt, its texts, its attachments and the tokens of attachments and markers."""
    v = Visitor()
    for t in turns:
        v.turn = t["turn"]
        role = (t["role"] or "unknown").replace("<|", "< |")
        v.out.append(f"<|{role}|>\n")
        v.visit(parts_of(t["text"]))
        v.out.append("<|end|>\n")
    return "".join(v.out), v.texts, v.attachments, min(sum(a["n_tokens"] for a in v.attachments) + TURN_TOKENS * len(turns), 1 << 62)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about PIECE bytes of text: Python's objects take many times the
    room of Arrow's, and a batch has as many rows as Spark puts into it."""
    turns = batch.column("turns")
    sizes = pc.fill_null(pc.binary_length(pc.struct_field(turns.values, "text")), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes.astype(np.int64) + TURN_BYTES)))[turns.offsets.to_numpy()]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def with_parts(conversations: DataFrame) -> DataFrame:
    """`conversations` with typed parts made of its plain text by rule, to try the visitor on: turns of
    number 1 modulo 3 hold their text, an image and an audio clip; those of number 2 hold a document
    and then their text, nested one level down; the others stay."""
    turn, own = F.col("turn"), F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    image = F.format_string('{"type":"image","url":"i%d","width":%d,"height":%d}', turn, 28 * (turn + 1), F.lit(60).cast("bigint"))
    audio = F.format_string('{"type":"audio","file":"a%d.wav","seconds":%d}', turn, turn + 1)
    document = F.format_string('{"type":"document","name":"d%d","pages":%d}', turn, turn)
    parts = F.when(turn % 3 == 1, F.concat(F.lit("["), own, F.lit(","), image, F.lit(","), audio, F.lit("]")))
    parts = parts.when(turn % 3 == 2, F.concat(F.lit("["), document, F.lit(',{"content":['), own, F.lit("]}]")))
    return conversations.withColumn("text", F.when(F.col("text").isNotNull(), parts.otherwise(F.col("text"))))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations` (conv_id, turn, role, text): the prompt of all its
    turns in order, its tokens with attachments expanded, and the attachments as JSON.

    Turns of equal number go by role, then text; repeated rows are repeated turns; a null turn number
    comes first. A null role is "unknown", a null text an empty turn. Text that isn't a JSON array of
    parts, and JSON nested too deeply for the parser, is plain text; parts of unknown type without
    content are skipped. Sizes that aren't positive numbers are the usual ones, and an attachment has
    at most MAX_TOKENS tokens. Halves of surrogate pairs become the replacement character. Rows with
    null conv_id belong to no conversation; an empty table gives no rows. Other columns are ignored,
    whatever their names. A conversation is one prompt, so all its turns meet in one task.
    """
    conversations = only(conversations, "conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in batches for piece in _pieces(batch)):
            done = [render(t) for t in batch.column("turns").to_pylist()]
            texts = [x for d in done for x in d[1]]
            n = np.concatenate(([0], np.cumsum(token_counts(pa.array(texts, pa.large_string()))))) if texts else np.zeros(1, np.int64)
            ends = np.cumsum([0] + [len(d[1]) for d in done])
            tokens = n[ends[1:]] - n[ends[:-1]] + np.array([d[3] for d in done], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array([d[0] for d in done], pa.string()), batch.column("n_turns"), pa.array(tokens, pa.int64()),
                    pa.array([len(d[2]) for d in done], pa.int64()), pa.array([json.dumps(d[2], ensure_ascii=False) for d in done], pa.string()),
                ],
                ["conv_id", "prompt", "n_turns", "n_tokens", "n_attachments", "attachments"],
            )

    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "text").alias("t"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.count("*").alias("n_turns")).mapInArrow(run, SCHEMA)
