"""Packing of documents into training windows by Karmarkar-Karp multiway differencing.

Each document starts as a partial partition of k windows, all empty but one. The two partial
partitions with the greatest imbalance are merged, the fullest windows of one with the emptiest of
the other, until one is left, whose windows are nearly equal. If one exceeds the capacity, the number
of windows rises and the differencing is run again.

A document longer than a window is cut; its full pieces are windows by themselves and the rest is
packed. Documents are dealt by a hash of the id into shards of about SHARD_TOKENS tokens, which are
packed on their own; rows that repeat are counted first and spread over the shards, so work and memory
of a task don't depend on the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTE, buffer_of, materialize, only, slices, word_spans

CAPACITY = 4096
SHARD_TOKENS = 1 << 20
SCHEMA = "window_id string, window_tokens bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint"


def token_counts(texts: pa.Array) -> np.ndarray:
    """Tokens of each text: every word, and every other character that is neither white space nor
    part of a word."""
    data, off = buffer_of(texts)
    _, _, woff = word_spans(data, off)
    c = np.concatenate(([0], np.cumsum(~WORD_BYTE[data] & (data > 32))))
    return np.diff(woff) + c[off[1:]] - c[off[:-1]]


def _difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """The items of each of k windows."""
    n = len(sizes)
    left, right, nodes = [-1] * (2 * n), [-1] * (2 * n), n  # every merge of two windows makes a node: n - k in all
    heap: list[tuple[float, int, np.ndarray, np.ndarray]] = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-float(s), i, np.array([s], dtype=np.int64), np.array([i], dtype=np.int64)))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, sa, ia = heapq.heappop(heap)
        _, _, sb, ib = heapq.heappop(heap)
        over = len(sa) + len(sb) - k
        if over <= 0:  # each window of one meets an empty one of the other
            s, ids = np.concatenate([sa, sb]), np.concatenate([ia, ib])
        else:
            lo = len(sa) - over  # sums are in falling order: the last `over` of a meet the last of b, crosswise
            joined = np.empty(over, dtype=np.int64)
            for x in range(over):
                left[nodes], right[nodes] = int(ia[lo + x]), int(ib[len(sb) - 1 - x])
                joined[x] = nodes
                nodes += 1
            s = np.concatenate([sa[:lo], sa[lo:] + sb[::-1][:over], sb[: len(sb) - over]])
            ids = np.concatenate([ia[:lo], joined, ib[: len(ib) - over]])
        order = np.argsort(-s, kind="stable")
        s, ids = s[order], ids[order]
        spread = int(s[0]) - (int(s[-1]) if len(s) == k else 0)
        heapq.heappush(heap, (-float(spread), tick, s, ids))
        tick += 1
    out = []
    for root in heap[0][3].tolist():
        own, stack = [], [root]
        while stack:
            x = stack.pop()
            if x < n:
                own.append(x)
            else:
                stack += [left[x], right[x]]
        out.append(sorted(own))
    return out


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows (lists of positions) of at most `capacity`, for sizes of 1 to capacity."""
    if not len(sizes):
        return []
    k = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    k = min(k, len(sizes))
    while True:
        windows = _difference(sizes, k)
        sums = np.array([sizes[w].sum() for w in windows])
        excess = np.maximum(sums - capacity, 0).sum()
        if not excess or k >= len(sizes):
            return windows
        k = min(len(sizes), k + max(1, int(excess // capacity)))


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n): a hash of the text and its tokens, for every row that has tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = token_counts(part.column("text"))
                have = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(have), part.column("th").filter(have), pa.array(n, pa.int64()).filter(have)], ["doc_id", "th", "n"])

    own = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return own.mapInArrow(run, "doc_id bigint, th bigint, n bigint")


def pack_windows(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text): its window, that window's tokens,
    and the tokens [start_token, start_token + n_tokens) of the document that it holds.

    Null texts and texts without tokens are in no window. Repeated rows are packed each; ties go by
    id and then by a hash of the text, so the result doesn't depend on the order of rows; a null
    doc_id stays null. An empty table gives no rows. Other columns are ignored, whatever their names.
    A text of n bytes takes about 20 n bytes of memory in its task.
    """
    if capacity < 1:
        raise ValueError("capacity is 1 or more")
    sizes = materialize(lengths(docs), "lengths")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(1, round(total / shard_tokens))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "th", "n", "copies"], kind="stable", na_position="last")
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].reset_index(drop=True)
        n = pdf["n"].to_numpy()
        full, rest = n // capacity, n % capacity
        small = np.flatnonzero(rest)
        windows = pack(rest[small], capacity)
        rows, no = [], 0
        for own in windows:
            at = small[own]
            rows.append((np.full(len(at), no), np.full(len(at), rest[at].sum()), at, full[at], full[at] * capacity, rest[at]))
            no += 1
        at = np.repeat(np.arange(len(n)), full)
        if len(at):
            piece = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
            rows.append((no + np.arange(len(at)), np.full(len(at), capacity), at, piece, piece * capacity, np.full(len(at), capacity)))
        w, t, d, p, s, c = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pd.DataFrame({"window_id": [f"{key[0]}-{x}" for x in w], "window_tokens": t, "doc_id": pdf["doc_id"].astype("Int64").to_numpy()[d] if pdf["doc_id"].isna().any() else pdf["doc_id"].to_numpy()[d], "piece": p.astype(np.int32), "start_token": s, "n_tokens": c})

    # rows that are alike are counted before they are dealt: each gives one row to each of as many shards as it has copies
    alike = sizes.groupBy("doc_id", "th", "n").agg(F.count("*").alias("m"))
    parts = F.least("m", F.lit(shards))
    dealt = alike.select("doc_id", "th", "n", "m", parts.alias("parts"), F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("j"))
    copies = (F.floor(F.col("m") / F.col("parts")) + (F.col("j") < F.col("m") % F.col("parts")).cast("int")).cast("bigint").alias("copies")
    shard = F.pmod(F.xxhash64(F.lit(17), "doc_id", "th") + F.col("j"), F.lit(shards)).alias("shard")
    return dealt.select(shard, "doc_id", "th", "n", copies).groupBy("shard").applyInPandas(run, SCHEMA)
