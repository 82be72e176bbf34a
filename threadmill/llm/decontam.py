"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles into classes (u/2, u]. Containment of an item
in a long text says little about their Jaccard similarity, so for each class a text is cut into
windows of 2u shingles, one every u: any run of u shingles lies within one, and a window that holds
a share t of an item has a Jaccard similarity of at least t/(5-t) with it. 64 minima of linear
permutations are compared one by one (bands of one row), which finds a window at t = 0.5 with
probability 0.9995. Documents found so are verified by exact containment of the item's word shingles
in the whole document. Items of fewer words than a shingle has are one shingle, looked up as such.

Windows take their minima from blocks of 8 shingles, so the 64 functions are evaluated once for all
classes. Nothing is shuffled: items travel to the tasks in broadcasts of at most BROADCAST_BYTES;
where the benchmark is larger it is dealt into that many parts, one pass over the documents for each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, fmix, need_columns, numbered, only, shingles, slices, word_hashes

SHINGLE = 5
N_HASH = 64
THRESHOLD = 0.5
BLOCK = 8
BROADCAST_BYTES = 32 << 20
WORD = re.compile("[0-9a-z_\u0080-\U0010ffff]+")
SCHEMA = "doc_id bigint, item_id bigint, containment double, n_shingles bigint"
_rng = fmix(np.arange(1, 2 * N_HASH + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
MUL, ADD = (_rng[:N_HASH] >> U64(32)).astype(np.uint32) | np.uint32(1), (_rng[N_HASH:] >> U64(32)).astype(np.uint32)


def word_shingles(lowered: str, k: int = SHINGLE) -> tuple[int, set[tuple[str, ...]]]:
    """The exact shingles of a lower-cased text and their length: all words where there are fewer."""
    w = WORD.findall(lowered)
    k = min(k, len(w))
    return k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


class Index:
    """The items of one broadcast: sorted minima by class and function, short items by their hash."""

    def __init__(self, ids: list[int | None], texts: list[str | None], k: int) -> None:
        self.k, self.ids = k, ids
        lowered = pc.fill_null(pc.utf8_lower(pa.array(texts, pa.large_string())), "")
        self.sets = [word_shingles(t, k) for t in lowered.to_pylist()]
        words, woff = word_hashes(lowered)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for length in range(1, k):
            mine = np.flatnonzero(np.diff(woff) == length)
            if len(mine):
                h = np.array([shingles(words[woff[i] : woff[i + 1]], np.array([0, length]), length)[0][0] for i in mine], dtype=U64)
                order = np.argsort(h)
                self.short[length] = (h[order], mine[order])
        for i in np.flatnonzero(np.diff(woff) >= k):
            h, _ = shingles(words[woff[i] : woff[i + 1]], np.array([0, woff[i + 1] - woff[i]]), k)
            for size in {len(h), len(np.unique(h))}:  # an item that repeats itself is in the class of its distinct shingles too
                classes.setdefault(max(BLOCK, 1 << (size - 1).bit_length()), []).append((i, (h >> U64(32)).astype(np.uint32)))
        self.classes = {}
        for u in sorted(classes):
            which = np.array([i for i, _ in classes[u]])
            minima = np.stack([(h[None, :] * MUL[:, None] + ADD[:, None]).min(axis=1) for _, h in classes[u]])
            order = np.argsort(minima, axis=0)
            bits = max(16, int(len(which)).bit_length() + 8)
            seen = np.zeros((N_HASH, 1 << min(bits, 24)), dtype=bool)
            shift = np.uint32(32 - min(bits, 24))
            for j in range(N_HASH):
                seen[j, minima[:, j] >> shift] = True
            self.classes[u] = (np.take_along_axis(minima, order, axis=0), which[order], seen, shift)

    def _matches(self, values: np.ndarray, where: np.ndarray, keys: np.ndarray, items: np.ndarray) -> set[tuple[int, int]]:
        lo, hi = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        hit = np.flatnonzero(hi > lo)
        return {(int(where[x]), int(items[y])) for x in hit for y in range(lo[x], hi[x])}

    def candidates(self, lowered: pa.Array) -> set[tuple[int, int]]:
        """(document, item) pairs worth verifying."""
        words, woff = word_hashes(lowered)
        pairs: set[tuple[int, int]] = set()
        for length, (keys, items) in self.short.items():
            h, doc = shingles(words, woff, length, short=False)
            pairs |= self._matches(h, doc, keys, items)
        if not self.classes:
            return pairs
        h, doc = shingles(words, woff, self.k, short=False)
        if not len(h):
            return pairs
        count = np.bincount(doc, minlength=len(woff) - 1)
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        n_blocks = -(-count // BLOCK)
        owner = np.repeat(np.arange(len(count)), n_blocks)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        place = first[owner] + BLOCK * inside
        last = (first + count - 1)[owner]
        x = (h >> U64(32)).astype(np.uint32)
        x = np.stack([x[np.minimum(place + j, last)] for j in range(BLOCK)])  # a last block is filled up with its last shingle
        minima = np.empty((N_HASH, len(owner)), dtype=np.uint32)
        for j in range(N_HASH):
            minima[j] = (x * MUL[j] + ADD[j]).min(axis=0)
        u = BLOCK
        for want in sorted(self.classes):
            while u < want:
                at = np.flatnonzero(inside % 2 == 0)
                minima = np.minimum.reduceat(minima, at, axis=1)
                owner, inside, u = owner[at], inside[at] // 2, 2 * u
            window = minima.copy()
            near = np.flatnonzero(owner[:-1] == owner[1:])
            window[:, near] = np.minimum(window[:, near], minima[:, near + 1])
            keys, items, seen, shift = self.classes[want]
            for j in range(N_HASH):
                hit = np.flatnonzero(seen[j][window[j] >> shift])
                if len(hit):
                    pairs |= self._matches(window[j][hit], owner[hit], keys[:, j], items[:, j])
        return pairs

    def contained(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, float]]:
        """(document, item, containment) of all verified pairs."""
        lowered = pc.fill_null(pc.utf8_lower(texts), "")
        by_doc: dict[int, list[int]] = {}
        for d, i in self.candidates(lowered):
            by_doc.setdefault(d, []).append(i)
        out = []
        for d in sorted(by_doc):
            w = WORD.findall(lowered[d].as_py())
            sets: dict[int, set[tuple[str, ...]]] = {}
            for i in sorted(by_doc[d]):
                k, own = self.sets[i]
                if k not in sets:
                    sets[k] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)}
                share = len(own & sets[k]) / len(own)
                if share >= threshold:
                    out.append((d, i, share))
        return out


def _parts(items: DataFrame, limit: int) -> list[list]:
    """The items that have text, in parts of at most about `limit` bytes."""
    own = only(items, "item_id", "text").where(F.length("text") > 0).select(F.col("item_id").cast("bigint"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // limit)
    if n <= 1:
        return [own.collect()] if n else []
    return [own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect() for i in range(n)]


_made: dict[str, Index] = {}


def _index(name: str, items: tuple[list, list], k: int) -> Index:
    """Made once for each Python worker, which runs many tasks."""
    if name not in _made:
        _made.clear()
        _made[name] = Index(*items, k)
    return _made[name]


def _over(docs: DataFrame, rows: list, threshold: float, k: int, keep: bool) -> DataFrame:
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))  # at most about BROADCAST_BYTES
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared.value, k)
        for batch in batches:
            for part in slices(batch, "text"):
                found = index.contained(part.column("text"), threshold)
                if keep:
                    clean = np.ones(part.num_rows, bool)
                    clean[[d for d, _, _ in found]] = False
                    yield part.filter(pa.array(clean))
                elif found:
                    doc_id = part.column("doc_id").cast(pa.int64()).take(pa.array([d for d, _, _ in found]))
                    yield pa.RecordBatch.from_arrays(
                        [doc_id, pa.array([index.ids[i] for _, i, _ in found], pa.int64()), pa.array([c for *_, c in found]), pa.array([len(index.sets[i][1]) for _, i, _ in found], pa.int64())],
                        ["doc_id", "item_id", "containment", "n_shingles"],
                    )

    return docs.mapInArrow(run, docs.schema if keep else SCHEMA)


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles) for each row of `docs` and each row of `items` of
    whose distinct k-word shingles the text holds at least `threshold`.

    Items without words match nothing; items of fewer than k words match where all their words stand
    in a row. Null and empty texts hold nothing. Null ids stay null; repeated rows on either side give
    repeated rows; an empty table on either side gives no rows. Other columns are ignored, whatever
    their names. A containment of just `threshold` counts. A text is never cut: one of n bytes takes
    about 100 n bytes of memory in its task.
    """
    own = only(docs, "doc_id", "text")
    found = [_over(own, rows, threshold, k, keep=False) for rows in _parts(items, limit)]
    if not found:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, that find_contamination() doesn't report: null and
    empty texts stay, repeated rows go or stay together, an empty table stays empty. Names of columns
    may clash, hold dots or repeat (but text)."""
    names, docs = docs.columns, numbered(docs, "text")
    for rows in _parts(items, limit):
        docs = _over(docs, rows, threshold, k, keep=True)
    return docs.toDF(*names)
