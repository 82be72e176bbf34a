"""Document fingerprints by locally consistent parsing.

Words are named by a hash. Each round (1) folds runs of one name into a name of their own, so that
neighbours differ, (2) tosses deterministic coins: a name becomes 2*i+bit, where i is the lowest bit
in which it differs from its left neighbour; four tosses bring 64 bits down to 6 labels, which are
then recoloured to 3, (3) starts a phrase at each local maximum and at each local minimum that is
not beside a maximum, so that phrases have 2 or 3 names (the first may have 1), and (4) names each
phrase by a hash of its names. A phrase border depends on a bounded neighbourhood only, so equal
passages have the same phrase names inside, wherever they stand; only names near the passage's ends
may differ. Rounds go on until one name, the root, is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLD, U64, fmix, list_array, only, slices, word_hashes

SALT = 16
SCHEMA = "doc_id bigint, n_words int, n_levels int, root bigint, phrases array<bigint>, phrase_words array<int>"


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    left = np.empty_like(x)
    left[0], left[1:] = 0, x[:-1]
    d = x ^ left
    i = np.bitwise_count((d & (~d + U64(1))) - U64(1)).astype(U64)
    i[first] = 0
    return U64(2) * i + ((x >> i) & U64(1))


def _landmarks(names: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a phrase starts at a name; neighbours in a document differ."""
    n = len(names)
    first = off[:-1]
    x = names
    for _ in range(4):
        x = _toss(x, first)
    lab = np.full(n + 2, 9, dtype=np.int8)
    lab[1:-1] = x
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[first], is_last[off[1:] - 1] = True, True
    for v in (3, 4, 5):
        at = np.flatnonzero(lab[1:-1] == v)
        a = np.where(is_first[at], 9, lab[at])
        b = np.where(is_last[at], 9, lab[at + 2])
        free = np.where((a != 0) & (b != 0), 0, np.where((a != 1) & (b != 1), 1, 2))
        lab[at + 1] = free
    mid = lab[1:-1]
    a, b = np.where(is_first, -1, lab[:-2]), np.where(is_last, -1, lab[2:])
    top = (mid > a) & (mid > b)
    a, b = np.where(is_first, 9, lab[:-2]), np.where(is_last, 9, lab[2:])
    low = (mid < a) & (mid < b)
    beside = np.zeros(n, bool)
    beside[1:] |= top[:-1] & ~is_first[1:]
    beside[:-1] |= top[1:] & ~is_last[:-1]
    return top | (low & ~beside) | is_first


def fold(names: np.ndarray, sizes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over documents that each have names; sizes are the words under each name."""
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new[off[:-1]] = True
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(names))).astype(U64)
    names, sizes, off = names[at], np.add.reduceat(sizes, at), np.searchsorted(at, off)
    names = np.where(runs > 1, fmix(names * GOLD + runs), names)
    at = np.flatnonzero(_landmarks(names, off))
    n = np.diff(np.append(at, len(names)))
    pad = np.concatenate([names, np.zeros(2, U64)])
    h = fmix(pad[at] + U64(0x1234567))
    h = np.where(n > 1, fmix(h * GOLD + pad[at + 1]), h)
    h = np.where(n > 2, fmix(h * GOLD + pad[np.minimum(at + 2, len(names))]), h)
    return h, np.add.reduceat(sizes, at), np.searchsorted(at, off)


def parse(texts: pa.Array, level: int) -> tuple[np.ndarray, ...]:
    """n_words, n_levels, root of each text; the phrases of the given level (the root where there are
    fewer levels), the words under each and their offsets."""
    names, off = word_hashes(texts)
    count = np.diff(off)
    n = len(count)
    levels, root = np.zeros(n, np.int32), np.zeros(n, U64)
    kept: list[np.ndarray] = [np.zeros(0, U64)]
    kept_sizes: list[np.ndarray] = [np.zeros(0, np.int64)]
    kept_doc: list[np.ndarray] = [np.zeros(0, np.int64)]
    docs = np.flatnonzero(count)
    off = np.append(off[:-1][docs], len(names))
    sizes = np.ones(len(names), np.int64)
    depth = 0
    while len(docs):
        size = np.diff(off)
        done = size == 1
        if depth == level:
            kept.append(names), kept_sizes.append(sizes), kept_doc.append(np.repeat(docs, size))
        if done.any():
            at = off[:-1][done]
            root[docs[done]], levels[docs[done]] = names[at], depth
            if depth < level:
                kept.append(names[at]), kept_sizes.append(sizes[at]), kept_doc.append(docs[done])
            stay = np.repeat(~done, size)
            names, sizes, docs = names[stay], sizes[stay], docs[~done]
            off = np.concatenate(([0], np.cumsum(size[~done])))
            if not len(docs):
                break
        names, sizes, off = fold(names, sizes, off)
        depth += 1
    doc = np.concatenate(kept_doc)
    order = np.argsort(doc, kind="stable")
    poff = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
    return count, levels, root, np.concatenate(kept)[order], np.concatenate(kept_sizes)[order], poff


def lcp_fingerprints(docs: DataFrame, level: int = 2) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns are ignored): the root name of the
    whole text, which equal word sequences share, and the phrase names of `level` in text order (at
    level 2 some five words each) with the number of words under each.

    Null text and text without words: n_words 0, n_levels 0, null root, empty lists. A one-word text
    is its own root at level 0. Texts with at most `level` levels have their root as only phrase. A
    null doc_id stays null; repeated rows give repeated rows; an empty table gives no rows. A text is
    never cut: one of n bytes takes about 100 n bytes of memory in its task.
    """
    if level < 0:
        raise ValueError("level is 0 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                count, levels, root, names, sizes, off = parse(part.column("text"), level)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), pa.array(count, pa.int32()), pa.array(levels, pa.int32()),
                        pa.array(root.view(np.int64), mask=count == 0), list_array(names.view(np.int64), off, pa.int64()), list_array(sizes, off, pa.int32()),
                    ],
                    ["doc_id", "n_words", "n_levels", "root", "phrases", "phrase_words"],
                )

    return only(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def shared_phrases(fingerprints: DataFrame, min_words: int = 4) -> DataFrame:
    """(phrase, words, n_docs, first_doc_id) of each phrase of at least `min_words` words that several
    documents hold. Counted by one shuffle of partial counts; null ids don't count as documents."""
    one = fingerprints.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.arrays_zip("phrases", "phrase_words")).alias("p"))
    one = one.where(F.col("p.phrase_words") >= min_words).select("doc_id", F.col("p.phrases").alias("phrase"), F.col("p.phrase_words").alias("words")).distinct()
    found = one.groupBy("phrase").agg(F.max("words").alias("words"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id"))
    return found.where("n_docs > 1")


def phrase_windows(names: np.ndarray, sizes: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """From each phrase on, the fewest phrases of its document with `least` words or more: name,
    document, phrase number, first word, words. Phrases with too few words after them give none."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    to = np.searchsorted(ends, starts + least)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(to < off[1:][doc])
    n, doc = to[at] - at + 1, doc[at]
    h = fmix(names[at] + U64(0x5DEECE66D))
    for t in range(1, int(n.max(initial=1))):
        more = np.flatnonzero(n > t)
        h[more] = fmix(h[more] * GOLD + names[at[more] + t])
    first = off[:-1][doc]
    return h, doc, at - first, starts[at] - starts[first], ends[to[at]] - starts[at]


def shared_passages(docs: DataFrame, min_words: int = 12, level: int = 2) -> DataFrame:
    """(first_doc_id, start_word, n_words, n_docs, doc_id): passages that several documents hold, a row
    for each passage and each document that holds it. A passage is named by its place in the document
    with the least id; n_docs is the number of its documents.

    Windows of phrases with at least `min_words` words are counted over all documents, and windows that
    follow each other in the first document and have the same documents are one passage. Where a part
    has more documents than the rest, each part is a passage of its own. Names near a passage's ends
    differ (see above), so n_words may leave out words there; passages of over 50 words are found at
    level 2. Within a document the first place of a window counts. Null ids don't count as documents.
    Null and empty texts share nothing; repeated rows of one id are one document; an empty table gives
    no rows; other columns are ignored.

    No group is gathered in a task, however many documents hold a window: counts, the first document and
    a sum of hashes, which stands for the set of documents, are combined before they are shuffled.
    """
    if min_words < 1 or level < 0:
        raise ValueError("min_words is 1 or more, level 0 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, sizes, off = parse(part.column("text"), level)[3:]
                h, doc, k, start, words = phrase_windows(names, sizes, off, min_words)
                order = np.lexsort((k, h, doc))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                at = order[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), part.column("doc_id").cast(pa.int64()).take(pa.array(doc[at])), pa.array(k[at] << 31 | start[at], pa.int64()), pa.array(words[at], pa.int32())],
                    ["window", "doc_id", "place", "words"],
                )

    one = only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, "window bigint, doc_id bigint, place bigint, words int")
    several = one.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("window")
    held = one.join(several, "window", "left_semi").groupBy("window", "doc_id").agg(F.min(F.struct("place", "words")).alias("p"))
    held = held.select("window", "doc_id", "p.place", "p.words")
    found = held.groupBy("window").agg(F.count("*").alias("n_docs"), F.sum(F.shiftright(F.xxhash64("doc_id"), 24)).alias("set"), F.min(F.struct("doc_id", "place", "words")).alias("p"))
    found = found.select("window", "n_docs", "set", F.col("p.doc_id").alias("first_doc_id"), F.shiftright("p.place", 31).alias("k"), F.col("p.place").bitwiseAND((1 << 31) - 1).alias("start"), F.col("p.words").alias("words"))
    number = F.row_number().over(Window.partitionBy("first_doc_id", "n_docs", "set").orderBy("k", "start", "window"))
    runs = found.withColumn("run", F.col("k") - number).groupBy("first_doc_id", "n_docs", "set", "run")
    runs = runs.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("words")).alias("end"), F.min("window").alias("window"))
    # one window of each passage leads to its documents; the passages are copied SALT times to split a window that many hold
    salted = held.select("window", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).alias("salt"))
    runs = runs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    out = salted.join(runs, ["window", "salt"])
    return out.select("first_doc_id", F.col("start").cast("int").alias("start_word"), (F.col("end") - F.col("start")).cast("int").alias("n_words"), "n_docs", "doc_id")
