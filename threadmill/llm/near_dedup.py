"""Near-duplicates by BagMinHash over multisets of word bigrams.

Signatures. Each bigram owns a Poisson process on (0, inf) x (time); its points have a height (which
weight they need) and a component of the signature, both uniform. A document whose count of the
bigram is c sees the points of height up to c, and component i of its signature is the first point of
all its bigrams with that component: two documents agree in a component with probability equal to
their weighted Jaccard similarity (Ertl 2018). The weight axis is split in dyadic levels (0,1], (1,2],
(2,4], ..., each with a process of its own made from the bigram alone, so only the levels up to the
count are made, and only the last level needs the points' heights. Points are made in time order up
to the time by which all components are met, as in the sequential algorithm, whose result this is.

Pipeline. (1) Documents of equal multisets are collapsed to one. (2) Signatures of 80 components are
cut into 20 bands of 4. (3) In each bucket all members are paired with the least one and verified by
the exact multiset overlap. (4) Verified pairs make connected components. (5) Members of a bucket that
are in different components yet are paired too, unless their distances to the least one differ by more
than 1 - threshold (Jaccard distance is a metric) or their sizes by more than the threshold allows, in
which cases they can't be similar. So every pair that shares a bucket is verified, is connected already,
or is ruled out, without a cap; a bucket of n copies costs n pairs, not n^2. (6) Components are formed
again.

What is asked of a bucket (its least member, its size, its components) is aggregated before it is
shuffled and joined back, so no task holds a bucket, however many rows share it; Spark splits the larger
side of a skewed join.

Signatures travel with the place of their row (file and row number). The texts of candidates, and at
the end the rows that stay, are picked in a map over the files by lists of places that lie in the
shared folder; so the corpus itself is never shuffled, only signatures and the candidates' texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE, GOLD, ROW, U64, Scratch, at_places, fmix, list_array, located, materialize, numbered, only, shingles, slices, word_hashes, write_places

COMPONENTS, BANDS = 80, 20
THRESHOLD = 0.6
SHINGLE = 2


def multisets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, count) of each distinct shingle, sorted by document and element; elements
    have 44 bits of their hash within a slice of at most 2^20 documents."""
    words, woff = word_hashes(texts)
    h, doc = shingles(words, woff, k)
    key = np.sort((doc.astype(U64) << U64(44)) | (h >> U64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> U64(44)).astype(np.int64), key[at] & U64((1 << 44) - 1), np.diff(np.append(at, len(key)))


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """(n x m) times of the first points; inf for documents without elements."""
    out = np.full((n, m), np.inf)
    weight = np.bincount(doc, weights=count, minlength=n)
    limit = m * (np.log(m) + 4) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight)
    while len(todo):
        active = np.zeros(n, bool)
        active[todo] = True
        mine = active[doc]
        d, e, c = doc[mine], fmix(element[mine] * GOLD + U64(1)), count[mine].astype(np.int64)
        flat = out.reshape(-1)
        level, width = 0, 1
        while len(d):
            low = 0 if level == 0 else width  # this level is (low, low + width]
            seed = fmix(e + U64(level) * U64(0xA0761D6478BD642F))
            time, part, owner, need, bound = np.zeros(len(d)), seed, d, c, limit[d]
            step = 0
            while len(owner):
                step += 1
                r = fmix(part + U64(step) * GOLD)
                time = time - np.log(((r >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52) / width
                on = time <= bound
                time, part, owner, need, bound, r = time[on], part[on], owner[on], need[on], bound[on], r[on]
                r = fmix(r ^ U64(0x2545F4914F6CDD1D))
                comp = ((r & U64(0xFFFFFFFF)) * U64(m) >> U64(32)).astype(np.int64)
                full = need >= low + width
                if full.all():
                    np.minimum.at(flat, owner * m + comp, time)
                else:
                    height = low + 1 + ((r >> U64(32)) * U64(width) >> U64(32)).astype(np.int64)
                    seen = height <= need
                    np.minimum.at(flat, owner[seen] * m + comp[seen], time[seen])
            level += 1
            width = 1 if level == 1 else 2 * width
            more = c > (1 if level == 1 else width)
            d, e, c = d[more], e[more], c[more]
        todo = todo[np.isinf(out[todo]).any(axis=1) | (out[todo].max(axis=1) > limit[todo])]
        out[todo] = np.inf
        limit[todo] *= 2
    return out


def bands_of(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    x = sig.view(U64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=U64) * U64(0xE7037ED1A0B428DB), x.shape[:2]).copy()
    for r in range(rows):
        h = fmix(h * GOLD + x[:, :, r])
    return h


def _node(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row is to the comparison: its id and a hash of its text; rows that agree in both are one.
    Ids that aren't null come first."""
    return F.struct(F.col(doc_id).isNull().alias("z"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0).cast("bigint")).alias("i"), F.xxhash64(text).alias("h"))


_NODE = "struct<z:boolean,i:bigint,h:bigint>"


def _sketch(docs: DataFrame, k: int, order: list[str]) -> DataFrame:
    """(n, o, FILE, ROW, e1, e2, w, bands) for rows that have words; o is a hash of the columns `order`,
    e1 and e2 are equal for equal multisets, and w is the multiset's size."""
    carried = ["n", "o", FILE, ROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, element, count = multisets(part.column("text"), k)
                n = part.num_rows
                e = []
                for salt in (0x1, 0x9FB21C651E98DF25):
                    s = np.zeros(n, dtype=U64)
                    np.add.at(s, doc, fmix((element ^ U64(salt)) * GOLD) * count.astype(U64))
                    e.append(s)
                have = np.flatnonzero(np.bincount(doc, minlength=n))
                b = bands_of(signatures(doc, element, count, n))[have]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(have)) for c in carried), pa.array(e[0][have].view(np.int64)), pa.array(e[1][have].view(np.int64)), pa.array(np.bincount(doc, weights=count, minlength=n)[have].astype(np.int64)), list_array(b.reshape(-1).view(np.int64), np.arange(len(have) + 1) * BANDS, pa.int64())],
                    [*carried, "e1", "e2", "w", "bands"],
                )

    own = docs.where(F.col("text").isNotNull()).select(_node().alias("n"), F.xxhash64(*order).alias("o"), FILE, ROW, "text")
    return own.mapInArrow(run, f"n {_NODE}, o bigint, {FILE} bigint, {ROW} bigint, e1 bigint, e2 bigint, w bigint, bands array<bigint>")


def overlap(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """The weighted Jaccard similarity of row i of both sides, as multisets() gives them."""
    shift = U64(44)
    ka, kb = (left[0].astype(U64) << shift) | left[1], (right[0].astype(U64) << shift) | right[1]
    both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    inter = np.bincount((both >> shift).astype(np.int64), weights=np.minimum(left[2][ia], right[2][ib]), minlength=n)
    total = np.bincount(left[0], weights=left[2], minlength=n) + np.bincount(right[0], weights=right[2], minlength=n)
    return inter / np.maximum(total - inter, 1)


def _verify(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, j): the exact similarity of each pair. The texts of candidates travel, no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tb"):
                for one in slices(part, "ta"):
                    j = overlap(multisets(one.column("ta"), k), multisets(one.column("tb"), k), one.num_rows)
                    yield pa.RecordBatch.from_arrays([one.column("a"), one.column("b"), pa.array(j)], ["a", "b", "j"])

    x = pairs.join(texts.select(F.col("x").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("x").alias("a"), F.col("text").alias("ta")), "a")
    return x.select("a", "b", "ta", "tb").mapInArrow(run, f"a {_PLACE}, b {_PLACE}, j double")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, c) for each end of `edges` (a, b): the least end it is connected with. Each round takes the
    least label among the neighbours and then the label of that label, so that the number of rounds
    grows with the logarithm of the longest path in most graphs; rounds end when no label changes."""
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("c")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["x"]).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, labels["x"] == near["a"]).select("x", "c", F.least("c", "m").alias("m"))
        jump = labels.select(F.col("x").alias("m"), F.col("c").alias("up"))
        new = scratch.table(step.join(jump, "m").select("x", F.least("m", "up").alias("c"), (F.least("m", "up") != F.col("c")).alias("moved")), "labels")
        labels = new.select("x", "c")
        if new.where("moved").limit(1).count() == 0:
            return labels


_PLACE = "struct<f:bigint,r:bigint>"


def _place() -> Column:
    return F.struct(F.col(FILE).alias("f"), F.col(ROW).alias("r"))


def _grouped(docs: DataFrame, threshold: float, k: int, order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For located() `docs`, the sketch and (n, g, rows): every node of a group of two rows or more, the
    group's least node, and the number of rows that are this node. Documents of one multiset are
    represented by one row, and a candidate is known by the place of that row."""
    sketch = scratch.table(_sketch(docs, k, order), "sketch")
    first_row = F.struct("n", FILE, ROW)
    reps = sketch.groupBy("e1", "e2").agg(F.min(first_row).alias("y"), F.min_by("bands", first_row).alias("bands"), F.min("w").alias("w"), F.count("*").alias("total"))
    reps = scratch.table(reps.select("e1", "e2", "y.n", F.struct(F.col(f"y.{FILE}").alias("f"), F.col(f"y.{ROW}").alias("r")).alias("x"), "w", "bands", "total"), "reps")
    # three numbers a band travel: the key, which has the band's number in it, and the place
    band = reps.select(F.explode("bands").alias("key"), "x")
    several = band.groupBy("key").agg(F.min("x").alias("low"), F.count("*").alias("size")).where("size > 1").select("key", "low")
    cell = scratch.table(band.join(several, "key"), "cells")
    wanted = write_places(cell.select(F.col("x.f").alias(FILE), F.col("x.r").alias(ROW)).distinct(), scratch.path("wanted"))
    texts = scratch.table(at_places(docs.select(_place().alias("x"), "text", FILE, ROW), wanted, ["x", "text"], keep=True), "texts")
    stars = cell.where("low != x").select(F.col("low").alias("a"), F.col("x").alias("b")).distinct()
    checked = scratch.table(_verify(stars, texts, k), "checked")
    first = components(checked.where(F.col("j") >= threshold), scratch)
    # members of a bucket that aren't connected yet
    placed = scratch.table(cell.join(first, "x", "left").select("key", "low", "x", F.coalesce("c", "x").alias("c")), "placed")
    split = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("key")
    away = checked.select(F.col("a").alias("low"), F.col("b").alias("x"), (1 - F.col("j")).alias("d"))
    mixed = placed.join(split, "key", "left_semi").where("low != x").join(away, ["low", "x"], "left").join(reps.select("x", "w"), "x")
    mixed = scratch.table(mixed.select("key", "low", "x", "c", "w", F.coalesce("d", F.lit(0.0)).alias("d")), "mixed")
    rest = (
        mixed.alias("p")
        .join(mixed.alias("q"), F.col("p.key") == F.col("q.key"))
        .where("p.x < q.x and p.c != q.c")
        .where((F.abs(F.col("p.d") - F.col("q.d")) <= 1 - threshold + 1e-9) & (F.least("p.w", "q.w") >= threshold * F.greatest("p.w", "q.w") - 1e-9))
        .select(F.col("p.x").alias("a"), F.col("q.x").alias("b"))
        .distinct()
    )
    more = _verify(rest, texts, k).where(F.col("j") >= threshold)
    near = components(first.where("x != c").select(F.col("c").alias("a"), F.col("x").alias("b")).union(more.select("a", "b")), scratch)
    named = near.join(reps.select("x", "n"), "x")
    least = named.groupBy("c").agg(F.min("n").alias("g"))
    grouped = reps.select("e1", "e2", "x", "n", "total").join(near.join(least, "c").select("x", "g"), "x", "left").where("total > 1 or g is not null")
    nodes = sketch.groupBy("e1", "e2", "n").agg(F.count("*").alias("rows"))
    return sketch, nodes.join(grouped.select("e1", "e2", F.coalesce("g", "n").alias("g")), ["e1", "e2"]).select("n", "g", "rows")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(doc_id, group_id, n_rows, kept) for every document in a group of near-duplicates: the chains of
    documents whose multisets of word bigrams have a weighted Jaccard similarity of `threshold` or more.
    group_id is the least doc_id of the group, whose document is the one kept.

    A text of one word is that word; texts that are null or have no words are in no group. Rows that
    agree in id and text are one document of n_rows rows, a group even if alone; rows of one id with
    other texts are documents of their own. Null ids take part and come last in order. Single
    documents aren't reported; an empty table gives no rows. Other columns are ignored, whatever their
    names. A text is never cut: one of n bytes takes about 100 n bytes of memory in its task.
    """
    scratch = Scratch(docs.sparkSession)
    found = _grouped(located(only(docs, "doc_id", "text")), threshold, k, ["doc_id"], scratch)[1]
    back = lambda n: F.when(~F.col(f"{n}.z"), F.col(f"{n}.i"))
    out = materialize(found.select(back("n").alias("doc_id"), back("g").alias("group_id"), F.col("rows").alias("n_rows"), (F.col("n") == F.col("g")).alias("kept")), "groups")
    scratch.clear()
    return out


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """The rows of `docs`, with all their columns, without those that near_duplicates() finds to be
    copies: of each group one row stays, of rows with one id and text the first by a hash of all columns
    and by place. Null and empty texts stay; names of columns may clash, hold dots or repeat (but
    doc_id and text); an empty table stays empty. The list of what goes lies in the shared folder until
    clear_leftovers()."""
    names, scratch = docs.columns, Scratch(docs.sparkSession)
    docs = numbered(docs, "doc_id", "text")
    columns, docs = docs.columns, located(docs)
    sketch, found = _grouped(docs, threshold, k, columns, scratch)
    copies = sketch.select("n", "o", FILE, ROW).join(found.where("n != g or rows > 1"), "n")
    copies = scratch.table(copies.select("n", "g", F.struct("o", FILE, ROW).alias("p")), "copies")
    first = copies.groupBy("n").agg(F.min("p").alias("first"))
    late = copies.join(first, "n").where("n != g or p != first").select("p.*")
    gone = write_places(late, Scratch(scratch.spark).later().path("gone"))
    scratch.clear()
    return at_places(docs, gone, columns, keep=False).toDF(*names)
