"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= g) = sigmoid(t_g - w.x) with one weight vector w for all grades and ordered thresholds
t_0 < t_1 < ...; x are hashed features of the whole text. Fitted by L-BFGS on a bounded sample of
labelled rows, drawn by a hash of the id (MAX_TRAIN rows, MAX_TRAIN_BYTES of text); everything else
covers every row. The cut for selection is chosen on all labelled rows that weren't fitted on.

Grades from the labels table: 2 for good and not toxic, 1 for one fault, 0 for both faults.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTE, U64, Scratch, buffer_of, fmix, materialize, only, owners, slices, word_hashes

BUCKETS = 1 << 16
MAX_TRAIN = 20_000
MAX_TRAIN_BYTES = 256 << 20
HOLD = 5  # every fifth row of the sample isn't fitted on
ROUNDS = 60
N_SHAPE = 12
SCHEMA = "doc_id bigint, expected_grade double, tail_probability double, selected boolean"


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS + N_SHAPE
    thresholds: np.ndarray  # ascending, one fewer than grades
    cut: float  # least P(top grade) for selection


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) triples sorted by document, and a dense block of shape features.
    Word values are log(1 + count), scaled to unit length by document."""
    data, off = buffer_of(texts)
    words, woff = word_hashes(texts)
    n = len(off) - 1
    size, n_words = np.diff(off).astype(np.float64), np.diff(woff).astype(np.float64)
    doc = owners(woff)
    cell, count = np.unique((doc.astype(U64) << U64(20)) | (fmix(words) & U64(BUCKETS - 1)), return_counts=True)
    d, b = (cell >> U64(20)).astype(np.int64), (cell & U64(BUCKETS - 1)).astype(np.int64)
    v = np.log1p(count)
    norm = np.sqrt(np.bincount(d, weights=v * v, minlength=n))
    v = v / norm[d] if len(d) else v

    def per_byte(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[off[1:]] - c[off[:-1]]) / np.maximum(size, 1)

    distinct = np.bincount(d, minlength=n)
    share = distinct / np.maximum(n_words, 1)
    top = np.zeros(n)
    np.maximum.at(top, d, count)
    upper, punct = per_byte((data >= 65) & (data <= 90)), per_byte(~WORD_BYTE[data] & (data > 32))
    digit, lines, pipes = per_byte((data >= 48) & (data <= 57)), per_byte(data == 10), per_byte(data == 124)
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & ~WORD_BYTE[data[1:]] & (data[1:] > 32)
    shape = np.stack([
        np.ones(n), np.minimum(np.log1p(n_words) / 8, 2), share, top / np.maximum(n_words, 1), np.sqrt(upper), upper > 0.3, np.sqrt(punct), punct > 0.15,
        np.sqrt(digit), np.sqrt(lines), np.sqrt(pipes), np.sqrt(per_byte(twice)),
    ], axis=1).astype(np.float64)
    return d, b, v, shape


def latent(model: Model, texts: pa.Array) -> np.ndarray:
    d, b, v, shape = features(texts)
    return np.bincount(d, weights=model.weights[b] * v, minlength=len(shape)) + shape @ model.weights[BUCKETS:]


@dataclass
class Rows:
    """Featurised documents: entries sorted by document, held small, as the driver fits on them."""

    doc: np.ndarray  # int32
    bucket: np.ndarray  # int32
    value: np.ndarray  # float32
    shape: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Rows:
        parts = [features(p.column(0)) for p in slices(pa.record_batch([pa.array(texts, pa.large_string())], ["t"]), "t")]
        sizes = np.cumsum([0] + [len(p[3]) for p in parts])
        return cls(
            np.concatenate([p[0] + at for p, at in zip(parts, sizes[:-1], strict=True)]).astype(np.int32), np.concatenate([p[1] for p in parts]).astype(np.int32),
            np.concatenate([p[2] for p in parts]).astype(np.float32), np.concatenate([p[3] for p in parts]),
        )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def minimize(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS (Liu and Nocedal 1989) with step halving; loss gives value and gradient."""
    value, grad = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, back = -grad, []
        for s, y, rho in reversed(pairs):
            back.append(rho * (s @ d))
            d = d - back[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, rho), alpha in zip(pairs, reversed(back), strict=True):
            d = d + (alpha - rho * (y @ d)) * s
        slope = grad @ d
        if slope > -1e-12:
            break
        step = 1.0 if pairs else min(1.0, 1 / np.sqrt(grad @ grad))
        for _ in range(30):
            new, new_grad = loss(x + step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1 / (s @ y))]
        x, value, grad = x + s, new, new_grad
    return x


def held_out(n: int) -> np.ndarray:
    """Rows of a sample of n, in order, that aren't fitted on; none of a small one."""
    return np.arange(n) % HOLD == HOLD - 1 if n >= 50 else np.zeros(n, bool)


def best_cut(tail: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The bound on the tail probability that has the best F1 for the top grade against the rest, among
    those that keep at least 95 % of the top grade; the middle of the values that reach it, and 0.5
    where no row has the top grade. `good` and `bad` count the rows at each value of `tail`."""
    order = np.argsort(-tail)
    tail, hit, all_of = tail[order], np.cumsum(good[order]), np.cumsum(good[order] + bad[order])
    total = good.sum()
    ok = hit >= 0.95 * total
    if not total or not len(tail):
        return 0.5
    f1 = np.where(ok, np.round(2 * hit / (all_of + total), 9), -1.0)
    return float(np.mean(tail[f1 == f1.max()]))


def fit(rows: Rows, grades: np.ndarray, n_grades: int, rounds: int = ROUNDS, l2: float = 1e-5) -> Model | None:
    """Least negative log likelihood; None where there are fewer than two grades. The rows of held_out()
    aren't fitted on and give the cut."""
    g = np.asarray(grades, dtype=np.int64)
    if len(set(g.tolist())) < 2:
        return None
    held = held_out(len(g))
    train = ~held
    n, size = train.sum(), BUCKETS + N_SHAPE

    def latents(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows.doc, weights=w[rows.bucket] * rows.value, minlength=len(g)) + rows.shape @ w[BUCKETS:]

    def thresholds(raw: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((raw[:1], np.exp(np.clip(raw[1:], -30, 30)))))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, raw = x[:size], x[size:]
        t, z = thresholds(raw), latents(w)
        edge = np.concatenate(([-40.0], t, [40.0]))
        hi, lo = _sigmoid(edge[g + 1] - z), _sigmoid(edge[g] - z)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dz = np.where(train, dhi - dlo, 0) / n  # rows held out pull nothing
        gw = np.concatenate([np.bincount(rows.bucket, weights=rows.value * dz[rows.doc], minlength=BUCKETS), rows.shape.T @ dz]) + l2 * w
        gt = np.array([(dlo * (g == j + 1) * train).sum() - (dhi * (g == j) * train).sum() for j in range(n_grades - 1)]) / n
        grad = np.concatenate([gw, [gt.sum()], np.array([gt[j:].sum() for j in range(1, n_grades - 1)]) * np.exp(np.clip(raw[1:], -30, 30))])
        return float(-np.log(p[train]).sum() / n + 0.5 * l2 * (w @ w)), grad

    raw = np.linspace(-1, 1, n_grades - 1)
    raw[1:] = np.log(np.diff(raw)) if n_grades > 2 else raw[1:]
    x = minimize(loss, np.concatenate((np.zeros(size), raw)), rounds)
    model = Model(x[:size], thresholds(x[size:]), 0.5)
    check = held if held.any() else train
    tail, good = np.round(_sigmoid(latents(model.weights) - model.thresholds[-1])[check], 3), (g == n_grades - 1)[check]
    values, at = np.unique(tail, return_inverse=True)
    model.cut = best_cut(values, np.bincount(at, weights=good), np.bincount(at, weights=~good))
    return model


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): one grade for each id, the worst of several labels."""
    lab = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null")
    return lab.groupBy("doc_id").agg((F.least(F.min("quality"), F.lit(1)) + F.lit(1) - F.greatest(F.max("toxic"), F.lit(0))).cast("int").alias("grade"))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> tuple[Rows, np.ndarray, list[int]]:
    """Features, grades and ids of at most max_train labelled texts with at most max_bytes in all (but
    one text at least), those whose ids have the least hash, in order of that hash; one text for each id
    (the first in order of several). Texts are featurised where they are; the driver gets hashed
    numbers."""
    lab = grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = only(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    scratch = Scratch(docs.sparkSession)
    # the sample is bounded by max_train rows of two numbers each: small enough to broadcast
    own = texts.join(F.broadcast(lab), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade"))
    own = scratch.table(own.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "grade"), "sample")
    sizes = own.select("h", "doc_id", F.octet_length("text").alias("n")).orderBy("h", "doc_id").collect()  # at most max_train rows of three numbers
    total = np.cumsum([r["n"] for r in sizes])
    sizes = sizes[: max(1, int((total <= max_bytes).sum()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                d, b, v, shape = features(part.column("text"))
                off = pa.array(np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("h"), part.column("doc_id").cast(pa.int64()), part.column("grade"), pa.ListArray.from_arrays(off, pa.array(b, pa.int32())), pa.ListArray.from_arrays(off, pa.array(v, pa.float32())),
                        pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * N_SHAPE, pa.int32()), pa.array(shape.reshape(-1))),
                    ],
                    ["h", "doc_id", "grade", "bucket", "value", "shape"],
                )

    if not sizes:
        scratch.clear()
        return Rows.of([""]), np.zeros(0, np.int64), []
    schema = "h bigint, doc_id bigint, grade int, bucket array<int>, value array<float>, shape array<double>"
    last = sizes[-1]
    t = own.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("doc_id") <= last["doc_id"]))).select("h", "doc_id", "grade", "text").mapInArrow(run, schema).toArrow()
    t = t.take(pa.compute.sort_indices(t, [("h", "ascending"), ("doc_id", "ascending")])).combine_chunks()
    scratch.clear()
    column = lambda name: t.column(name).chunk(0)
    n = np.diff(np.asarray(column("bucket").offsets))
    rows = Rows(np.repeat(np.arange(t.num_rows, dtype=np.int32), n), np.asarray(column("bucket").flatten()), np.asarray(column("value").flatten()), np.asarray(column("shape").flatten()).reshape(-1, N_SHAPE))
    return rows, np.asarray(column("grade"), dtype=np.int64), column("doc_id").to_pylist()


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[Model | None, list[int]]:
    """The model, with the cut of its own held-out rows, and the ids that it was fitted on."""
    rows, grades, ids = training_rows(docs, labels, max_train)
    return fit(rows, grades, 3), [i for i, out in zip(ids, held_out(len(ids)), strict=True) if not out] if held_out(len(ids)).any() else []


def cut_over_all(scored: DataFrame, labels: DataFrame, fitted: list[int]) -> float:
    """best_cut() over every labelled row of `scored` (doc_id, tail_probability) but the fitted ones,
    from a histogram of a thousandth; rows of one id are counted before the join."""
    spark = scored.sparkSession
    counted = scored.where("tail_probability is not null").groupBy("doc_id", F.round("tail_probability", 3).alias("tail")).agg(F.count("*").alias("n"))
    lab = grades_of(labels)
    if fitted:
        lab = lab.join(F.broadcast(spark.createDataFrame([(i,) for i in fitted], "doc_id bigint")), "doc_id", "left_anti")  # at most MAX_TRAIN ids
    top = F.col("grade") == 2
    found = counted.join(lab, "doc_id").groupBy("tail").agg(F.sum(F.when(top, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(top, 0).otherwise(F.col("n"))).alias("bad")).collect()  # at most 1001 rows
    return best_cut(*(np.array([float(r[c]) for r in found]) for c in ("tail", "good", "bad")))


def score(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): the expected grade, the probability of the top
    grade and whether that reaches the model's cut.

    A null text scores null and isn't selected; an empty text is scored like any other. Without a
    model, and with labels of fewer than two grades, scores are null and all rows are selected. A null
    doc_id stays; repeated rows give repeated rows, equal texts equal scores, and a score just at the
    cut is selected; an empty table gives no rows. Other columns are ignored, whatever their names. A
    text is never cut: one of n bytes takes about 100 n bytes of memory in its task.
    """
    docs = only(docs, "doc_id", "text")
    fitted: list[int] | None = None
    if model is None and labels is not None:
        model, fitted = train(docs, labels, max_train)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                if m is None:
                    grade = tail = pa.nulls(len(text), pa.float64())
                else:
                    null = np.asarray(text.is_null())
                    above = _sigmoid(latent(m, text)[:, None] - m.thresholds)
                    grade, tail = pa.array(above.sum(axis=1), mask=null), pa.array(above[:, -1], mask=null)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), grade, tail], ["doc_id", "expected_grade", "tail_probability"])

    out = docs.mapInArrow(run, SCHEMA.rsplit(", ", 1)[0])
    if model is None:
        return out.withColumn("selected", F.lit(True))
    if fitted is not None:
        out = materialize(out, "scores")
        model.cut = cut_over_all(out, labels, fitted)
    return out.withColumn("selected", F.coalesce(F.col("tail_probability") >= model.cut, F.lit(False)))
