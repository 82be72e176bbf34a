"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +-1. The vector of a trigram binds its letters: the product of
the first letter's vector permuted (rotated) twice, the second's rotated once, and the third's. A
text is the bundle (sum) of its trigram vectors, a language the bundle of all its texts, and a text
has the language whose prototype is nearest by cosine. Sums run over distinct trigrams times their
counts, which is the same bundle.

Prototypes count every trigram of every labelled text: one pass that sends only counts by language
and trigram to the shuffle, and bundles them on the executors; the driver gets one vector a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, U64, fmix, numbered, only, slices

DIM = 1024
N_GRAM_BITS = 21
MIN_COSINE = 0.15
FULL_LETTERS = 128  # a shorter text's cosine is smaller, in proportion to the root of its length
KEY_BLOCK = 16384
MAX_LANGUAGES = 4096
SCHEMA = "doc_id bigint, lang string, cosine double, margin double, n_letters bigint, accepted boolean"
_vectors: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """The +-1 vector of a code point, made from its number alone."""
    if code not in _vectors:
        bits = fmix(np.arange(DIM // 64, dtype=U64) * GOLD + U64(code * 0x51_7CC1_B727 + 0xABCDEF))
        _vectors[code] = np.unpackbits(bits.view(np.uint8)).astype(np.int8) * 2 - 1
    return _vectors[code]


def trigram_vectors(keys: np.ndarray) -> np.ndarray:
    out = np.empty((len(keys), DIM), dtype=np.float32)
    mask = (1 << N_GRAM_BITS) - 1
    for i, key in enumerate(keys.tolist()):
        a, b, c = key >> 2 * N_GRAM_BITS, key >> N_GRAM_BITS & mask, key & mask
        out[i] = np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)
    return out


_code_letter = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _code_letter
    if not len(_code_letter):
        _code_letter = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
    return _code_letter


def trigram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigram keys of the slice, a table of counts as (document, key position, count) sorted
    by document, and the number of letters of each document. Runs of other characters are one space;
    each text has one before and one after."""
    lower = pc.fill_null(pc.utf8_lower(texts), "").to_pylist()
    code = np.frombuffer((" \n" + " \n".join(lower) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.array([len(t) for t in lower], dtype=np.int64) + 2
    doc = np.repeat(np.arange(len(lower)), lengths)
    code = np.append(code[1:], np.uint32(32))[: len(doc)]  # each document: newline, its text, space
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = np.cumsum(lengths) - lengths
    keep[starts] = True
    code, doc, letter = np.where(letter, code, 32)[keep], doc[keep], letter[keep]
    n_letters = np.bincount(doc[letter], minlength=len(lower))
    met = np.zeros(int(code.max(initial=0)) + 1, bool)
    met[code] = True
    alphabet = np.flatnonzero(met)
    k = len(alphabet)
    sym = (np.cumsum(met) - 1)[code]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64), n_letters
    tri = (sym[:-2] * k + sym[1:-1]) * k + sym[2:]
    ok = (doc[:-2] == doc[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    tri, d = tri[ok], doc[:-2][ok]
    if k**3 <= 1 << 24:
        seen = np.flatnonzero(np.bincount(tri, minlength=1))
        place = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, dtype=np.int64)
        place[seen] = np.arange(len(seen))
        tri = place[tri] if len(tri) else tri
    else:
        seen, tri = np.unique(tri, return_inverse=True)
    if not len(seen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64), n_letters
    a = alphabet.astype(np.int64)
    keys = a[seen // k // k] << 2 * N_GRAM_BITS | a[seen // k % k] << N_GRAM_BITS | a[seen % k]
    cells, counts = np.unique(d * len(seen) + tri, return_counts=True)
    return keys, cells // len(seen), np.stack([cells % len(seen), counts]), n_letters


def train_profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """A unit prototype for each value of `lang` that has letters, from all rows where it isn't null.
    More than MAX_LANGUAGES values are an error: such a column doesn't name languages."""
    docs = only(docs, "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], int] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["lang", "trigram", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                keys, doc, (at, n), _ = trigram_counts(part.column("text"))
                langs = part.column("lang").dictionary_encode()
                which = np.asarray(langs.indices)[doc] if len(doc) else np.zeros(0, np.int64)
                names = langs.dictionary.to_pylist()
                for li, name in enumerate(names):
                    mine = which == li
                    sums = np.bincount(at[mine], weights=n[mine], minlength=len(keys))
                    for i in np.flatnonzero(sums).tolist():
                        cell = (name, int(keys[i]))
                        total[cell] = total.get(cell, 0) + int(sums[i])
                if len(total) > 500_000:
                    yield told()
        if total:
            yield told()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}  # whole numbers, so the order of rows doesn't matter
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                mine = np.flatnonzero(langs == lang)
                keys, n = np.asarray(batch.column("trigram"))[mine], np.asarray(batch.column("n"))[mine].astype(np.float64)
                v = sums.setdefault(lang, np.zeros(DIM))
                for i in range(0, len(keys), 4096):
                    v += n[i : i + 4096] @ trigram_vectors(keys[i : i + 4096]).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    counts = docs.mapInArrow(count, "lang string, trigram bigint, n bigint").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    # each task bundles the trigrams it has of each language; the partial bundles are added by language and dimension
    partial = counts.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    summed = partial.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    found = summed.limit(MAX_LANGUAGES + 1).collect()  # DIM numbers for each language
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    profiles = {}
    for r in found:
        v = np.array(r["v"])
        if np.linalg.norm(v) > 0:
            profiles[r["lang"]] = v / np.linalg.norm(v)
    return profiles


class Scorer:
    """Cosines of texts with the prototypes; keeps the vectors of the trigrams it has met, and starts
    afresh when there are too many of them."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int = 60_000) -> None:
        self.names = sorted(profiles)
        self.p = np.stack([profiles[n] for n in self.names]).T.astype(np.float32) if profiles else np.zeros((DIM, 0), np.float32)
        self.most, self.place, self.table, self.n = most, {}, np.empty((1024, DIM), dtype=np.int8), 0

    def rows(self, keys: np.ndarray) -> np.ndarray:
        new = [k for k in keys.tolist() if k not in self.place]
        if self.n + len(new) > self.most:
            self.place, self.n, new = {}, 0, keys.tolist()
        while self.n + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        if new:
            self.table[self.n : self.n + len(new)] = trigram_vectors(np.array(new)).astype(np.int8)
            self.place.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        return np.array([self.place[k] for k in keys.tolist()], dtype=np.int64)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages) cosines, 0 for a text without letters, and the numbers of letters."""
        keys, doc, (at, n), letters = trigram_counts(texts)
        out = np.zeros((len(letters), len(self.names)))
        if not len(keys):
            return out, letters
        # blocks of trigrams and of documents: memory doesn't depend on how many trigrams a slice has
        bundle = np.zeros((len(letters), DIM), dtype=np.float32)
        if len(keys) > KEY_BLOCK:
            order = np.argsort(at, kind="stable")
            doc, at, n = doc[order], at[order], n[order]
        docs = max(1, (8 << 20) // min(len(keys), KEY_BLOCK))
        for k in range(0, len(keys), KEY_BLOCK):
            own = keys[k : k + KEY_BLOCK]
            at_row = self.rows(own)
            vectors = self.table[at_row].astype(np.float32)
            lo, hi = np.searchsorted(at, (k, k + KEY_BLOCK)) if len(keys) > KEY_BLOCK else (0, len(at))
            d, c, x = doc[lo:hi], at[lo:hi] - k, n[lo:hi]
            for a in range(0, len(letters), docs):
                mine = (d >= a) & (d < a + docs)
                if mine.any():
                    dense = np.zeros((min(docs, len(letters) - a), len(own)), dtype=np.float32)
                    dense[d[mine] - a, c[mine]] = x[mine]
                    bundle[a : a + docs] += dense @ vectors
        norm = np.sqrt(np.einsum("ij,ij->i", bundle, bundle))
        out[:] = (bundle @ self.p) / np.maximum(norm, 1e-9)[:, None]
        return out, letters


def bounds(letters: np.ndarray, min_cosine: float) -> np.ndarray:
    """The least cosine at which texts of so many letters are accepted."""
    return min_cosine * np.sqrt(np.minimum(1.0, letters / FULL_LETTERS))


def _judged(docs: DataFrame, min_cosine: float, profiles: dict[str, np.ndarray] | None, keep: bool) -> DataFrame:
    profiles = train_profiles(docs) if profiles is None else profiles
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x DIM numbers, whatever the corpus
    names_of, docs = docs.columns, numbered(docs, "text") if keep else only(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = pa.array(scorer.names or [""])
        for batch in batches:
            for part in slices(batch, "text"):
                cos, letters = scorer.score(part.column("text"))
                if not scorer.names:
                    best, second, which = np.full(len(letters), np.nan), np.full(len(letters), np.nan), np.zeros(len(letters), np.int64)
                    sure = np.ones(len(letters), bool)
                else:
                    which = cos.argmax(axis=1)
                    ranked = np.sort(cos, axis=1)
                    best, second = ranked[:, -1], ranked[:, -2] if cos.shape[1] > 1 else np.zeros(len(letters))
                    sure = (letters > 0) & (best >= bounds(letters, min_cosine))
                if keep:
                    yield part.filter(pa.array(sure))
                    continue
                known = (letters > 0) & ~np.isnan(best)
                lang = pc.if_else(pa.array(known), names.take(pa.array(which)), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), lang, pa.array(best, mask=~known), pa.array(best - second, mask=~known), pa.array(letters, pa.int64()), pa.array(sure)],
                    ["doc_id", "lang", "cosine", "margin", "n_letters", "accepted"],
                )

    if keep:
        return docs.mapInArrow(run, docs.schema).toDF(*names_of)
    return docs.mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, min_cosine: float = MIN_COSINE, profiles: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; lang for training unless profiles are given).

    cosine is that of the nearest prototype, margin its lead over the next one (over 0 where there is
    one language). A text is accepted from min_cosine on; with under FULL_LETTERS letters the bound is
    lower by the root of their share, as a clean text's cosine is. Texts that are null or without
    letters have null lang, cosine and margin and are not accepted. Where no row is labelled there is nothing to compare with: lang is null and all rows
    are accepted. Equal cosines: the language first in the alphabet. A null doc_id stays; repeated
    rows give repeated rows; an empty table gives no rows. Other columns are ignored, whatever their
    names. A text is never cut: one of n bytes takes about 100 n bytes of memory in its task.
    """
    return _judged(docs, min_cosine, profiles, keep=False)


def keep_identified(docs: DataFrame, min_cosine: float = MIN_COSINE, profiles: dict[str, np.ndarray] | None = None) -> DataFrame:
    """The rows of `docs` that identify() accepts, with all their columns: null and empty texts and those
    without letters go, repeated rows go or stay together, all stay where nothing is labelled, and an
    empty table stays empty. Names of columns may clash, hold dots or repeat (but text and lang)."""
    return _judged(docs, min_cosine, profiles, keep=True)
