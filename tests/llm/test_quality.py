import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SMALL
from tests.llm import brute
from threadmill.llm import quality as Q
from threadmill.llm.common import word_hashes


def made(n, seed):
    """Texts whose grade falls by one for an insult and by one for shouting."""
    r = random.Random(seed)
    out, grades = [], []
    for _ in range(n):
        w = [r.choice("abcdefghij") + r.choice("aeiou") + r.choice("rst") for _ in range(r.randint(20, 120))]
        bad, loud = r.random() < 0.3, r.random() < 0.3
        if bad:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["idiot", "scum", "moron"]))
        out.append(" ".join(x.upper() + "!!" for x in w) if loud else " ".join(w))
        grades.append(2 - bad - loud)
    return out, np.array(grades)


def test_held_out_grades():
    texts, grades = made(900, 1)
    m = Q.fit(Q.Rows.of(texts), grades, 3)
    assert (np.diff(m.thresholds) > 0).all()
    texts, grades = made(300, 2)
    z = Q.latent(m, pa.array(texts))
    above = 1 / (1 + np.exp(-(z[:, None] - m.thresholds)))
    assert (np.rint(above.sum(axis=1)) == grades).mean() >= 0.95
    kept = above[:, -1] >= m.cut
    assert kept[grades == 2].mean() >= 0.95 and kept[grades < 2].mean() <= 0.05


def test_gradient_is_right():
    """The fit's weights do better than weights near them."""
    texts, grades = made(40, 3)
    rows = Q.Rows.of(texts)
    m = Q.fit(rows, grades, 3, rounds=2000, l2=1e-2)

    def loss(w, t):
        z = np.bincount(rows.doc, weights=w[rows.bucket] * rows.value, minlength=len(grades)) + rows.shape @ w[Q.BUCKETS :]
        e = np.concatenate(([-40.0], t, [40.0]))
        s = lambda x: 1 / (1 + np.exp(-x))
        return -np.log(s(e[grades + 1] - z) - s(e[grades] - z)).mean() + 0.5e-2 * (w**2).sum()

    r, base = np.random.default_rng(0), loss(m.weights, m.thresholds)
    used = np.unique(rows.bucket)
    for _ in range(20):
        d = np.zeros(len(m.weights))
        d[used] = r.standard_normal(len(used)) * 0.02
        assert loss(m.weights + d, m.thresholds + r.standard_normal(2) * 0.02) > base - 1e-4


def test_features_one_by_one():
    texts = ["b b a é", "", "LOUD!! 12 | x"]
    d, b, v, shape = Q.features(pa.array(texts))
    for i, t in enumerate(texts):
        counts = brute.multiset(t, 1).values()
        assert np.allclose(sorted(v[d == i]), sorted(np.log1p(list(counts)) / np.sqrt((np.log1p(list(counts)) ** 2).sum()))) and np.isfinite(shape).all()


def test_labels_table(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = Q.score(documents, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    good = (got.quality == 1) & (got.toxic == 0)
    assert got[good].selected.mean() >= 0.95 and got[good].expected_grade.mean() > got[~good].expected_grade.mean() + 0.5


def test_odd_rows(spark, documents, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 1, 0), (None, 1, 1), (7, None, 0), (8, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows, grades, _ = Q.training_rows(odd, labels)
    assert sorted(grades.tolist()) == [0, 1, 2] and len(rows.shape) == 3
    got = Q.score(odd, labels).collect()
    assert len(got) == odd.count() and all((r.expected_grade is None) == (not r.selected) for r in got if r.doc_id == 3)
    assert Q.score(empty, labels).count() == 0
    one = Q.score(odd, labels.limit(0)).collect()
    assert len(one) == odd.count() and all(r.selected and r.expected_grade is None for r in one)
    assert len(Q.training_rows(odd, labels, max_train=1)[1]) == 1 and len(Q.training_rows(odd, labels, max_bytes=3)[1]) == 1


def plain_latent(model, text):
    """One document's score, word by word and character by character."""
    data, words = text.encode(), brute.words(text)
    value = Counter()
    for w in words:
        h, _ = word_hashes(pa.array([w]))
        value[brute.fmix(int(h[0])) & (Q.BUCKETS - 1)] += 1
    size = math.sqrt(sum(math.log1p(c) ** 2 for c in value.values())) or 1.0
    out = sum(model.weights[b] * math.log1p(c) / size for b, c in value.items())
    n, m = max(1, len(data)), max(1, len(words))
    mark = lambda b: b > 32 and not (chr(b).isalnum() or b == 95 or b >= 128)
    upper, punct = sum(65 <= b <= 90 for b in data) / n, sum(map(mark, data)) / n
    twice = sum(mark(b) and a == b for a, b in zip(data, data[1:])) / n
    shape = [1, min(math.log1p(len(words)) / 8, 2), len(value) / m, max(value.values(), default=0) / m, upper**0.5, upper > 0.3, punct**0.5, punct > 0.15, (sum(48 <= b <= 57 for b in data) / n) ** 0.5, (data.count(10) / n) ** 0.5, (data.count(124) / n) ** 0.5, twice**0.5]
    return out + sum(model.weights[Q.BUCKETS + i] * float(x) for i, x in enumerate(shape))


def test_scores_are_those_of_a_plain_scorer(spark, documents):
    texts, grades = made(200, 5)
    model = Q.fit(Q.Rows.of(texts), grades, 3)
    sig = lambda z: 1 / (1 + math.exp(-z))
    got = {r.doc_id: r for r in Q.score(documents, model=model).collect()}
    for r in documents.collect():
        z = plain_latent(model, r.text)
        tails = [sig(z - t) for t in model.thresholds]
        assert abs(got[r.doc_id].expected_grade - sum(tails)) < 1e-6 and abs(got[r.doc_id].tail_probability - tails[-1]) < 1e-6
        assert got[r.doc_id].selected == (tails[-1] >= model.cut) or abs(tails[-1] - model.cut) < 1e-9


def test_the_cut_is_the_best_over_all_rows_not_fitted_on():
    r = random.Random(3)
    rows = [(round(r.random(), 3), r.random() < 0.5) for _ in range(400)]
    rows = [(min(1.0, t + 0.3 * g), g) for t, g in rows]
    values = sorted({t for t, _ in rows})
    n_good = sum(g for _, g in rows)
    f1 = {}
    for cut in values:
        hit = sum(g for t, g in rows if t >= cut)
        if hit >= 0.95 * n_good:
            f1[cut] = round(2 * hit / (sum(t >= cut for t, _ in rows) + n_good), 9)
    want = [c for c in f1 if f1[c] == max(f1.values())]
    got = Q.best_cut(np.array(values), np.array([sum(g for t, g in rows if t == v) for v in values], float), np.array([sum(not g for t, g in rows if t == v) for v in values], float))
    assert got == pytest.approx(sum(want) / len(want))
    assert Q.best_cut(np.zeros(0), np.zeros(0), np.zeros(0)) == 0.5


def test_the_cut_counts_every_labelled_row(spark):
    texts, grades = made(400, 6)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, g in enumerate(grades.tolist())], "doc_id bigint, quality int, toxic int")
    scored = spark.createDataFrame([(i, 0.9 if g == 2 else 0.2) for i, g in enumerate(grades.tolist())], "doc_id bigint, tail_probability double")
    assert 0.2 < Q.cut_over_all(scored, labels, [1, 2, 3]) <= 0.9
    got = Q.score(df, labels, max_train=100)
    assert got.count() == 800 and got.where("selected").count() > 0


def test_ties_and_names(spark, odd):
    texts, grades = made(120, 7)
    model = Q.fit(Q.Rows.of(texts), grades, 3)
    df = odd.withColumn("selected", odd["doc_id"]).withColumnRenamed("source", "meta.url").withColumn("TEXT2", odd["text"])
    got = Q.score(df, model=model).where("doc_id = 1").collect()
    assert len(got) == 2 and got[0] == got[1]
    with pytest.raises(ValueError):
        Q.score(odd.withColumn("doc_id", odd["text"]), model=model)
