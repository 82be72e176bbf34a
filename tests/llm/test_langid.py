import random

import numpy as np
import pyarrow as pa

from tests.llm import brute
from threadmill.llm import langid as L


def bundle(text):
    """The sum of bound trigram vectors, letter by letter."""
    out, prev = np.zeros(L.DIM), " "
    chars = [" "]
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or prev != " ":
            chars.append(c)
        prev = c
    chars += [" "] if chars[-1] != " " else []
    for a, b, c in zip(chars, chars[1:], chars[2:]):
        out += np.roll(L.letter_vector(ord(a)), 2).astype(float) * np.roll(L.letter_vector(ord(b)), 1) * L.letter_vector(ord(c))
    return out


def test_scores_are_those_of_the_bundles():
    texts = ["Hello, world!  it's", "été à la plage", "x", "a b", "The  the the 12 the"]
    profiles = {"en": bundle("the cat sat on the mat"), "fr": bundle("le chat sur la table est là")}
    unit = {k: v / np.linalg.norm(v) for k, v in profiles.items()}
    cos, letters = L.Scorer(unit).score(pa.array(texts))
    for i, t in enumerate(texts):
        for j, k in enumerate(sorted(unit)):
            assert abs(cos[i, j] - brute.cosine(bundle(t), unit[k])) < 1e-4
        assert letters[i] == sum(c.isalpha() for c in t)


def test_a_small_vector_table_gives_the_same():
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefghij klmnop") for _ in range(300)) for _ in range(30)]
    unit = {"en": np.ones(L.DIM) / L.DIM**0.5}
    few = L.Scorer(unit, most=500)
    for t in texts:
        assert np.allclose(few.score(pa.array([t]))[0], L.Scorer(unit).score(pa.array([t]))[0])


def test_many_trigrams_are_scored_in_blocks(monkeypatch):
    r = random.Random(2)
    texts = ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(400)) for _ in range(5)] + ["the cat", ""]
    unit = {"a": bundle(texts[0]) / np.linalg.norm(bundle(texts[0])), "b": np.ones(L.DIM) / L.DIM**0.5}
    whole = L.Scorer(unit).score(pa.array(texts))[0]
    monkeypatch.setattr(L, "KEY_BLOCK", 7)
    assert np.allclose(L.Scorer(unit).score(pa.array(texts))[0], whole, atol=1e-5) and abs(whole[0, 0] - 1) < 1e-5


def test_prototypes_are_the_bundles_of_all_texts(spark):
    rows = [("hello there", "en"), ("the end", "en"), ("été", "fr"), (None, "fr"), ("123", "xx"), ("x", None)]
    got = L.train_profiles(spark.createDataFrame(rows, "text string, lang string"))
    want = bundle("hello there") + bundle("the end")
    assert set(got) == {"en", "fr"} and np.allclose(got["en"], want / np.linalg.norm(want))


def test_held_out_accuracy(spark, documents):
    train, test = documents.where("doc_id % 3 != 0"), documents.where("doc_id % 3 = 0 and n_chars >= 100")
    got = L.identify(test, profiles=L.train_profiles(train)).toPandas().merge(test.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.lang_x == got.lang_y).mean() >= 0.97 and got.accepted.mean() >= 0.99


def test_junk_is_rejected(spark, documents):
    profiles = L.train_profiles(documents)
    r = random.Random(4)
    junk = ["".join(r.choice("qxzwkjvQ ЖЩЫЭЯ") for _ in range(400)), "0101 1110 ++ --", "漢字仮名交文" * 50]
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(junk)], documents.schema)
    assert not any(r.accepted for r in L.identify(df, profiles=profiles).collect())


def test_odd_rows(spark, odd, empty):
    got = L.identify(odd)
    assert got.count() == odd.count()
    by = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert by[3].lang is None and not by[3].accepted and not by[2].accepted and not by[5].accepted and by[4].accepted and by[4].lang == "en"
    kept = L.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == got.where("accepted").count()
    assert L.identify(empty).count() == 0 and L.keep_identified(empty).count() == 0
    free = odd.withColumn("lang", odd["lang"].substr(1, 0)).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang, r.accepted) for r in L.identify(free).collect()} == {(None, True)}


def test_short_clean_texts_are_kept_and_unlike_ones_rejected(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = L.train_profiles(df)
    known = L.identify(df, profiles=profiles)
    assert {r.doc_id for r in known.where("n_letters > 0 and not accepted").collect()} == set()
    assert {564, 909, 974} <= {r.doc_id for r in L.keep_identified(df, profiles=profiles).collect()}
    r = random.Random(8)
    junk = ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n)) for n in [100] * 200 + [1000] * 50]
    got = L.identify(spark.createDataFrame([(i, t, None) for i, t in enumerate(junk)], "doc_id bigint, text string, lang string"), profiles=profiles).toPandas()
    assert got.accepted.mean() <= 0.05
