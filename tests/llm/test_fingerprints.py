import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from threadmill.llm import fingerprints as L
from threadmill.llm.common import word_hashes


def one(text, level=2):
    n, levels, root, phrases, sizes, _ = L.parse(pa.array([text]), level)
    return int(n[0]), int(levels[0]), int(root[0]), phrases.tolist(), sizes.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd", "é"]), max_size=40).map(" ".join), min_size=1, max_size=6), st.integers(0, 3))
def test_same_as_one_by_one(texts, level):
    count, levels, root, phrases, sizes, off = L.parse(pa.array(texts), level)
    h, woff = word_hashes(pa.array(texts))
    for i in range(len(texts)):
        own = h[woff[i] : woff[i + 1]].tolist()
        assert count[i] == len(own)
        if own:
            d, r, p = brute.lcp(own, level)
            assert (levels[i], int(root[i]), phrases[off[i] : off[i + 1]].tolist()) == (d, r, p)
            assert sizes[off[i] : off[i + 1]].sum() == len(own)


def test_a_passage_has_the_same_phrases_wherever_it_stands():
    r = np.random.default_rng(3)
    w = lambda n: " ".join(f"w{x}" for x in r.integers(0, 500, n))
    passage = w(120)
    for level, least in ((1, 30), (2, 12)):
        alone = set(one(passage, level)[3])
        for before in (0, 1, 2, 7, 50, 333):
            shared = set(one(f"{w(before)} {passage} {w(40)}", level)[3]) & alone
            assert len(shared) >= least
    assert not set(one(w(300))[3]) & set(one(w(300))[3])


def test_equal_words_equal_root():
    assert one("The  quick, brown\nfox")[2] == one("the quick brown FOX!")[2] != one("the quick fox brown")[2]
    assert one("a a a a a a")[2] != one("a a a a a")[2]


def test_table(spark, documents, odd, empty):
    got = L.lcp_fingerprints(documents).toPandas()
    assert len(got) == documents.count()
    rows = {r.doc_id: r.text for r in documents.collect()}
    for r in got.sample(20, random_state=1).itertuples():
        assert r.n_words == len(brute.words(rows[r.doc_id])) == sum(r.phrase_words)
    pdf = L.lcp_fingerprints(odd).toPandas()
    assert len(pdf) == 11 and pdf[pdf.doc_id == 1].root.nunique() == 1
    assert pdf[pdf.doc_id == 3].iloc[0].n_words == 0 and np.isnan(pdf[pdf.doc_id == 3].iloc[0].root)
    assert pdf[pdf.doc_id == 6].iloc[0].n_levels == 0 and pdf[pdf.doc_id == 4].iloc[0].n_words == 60_000
    assert L.lcp_fingerprints(empty).count() == 0


def test_shared_phrases(spark):
    text = " ".join(f"w{i * i % 97}" for i in range(200))
    df = spark.createDataFrame([(1, text), (2, "x y z " + text), (3, "nothing in common")], "doc_id bigint, text string")
    shared = L.shared_phrases(L.lcp_fingerprints(df)).collect()
    assert len(shared) > 20 and all(r.n_docs == 2 and r.first_doc_id == 1 for r in shared)


def passages(df):
    """(ids, n_docs, first_doc_id, start_word, n_words) of each passage."""
    found = {}
    for x in df.collect():
        found.setdefault((x.n_docs, x.first_doc_id, x.start_word, x.n_words), []).append(x.doc_id)
    assert all(len(ids) == k[0] == len(set(ids)) for k, ids in found.items())
    return [(sorted(ids), *k) for k, ids in found.items()]


def test_shared_passages_are_reported_by_a_query(spark, tmp_path, odd, empty):
    from threadmill.llm.queries import QUERIES

    r = np.random.default_rng(11)
    w = lambda n: " ".join(f"w{x}" for x in r.integers(0, 3000, n))
    rows, planted = [], []
    for g in range(60):
        passage, ids = w(int(r.integers(51, 120))), [g * 10 + j for j in range(int(r.integers(2, 5)))]
        planted.append((ids, len(passage.split())))
        rows += [(i, f"{w(int(r.integers(0, 80)))} {passage} {w(int(r.integers(0, 60)))}") for i in ids]
    rows += [(10_000 + i, w(200)) for i in range(20)] + [(None, rows[0][1]), (20_000, w(90)), (20_001, None)] + [(20_000, "x " * 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = passages(QUERIES["shared_passages"](spark, str(tmp_path)))
    text = {i: t.split() for i, t in rows if i is not None and t}
    for ids, n in planted:
        mine = [x for x in got if set(x[0]) <= set(ids)]
        assert any(x[0] == ids and x[1] == len(ids) for x in mine) and all(x[4] <= n for x in mine)
    for ids, _, first, start, n in got:
        piece = " " + " ".join(text[first][start : start + n]) + " "
        assert n >= 12 and first == ids[0] and all(piece in " " + " ".join(text[i]) + " " for i in ids)
    assert {i for ids, *_ in got for i in ids} == {i for ids, _ in planted for i in ids}
    assert L.shared_passages(empty).count() == 0 and L.shared_passages(odd).count() == 0


def test_parts_with_more_documents_are_rows_of_their_own(spark):
    r = np.random.default_rng(12)
    w = lambda n: " ".join(f"w{x}" for x in r.integers(0, 3000, n))
    a, b, c = w(100), w(100), w(100)
    df = spark.createDataFrame([(1, f"{a} {b} {c}"), (2, f"{w(9)} {a} {b} {c}"), (3, f"{w(30)} {b} {w(5)}")], "doc_id bigint, text string")
    got = [(x[3], x[4], x[0]) for x in sorted(passages(L.shared_passages(df)), key=lambda x: x[3])]
    assert [d for _, _, d in got] == [[1, 2], [1, 2, 3], [1, 2]]
    assert got[0][0] < 40 and got[2][0] + got[2][1] > 270
