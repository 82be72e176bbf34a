import random

import numpy as np
import pyarrow as pa
import pytest
from pyarrow.fs import FileSelector
from pyspark.sql import functions as F

from tests.llm import brute
from threadmill.llm import near_dedup as N
from threadmill.llm.common import Scratch, file_system, shared_dir


def test_signatures_estimate_weighted_jaccard():
    r = random.Random(5)
    base = [r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(300)]
    for keep in (0.9, 0.7, 0.4):
        other = [w if r.random() < keep else "z" + str(r.randint(0, 99)) for w in base]
        texts = [" ".join(base), " ".join(other)]
        d, e, c = N.multisets(pa.array(texts), 1)
        s = N.signatures(d, e, c, 2, 2000)
        want = brute.weighted_jaccard(brute.multiset(texts[0], 1), brute.multiset(texts[1], 1))
        assert abs((s[0] == s[1]).mean() - want) < 0.04
        assert N.overlap(tuple(x[d == 0] if x is not d else d[d == 0] for x in (d, e, c)), tuple(x[d == 1] if x is not d else d[d == 1] - 1 for x in (d, e, c)), 1)[0] == pytest.approx(want)


def test_signature_of_a_document_does_not_depend_on_its_slice():
    texts = ["a b a b a b c", "the quick brown fox", "x"]
    all_of = N.signatures(*N.multisets(pa.array(texts)), 3)
    for i, t in enumerate(texts):
        assert np.array_equal(N.signatures(*N.multisets(pa.array([t])), 1)[0], all_of[i])


def copies(seed=2):
    """Groups of exact and near copies, a chain, a hot group of 60, and documents of their own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    edit = lambda w, p: [word() if r.random() < p else x for x in w]
    out = []
    for size, n in ((60, 200), (3, 40), (5, 120), (2, 15)):
        base = text(n)
        out += [" ".join(edit(base, 0.04 if k % 3 else 0)) for k in range(size)]
    chain = text(300)
    for _ in range(5):
        out.append(" ".join(chain))
        chain = edit(chain, 0.12)
    out += [" ".join(text(r.randint(5, 300))) for _ in range(60)]
    out += ["same words each time " * 30, "same words each time " * 31, "one", "one", "one two"]
    r.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


def test_groups_are_those_of_brute_force(spark):
    rows = copies()
    want = {(rows[i][0], rows[g][0]) for i, g in brute.near_groups(rows).items()}
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.group_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    want = {(rows[i][0], rows[g][0]) for i, g in brute.near_groups(rows).items()}
    got = {(r.doc_id, r.group_id) for r in N.near_duplicates(documents).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_one_of_each_group_stays(spark):
    rows = copies(7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash"))
    kept = {r.doc_id for r in N.drop_near_duplicates(df).collect()}
    groups = brute.near_groups(rows)
    want = {d for i, (d, _) in enumerate(rows) if groups.get(i, i) == i}
    assert kept == want


def test_odd_rows(spark, odd, empty):
    got = {(r.doc_id, r.group_id, r.n_rows) for r in N.near_duplicates(odd).collect()}
    assert got == {(1, 1, 2)}
    left = N.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 1
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0


def test_one_id_with_two_texts_and_null_ids(spark):
    t = "a long enough text that is the same in both of the rows here"
    df = spark.createDataFrame([(1, t), (1, "something else entirely with other words"), (None, t), (None, t + " and"), (5, None), (6, "")], "doc_id bigint, text string")
    assert sorted(((r.doc_id, r.group_id) for r in N.near_duplicates(df).collect()), key=str) == [(1, 1), (None, 1), (None, 1)]
    assert N.drop_near_duplicates(df).count() == 4


def test_components_of_a_path(spark):
    node = lambda i: F.struct(F.lit(0).cast("bigint").alias("f"), i.cast("bigint").alias("r"))
    edges = spark.range(14).where("id != 7").select(node(F.col("id")).alias("a"), node(F.col("id") + 1).alias("b"))
    got = {r.x.r: r.c.r for r in N.components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 if i <= 7 else 8 for i in range(15)}


def test_scratch_tables_are_removed(spark, documents):
    fs, root = file_system(shared_dir(spark))
    tables = lambda: sum(x.path.endswith("-sketch") for x in fs.get_file_info(FileSelector(root, recursive=True)))
    before, out = tables(), N.near_duplicates(documents)
    assert tables() == before and out.count() > 0
