from collections import Counter

import numpy as np

import corpus_pipeline as cp
from tests.conftest import SMALL
from tests.compare import check, database
from tests.llm import brute
from tests.llm.test_pii import plain_select
from threadmill.llm import langid, pii, queries


def identified(rows):
    """Ids of the documents (doc_id, text, lang) whose language can be told, letter by letter: bundles of
    bound trigrams, prototypes of all labelled texts, cosines."""
    vectors, grams = {}, {}
    for d, text, _ in rows:
        chars = [" "]
        for c in (text or "").lower():
            c = c if c.isalpha() else " "
            if c != " " or chars[-1] != " ":
                chars.append(c)
        chars += [" "] if chars[-1] != " " else []
        grams[d] = Counter(zip(chars, chars[1:], chars[2:])), sum(c.isalpha() for c in (text or "").lower())

    def bundle(counts):
        out = np.zeros(langid.DIM)
        for g, n in counts.items():
            if g not in vectors:
                a, b, c = (langid.letter_vector(ord(x)).astype(float) for x in g)
                vectors[g] = np.roll(a, 2) * np.roll(b, 1) * c
            out += n * vectors[g]
        return out

    bundles = {d: bundle(g) for d, (g, _) in grams.items()}
    prototypes = {}
    for d, _, lang in rows:
        if lang is not None:
            prototypes[lang] = prototypes.get(lang, 0) + bundles[d]
    kept = set()
    for d, b in bundles.items():
        best, letters = max(brute.cosine(b, p) for p in prototypes.values()), grams[d][1]
        if letters and best >= langid.MIN_COSINE * min(1.0, letters / langid.FULL_LETTERS) ** 0.5:
            kept.add(d)
    return kept


def test_stages_against_plain_versions(spark, documents, tmp_path):
    """Each stage, and the whole, against one-by-one versions of what it decides, none of which calls it."""
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    rows = {r.doc_id: r.text for r in documents.collect()}
    keep = identified([(r.doc_id, r.text, r.lang) for r in documents.collect()])
    rows = {d: t for d, t in sorted(rows.items()) if d in keep}
    groups = brute.near_groups(list(rows.items()))
    rows = {d: t for i, (d, t) in enumerate(rows.items()) if groups.get(i, i) == i}
    rows = {d: t for d, t in rows.items() if not any(brute.containment(x.text, t) >= 0.5 for x in items)}
    model = pii.train()
    for d, t in rows.items():
        for a, b in reversed(plain_select(t, model)):
            t = t[:a] + "[X]" + t[b:]  # as many tokens as the name of any kind
        rows[d] = t
    want = {d: brute.tokens(t) for d, t in rows.items() if brute.tokens(t)}
    docs = documents
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
        if name != "windows":
            assert docs.columns == documents.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = docs.toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    assert got.window_tokens.max() <= 4096
    whole = cp.run(spark, SMALL).toPandas()
    key = ["window_id", "doc_id", "piece"]
    assert whole.sort_values(key).reset_index(drop=True).equals(got.sort_values(key).reset_index(drop=True))


def test_empty_documents(spark, documents, tmp_path):
    documents.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_sql(spark):
    db = database(SMALL)
    for name, sql in queries.ORACLE_SQL.items():
        check(spark, db, SMALL, queries.QUERIES[name], sql)


def test_names():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and sum(n.startswith("op") for n in entry.queries()) == 10


def test_rows_of_every_awkward_kind(spark, odd, tmp_path):
    """Nulls, empty and long texts, ties and repeated rows through all stages, with columns that clash."""
    odd = odd.unionByName(odd.where("doc_id = 7"))  # the one text of its language: accepted, and here twice
    odd.withColumn("_metadata", odd["text"]).withColumn("c0", odd["doc_id"]).withColumnRenamed("source", "meta.url").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = cp.run(spark, str(tmp_path)).toPandas()
    kept = {r.doc_id for r in langid.identify(odd).where("accepted").collect()}
    assert set(got.doc_id.dropna().astype(int)) == {d for d in kept if d is not None} and (got.doc_id == 7).sum() == 1
    assert 1 not in kept  # a long text of 18 trigrams is nearly all of its language's prototype
    assert got.groupby("window_id").n_tokens.sum().max() <= 4096
