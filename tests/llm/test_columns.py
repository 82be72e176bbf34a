"""Names of columns, nulls, ties, repeated rows and long texts in the stages that keep rows."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from threadmill.llm import decontam, fingerprints, langid, license_scan, near_dedup, packing, pii, quality
from threadmill.llm.common import clear_leftovers, file_system, shared_dir


@pytest.fixture
def stages(spark, documents):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    profiles, model = langid.train_profiles(documents), pii.train()
    return {
        "language": lambda d: langid.keep_identified(d, profiles=profiles), "dedup": near_dedup.drop_near_duplicates,
        "decontamination": lambda d: decontam.drop_contaminated(d, items), "redaction": lambda d: pii.redact_rows(d, model),
    }


NAMES = ["doc_id", "text", "lang", "meta.url", "_metadata", "__threadmill_row", "__threadmill_file", "TEXT", "c1", "n", "a`b", "n_chars", "x", "x"]


def clash(df):
    extra = [F.lit(f"v{i}") for i in range(len(NAMES) - 4)] + [F.lit("two")]
    return df.select("doc_id", "text", "lang", *extra).toDF(*NAMES)


def test_names_may_clash(spark, odd, stages, tmp_path):
    odd.select("doc_id", "text", "lang").write.parquet(str(tmp_path / "d"))
    for read in (odd, spark.read.parquet(str(tmp_path / "d"))):
        for name, stage in stages.items():
            got, want = stage(clash(read)), stage(read.select("doc_id", "text", "lang"))
            assert got.columns == NAMES, name
            assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, map(tuple, want.collect()))), name


def test_metadata_column_of_a_file(spark, odd, stages, tmp_path):
    odd.selectExpr("doc_id", "text", "lang", "'u' as _metadata", "1 as `meta.url`").write.parquet(str(tmp_path / "d"))
    got = stages["dedup"](spark.read.parquet(str(tmp_path / "d")))
    assert got.columns == ["doc_id", "text", "lang", "_metadata", "meta.url"] and got.count() == odd.count() - 1


def test_rows_that_differ_elsewhere_are_one_document(spark, stages):
    t = "a text that is long enough to be told from the others in the table"
    df = spark.createDataFrame([(1, t, "en", "b"), (1, t, "en", "a"), (2, t, "en", "a"), (3, None, "en", "a"), (3, None, "en", "a"), (4, "", "en", "z")], "doc_id bigint, text string, lang string, s string")
    for parts in (1, 3, 6):
        got = stages["dedup"](df.repartition(parts))
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, t), (3, None), (3, None), (4, "")], key=str)
        assert {r.s for r in got.where("doc_id = 1").collect()} in ({"a"}, {"b"})
    assert len({str(sorted(map(str, stages["dedup"](df.repartition(p)).collect()))) for p in (1, 4)}) == 1


def test_long_texts(spark, stages):
    """Some 50 MB in one row, as one document among others."""
    long = " ".join(f"the number {i} of many more words" for i in range(1_500_000))
    df = spark.createDataFrame([(1, "some plain words that stand here"), (2, long)], "doc_id bigint, text string").withColumn("lang", F.lit("en")).repartition(2)
    assert len(long) > 50_000_000
    assert decontam.drop_contaminated(df, spark.createDataFrame([(1, "number 77 of many more words the number 78 of")], "item_id bigint, text string")).count() == 1
    assert {r.n_words for r in fingerprints.lcp_fingerprints(df).select("n_words").collect()} == {6, 10_500_000}
    assert packing.pack_windows(df).agg(F.sum("n_tokens")).first()[0] == 10_500_006
    assert license_scan.scan(df).count() == 0
    assert stages["language"](df).count() == 2


def test_ids_that_are_not_numbers(documents, stages):
    text_ids = documents.withColumn("doc_id", F.col("doc_id").cast("string"))
    labels = text_ids.selectExpr("1 as doc_id", "1 as quality", "0 as toxic")
    for run in (fingerprints.lcp_fingerprints, fingerprints.shared_passages, near_dedup.near_duplicates, license_scan.scan, packing.pack_windows, langid.identify, pii.redact, lambda d: decontam.find_contamination(d, d), lambda d: quality.score(d, labels)):
        with pytest.raises(ValueError, match="doc_id"):
            run(text_ids)


def test_what_lies_in_the_shared_folder_goes(spark, documents, stages):
    fs, root = file_system(shared_dir(spark))
    from pyarrow.fs import FileSelector

    lists = lambda: sum("-gone" in x.path for x in fs.get_file_info(FileSelector(root, recursive=True)))
    clear_leftovers(spark)
    out = stages["dedup"](documents)
    assert out.count() < documents.count() and lists() > 0
    clear_leftovers(spark)
    assert lists() == 0
