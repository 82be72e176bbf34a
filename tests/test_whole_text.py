"""Text queries that also have SQL give what a loop over whole texts gives."""

import re

import pytest

from threadmill.plans import registry

TEXT = "  Alpha, beta! " + " ".join(f"Word{i}\u00e9?" for i in range(90)) + " last-One " + "x" * 40 + " beta Zz..."


def wiki(text):
    return re.sub("^-+|-+$", "", "".join(c if c.isalpha() or c.isdigit() else "-" for c in text))


def tags(text):
    shown = ("".join(c for c in re.sub(r"[ \t\n\r\f\v]", "-", t.strip(" ").lower()) if c.isalpha() or c.isdigit() or c in "_-")[:32] for t in text.split(" "))
    return ",".join(sorted({t for t in shown if t}))


@pytest.mark.parametrize(("name", "brute"), [("f14_wiki_safe", wiki), ("f16_tag_list", tags)])
def test_whole_text(spark, tmp_path, name, brute):
    texts = [TEXT, TEXT[:60], "short one", "", " !? ", "tail at\nline two " * 30 + "END"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r[1] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
