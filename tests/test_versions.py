"""Typed option values, changes between versions of pages, and exports by session."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import typed as Y
from leafmill.operators import hierarchy as H
from leafmill.operators import textlayer as T
from leafmill.operators import versions as V
from leafmill.sources import layout as L


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("[true]", (True, None, None, None)), ("[false]", (False, None, None, None)), ("[true, false]", (None,) * 4), ("[7]", (None, 7, None, None)), ("[7, 8]", (None,) * 4), ("[]", (None,) * 4), ("[3000000000]", (None,) * 4),
        ("[2.5e0]", (None, None, 2.5, None)), ("[7e0]", (None, None, 7.0, None)), ('"7"', (None, None, None, "7")), ('["7"]', (None,) * 4), ('""', (None, None, None, "")), ("7", (None,) * 4), ("true", (None,) * 4), ("null", (None,) * 4), ("[null]", (None,) * 4), ('{"a": 1}', (None,) * 4), ("[[1]]", (None,) * 4),
    ],
)
def test_only_the_type_that_was_set(spark, value, want):
    v = F.parse_json(F.lit(value))
    assert tuple(spark.range(1).select(Y.as_bool(v), Y.as_int(v), Y.as_double(v), Y.as_string(v)).first()) == want


def test_typed_arrays_and_strings(spark):
    row = lambda v: tuple(spark.range(1).select(Y.as_bool(v), Y.as_int(v), Y.as_double(v), Y.as_string(v)).first())
    assert row(Y.typed(F.array(F.lit(5)))) == (None, 5, None, None)
    assert row(Y.typed(F.array(F.lit(5.0)))) == (None, None, 5.0, None)
    assert row(Y.typed(F.array(F.lit(True)))) == (True, None, None, None)
    assert row(Y.typed(F.lit("x"))) == (None, None, None, "x")
    assert row(F.lit(None).cast("variant")) == (None,) * 4


def test_changes_between_versions(spark):
    docs = spark.createDataFrame([(i, f"some words of page {i}\nand a line\n\nmore") for i in range(6)], "doc_id long, text string")
    words = L.structured(L.words(docs))
    old = H.nest(words)
    assert V.word_changes(old, old).collect() == []
    null = F.lit(None).cast("double")
    other = words.filter("page_id <> 1").filter("not (page_id = 2 and word_no = 3)")
    at = lambda p, l, w: (F.col("page_id") == p) & (F.col("line_no") == l) & (F.col("word_no") == w)
    other = other.withColumns({"confidence": F.when(at(3, 0, 1), null).otherwise(F.col("confidence")), "content": F.when(at(4, 1, 0), "And").otherwise(F.col("content"))})
    newcomer = words.filter("page_id = 0").withColumn("page_id", F.lit(9).cast("long"))
    new = H.nest(other.unionByName(newcomer))
    assert {r.page_id for r in V.changed_pages(old, new).collect()} == {1, 2, 3, 4, 9}
    got = {(r.page_id, r.line_no, r.word_no): r.status for r in V.word_changes(old, new).collect()}
    page = lambda p, status: {(p, r.line_no, r.word_no): status for r in words.filter(F.col("page_id") == (0 if p == 9 else p)).collect()}
    assert got == page(1, "gone") | page(9, "new") | {(2, 0, 3): "gone", (3, 0, 1): "changed", (4, 1, 0): "changed"}
    # nulls equal nulls
    blank = H.nest(words.withColumn("confidence", null))
    assert V.changed_pages(blank, blank).collect() == [] and V.word_changes(blank, blank).collect() == []


def test_sessions_have_a_last_page_each(spark):
    pages = spark.createDataFrame([(i * 40_000_000, "ab"[i % 2] if i < 8 else None) for i in range(11)], "page_id long, run string")
    got = {r.page_id // 40_000_000: r.file for r in T.export_manifest(pages, session="run").collect()}
    assert got == {0: "a/scan-1.png", 2: "a/scan-2.png", 4: "a/scan-3.png", 1: "b/scan-1.png", 3: "b/scan-2.png", 5: "b/scan-3.png", 8: "/scan-1.png", 9: "/scan-2.png"}
    books = T.export_manifest(pages, session="run", form="pdf").filter("session = 'b'").orderBy("page_id").collect()
    assert [(r.file, r.file_page) for r in books] == [("b/scan.pdf", 1), ("b/scan.pdf", 2), ("b/scan.pdf", 3)]
