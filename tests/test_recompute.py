"""Stored results brought to new options: what is done again, what stays, and runs that break off."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators import blur as B
from leafmill.operators import hierarchy as H
from leafmill.operators import recompute as RC
from leafmill.sources import layout as L
from leafmill.sources import results

PAGES = 10


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, f"some words stand here {i}\nand more of them\n\nlast line {i % 7}") for i in range(60)], "doc_id long, text string").cache()
    px = spark.createDataFrame([(p, y, x, (x * 7 + y * 13 + p * 5 + x * y) % 200) for p in range(0, 60, 3) for y in range(20) for x in range(64)], "page_id long, y int, x int, v int").cache()
    return docs, px


@pytest.fixture
def job(spark, tables, tmp_path):
    docs, px = tables
    asked = {"words": [], "measures": []}

    def recognise(pages):
        asked["words"] += [r.page_id for r in pages.collect()]
        return L.words(docs.join(pages.withColumnRenamed("page_id", "doc_id"), "doc_id", "left_semi")).select(*H.LEVELS, "content", "confidence")

    def measure(pages):
        asked["measures"] += [r.page_id for r in pages.collect()]
        own = px.join(pages, "page_id", "left_semi")
        return B.measures(L.cells(own), own)

    return recognise, measure, asked, str(tmp_path / "store")


def files(path):
    import pathlib

    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("*.parquet") if "/modes/" not in str(f)}


def held(spark, path):
    return {name: sorted(map(tuple, spark.read.parquet(f"{path}/{name}").drop("part").collect()), key=str) for name in ("kept", "flags", "options")}


def change(options, full=(), cheap=()):
    return options.withColumns({"text_max_diff": F.when(F.col("page_id").isin(*full, -1), 9.0).otherwise(F.col("text_max_diff")), "min_word_confidence": F.when(F.col("page_id").isin(*cheap, -1), 0.6).otherwise(F.col("min_word_confidence")), "blur_coef": F.when(F.col("page_id").isin(*cheap, -1), 0.3).otherwise(F.col("blur_coef"))})


def test_only_what_changed_is_done_again(spark, tables, job, tmp_path):
    recognise, measure, asked, path = job
    first = L.options(tables[0]).filter("version = 1").drop("version")
    RC.create(first, recognise, measure, path, PAGES)
    before = files(path)
    for of in asked.values():
        of.clear()
    new = change(first, full=(1, 12), cheap=(2, 15, 16))
    newcomer = L.options(tables[0]).filter("version = 2 and page_id = 49").drop("version")  # pages whose id is a multiple of 7 were not there
    modes = {r.page_id: r["mode"] for r in RC.recompute(new.unionByName(newcomer), recognise, measure, path, PAGES).collect()}
    assert {p for p, m in modes.items() if m == "FULL"} == {1, 12, 49}
    assert {p for p, m in modes.items() if m == "ONLY_PARAGRAPHS"} == {2, 15, 16}
    assert sorted(asked["words"]) == sorted(asked["measures"]) == [1, 12, 49]
    after = files(path)
    parts = lambda found, part: {f: t for f, t in found.items() if f"part={part}/" in f}
    for part in (2, 3, 5):
        assert parts(after, part) == parts(before, part) != {}
    for part in (0, 1, 4):
        assert parts(after, part) != parts(before, part)
    whole = str(tmp_path / "whole")
    RC.create(new.unionByName(newcomer), recognise, measure, whole, PAGES)
    assert held(spark, path) == held(spark, whole)


def test_cheap_changes_alone_recognise_nothing(spark, tables, job, tmp_path):
    recognise, measure, asked, path = job
    first = L.options(tables[0]).filter("version = 1").drop("version")
    RC.create(first, recognise, measure, path, PAGES)
    for of in asked.values():
        of.clear()
    before = files(path)
    new = change(first, cheap=range(60))
    RC.recompute(new, recognise, measure, path, PAGES)
    assert asked == {"words": [], "measures": []}
    same = lambda found: {f: t for f, t in found.items() if f.startswith(("words", "measures"))}
    assert same(files(path)) == same(before)
    now = files(path)
    RC.recompute(new, recognise, measure, path, PAGES)  # nothing differs any more
    assert files(path) == now


def test_a_broken_run_is_run_again(spark, tables, job, tmp_path):
    recognise, measure, asked, path = job
    first = L.options(tables[0]).filter("version = 1").drop("version")
    RC.create(first, recognise, measure, path, PAGES)
    new = change(first, full=(1,), cheap=(2, 30))

    def broken(pages):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        RC.recompute(new, recognise, broken, path, PAGES)
    RC.recompute(new, recognise, measure, path, PAGES)
    whole = str(tmp_path / "whole")
    RC.create(new, recognise, measure, whole, PAGES)
    assert held(spark, path) == held(spark, whole)


def test_partitions_are_dealt_to_several_tasks(spark, tmp_path):
    rows = spark.range(10_000).withColumnRenamed("id", "page_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small rows stay dealt
    results.write(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert back.filter("part = 0").count() == 10_000
    assert back.select("page_id").distinct().count() == 10_000
    assert results.read(spark, str(tmp_path / "t"), 7_777).count() == 1
    assert len(back.inputFiles()) > 1
