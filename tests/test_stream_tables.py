"""Upserts and sinks of streams: replayed micro-batches, restarts between sinks, and the table forms."""

import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from leafmill.operators import hierarchy as H
from leafmill.operators import incremental as I
from leafmill.sources import hocr, layout
from leafmill.streaming import jobs as J
from leafmill.streaming import tables as T


def arriving(tmp_path, batches):
    (tmp_path / "in").mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        file = tmp_path / "in" / f"{i:03}.json"
        file.write_text("\n".join(map(json.dumps, rows)))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path / "in")


def run(spark, schema, path, checkpoint, apply):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query.awaitTermination(120)


#: Submissions and ends of jobs in turn; of page 2 ends come before their submissions, of odd pages the last end is of an old job.
ROWS = [(p, 10 * s + i, "submit" if (s + (p == 2)) % 2 == 0 else "done", 1 + s // 2 - (s % 2 and p % 2 and s > 7)) for s in range(10) for i, p in enumerate((0, 1, 2, 3, 40, 41))]


def test_job_state_equals_the_table_form(spark, tmp_path):
    rows = [{"page_id": p, "seq": s, "ts": f"2024-01-01T00:{s:02}:00", "kind": k, "job_id": j} for p, s, k, j in ROWS]
    path = arriving(tmp_path, [rows[:9], rows[9:10], rows[10:30], rows[30:]])
    table = str(tmp_path / "state")
    assert run(spark, J.JOBS, path, str(tmp_path / "c"), T.job_state(table, 10))
    want = sorted(map(tuple, I.current_state(spark.createDataFrame([(p, s, None, k, j) for p, s, k, j in ROWS], J.JOBS)).collect()))
    live = lambda: sorted(map(tuple, T.live_state(spark, table).collect()))
    assert live() == want and {r[2] for r in want} == {True, False}

    # a replayed micro-batch changes nothing, whatever it holds; nor is a file written
    files = lambda: {str(f): f.stat().st_mtime_ns for f in pathlib.Path(table).rglob("*.parquet")}
    before = files()
    other = spark.createDataFrame([(1, 99, None, "submit", 50)], J.JOBS)
    T.job_state(table, 10)(other, 2)
    assert live() == want and files() == before
    # a new one does, in its partition alone
    T.job_state(table, 10)(other, 4)
    assert (1, 50, False) in live()
    assert {f for f in before if "part=4" in f} <= set(files()) and {f for f in before if "part=0" in f}.isdisjoint(files())


def test_a_batch_that_broke_off_is_merged_again(spark, tmp_path):
    """The table was replaced, but the batch isn't noted as finished: applied again, it changes nothing."""
    table = str(tmp_path / "state")
    apply = T.job_state(table, 10)
    first = spark.createDataFrame([(1, 1, None, "submit", 1), (1, 2, None, "done", 1), (12, 3, None, "submit", 1)], J.JOBS)
    apply(first, 0)
    state = sorted(map(tuple, T.live_state(spark, table).collect()))
    os.rename(f"{table}-finished", str(tmp_path / "lost"))
    apply(first, 0)
    assert sorted(map(tuple, T.live_state(spark, table).collect())) == state == [(1, 1, True), (12, 1, False)]


def test_latest_options(spark, tmp_path):
    docs = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    options = layout.options(docs)
    table = str(tmp_path / "options")
    apply = T.latest_options(table, 10)
    apply(options.filter("version = 2 and page_id < 12"), 0)
    apply(options.filter("version = 1"), 1)  # late: what is newer stands
    apply(options.filter("version = 2 and page_id >= 15"), 2)
    got = {r.page_id: (r.version, r.options.min_word_confidence) for r in spark.read.parquet(table).collect()}
    want = {r.page_id: (r.version, r.min_word_confidence) for r in options.orderBy("version").collect() if r.version == 1 or r.page_id < 12 or r.page_id >= 15}
    assert got == want


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.createDataFrame([(i, f"some words {i}\nand more") for i in range(12)], "doc_id long, text string")
    pages = hocr.documents(H.nest(layout.structured(layout.words(docs)))).collect()
    broken = {1: lambda c: c.replace("</body>", ""), 4: lambda c: "<html><head></head></html>", 6: lambda c: c.replace("x_wconf", "x_conf", 1), 9: lambda c: c.replace("baseline", "base", 1)}
    return [{"doc": r.doc, "content": broken.get(r.doc, lambda c: c)(r.content)} for r in sorted(pages, key=lambda r: r.doc)]


def test_two_sinks_with_a_restart_between_them(spark, documents, tmp_path, monkeypatch):
    schema = "doc long, content string"
    path = arriving(tmp_path, [documents[:5], documents[5:8], documents[8:]])
    good, bad, checkpoint = str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c")
    real = T.good_and_bad(good, bad)

    def breaks(batch, batch_id):
        """The second micro-batch writes its words and ends before what is bad."""
        if batch_id == 1:
            words = hocr.words(hocr.parsed(batch))
            words.filter("error is null").drop("error").write.mode("overwrite").parquet(f"{good}/batch=1")
            raise RuntimeError("restart")
        real(batch, batch_id)

    with pytest.raises(Exception, match="restart"):
        run(spark, schema, path, checkpoint, breaks)
    assert os.path.isdir(f"{good}/batch=1") and not os.path.isdir(f"{bad}/batch=1")
    assert run(spark, schema, path, checkpoint, real)
    whole = hocr.parsed(spark.createDataFrame([(d["doc"], d["content"]) for d in documents], schema))
    words = hocr.words(whole)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    place = ["doc", "line_no", "word_no", "content"]
    assert key(spark.read.parquet(good).select(*place)) == key(words.filter("error is null").select(*place))
    want = [(1, None, "malformed"), (4, None, "no body"), (6, 0, "word"), *[(9, i, "line") for i in range(3)]]
    assert key(spark.read.parquet(bad).select("doc", "word_no", "reason")) == sorted(want, key=str)
    once = spark.read.parquet(good).groupBy("doc", "line_no", "word_no").count().filter(F.col("count") > 1)
    assert once.isEmpty()
