"""Streaming forms against their batch forms."""

import json
import os

from pyspark.sql import functions as F

from leafmill.operators import incremental as I
from leafmill.sources import hocr, layout
from leafmill.operators import hierarchy as H
from leafmill.streaming import jobs as J

ROWS = [(1, 1, "submit", 1), (1, 2, "done", 1), (1, 3, "submit", 2), (1, 4, "submit", 3), (1, 5, "done", 2), (1, 6, "done", 3), (2, 7, "submit", 1), (2, 8, "submit", 2), (2, 9, "done", 1)]
BATCHES = [ROWS[:2], ROWS[2:5], ROWS[5:]]


def test_latest_submission_wins(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        (tmp_path / "in").mkdir(exist_ok=True)
        file = tmp_path / "in" / f"{i}.json"
        file.write_text("\n".join(json.dumps({"page_id": p, "seq": s, "ts": f"2024-01-01T00:00:{s:02}", "kind": k, "job_id": j}) for p, s, k, j in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # a file stream reads in the order of these
    stream = spark.readStream.schema(J.JOBS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = J.published(stream).writeStream.format("memory").queryName("published").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert out.awaitTermination(90)
    got = sorted(tuple(r) for r in spark.table("published").collect())
    batch = I.published(spark.createDataFrame([(p, s, None, k, j) for p, s, k, j in ROWS], J.JOBS))
    assert got == sorted(tuple(r) for r in batch.collect()) == [(1, 2, 1), (1, 6, 3)]
    state = {r.page_id: (r.job_id, r.finished) for r in I.current_state(spark.createDataFrame([(p, s, None, k, j) for p, s, k, j in ROWS], J.JOBS)).collect()}
    assert state == {1: (3, True), 2: (2, False)}


def test_arriving_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words\nhere"), (2, "and there")], "doc_id long, text string")
    hocr.write(hocr.documents(H.nest(layout.structured(layout.words(docs)))), str(tmp_path / "docs"))
    out = J.arriving(spark, str(tmp_path / "docs" / "*")).select("content").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert out.awaitTermination(90)
    assert sorted(r.content for r in spark.table("arrived").collect()) == ["and", "here", "some", "there", "words"]
    assert hocr.manifest(spark, str(tmp_path / "docs" / "*")).count() == 2


def test_finished_scans_go_to_recognition(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, "not these"), (3, "and these")], "doc_id long, text string")
    pages = hocr.documents(H.nest(layout.structured(layout.words(docs)))).withColumnsRenamed({"doc": "page_id"})
    kind = F.when(F.col("page_id") == 2, "PREVIEW").otherwise("NORMAL")
    pages.withColumn("scan_type", kind).write.parquet(str(tmp_path / "scans"))
    stream = spark.readStream.schema("page_id long, content string, scan_type string").parquet(str(tmp_path / "scans"))
    out = J.recognised(stream).select("page_id", "content").writeStream.format("memory").queryName("recognised").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert out.awaitTermination(90)
    assert sorted((r.page_id, r.content) for r in spark.table("recognised").collect()) == [(1, "some"), (1, "words"), (3, "and"), (3, "these")]
