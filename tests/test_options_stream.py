"""Option submissions as a stream, however it is cut, against the table form; and expiry of their state."""

import os

import pytest
from pyspark.sql import functions as F

from leafmill.operators import incremental as I
from leafmill.sources import layout as L
from leafmill.streaming import options as O

@pytest.fixture(autouse=True)
def store_of_its_own(spark):
    yield
    for name in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"):
        spark.conf.unset(name)


NAMES = ["page_id", "version", "job_id", "mode", "error"]


@pytest.fixture(scope="module")
def submissions(spark):
    docs = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    nulls = spark.createDataFrame([(100, v, None, None, None, None, None, None, None, None, None, None) for v in (1, 2)], I.SUBMISSION)
    return L.submissions(docs).unionByName(nulls).cache()


def streamed(spark, path, batches, days=O.DAYS):
    """The rows that the stream gives of tables that arrive one after another."""
    (path / "in").mkdir(parents=True)
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(str(path / f"b{i}"))
        (file,) = (path / f"b{i}").glob("*.parquet")
        at = path / "in" / f"{i}.parquet"
        file.rename(at)
        os.utime(at, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(I.SUBMISSION).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    name = f"started_{abs(hash(str(path)))}"
    query = O.started(stream, days).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    return sorted(map(tuple, spark.table(name).select(*NAMES).collect()), key=str)


def cut(rows, n, by):
    return [rows.filter(by == i) for i in range(n)]


@pytest.mark.parametrize("way", ["one", "by version", "by page and version"])
def test_stream_gives_what_the_table_gives(spark, submissions, tmp_path, way):
    version = F.col("version") - 1
    batches = {"one": [submissions], "by version": cut(submissions, 4, version), "by page and version": cut(submissions, 5, version + F.col("page_id") % 2)}[way]
    want = sorted(map(tuple, I.started(submissions).select(*NAMES).collect()), key=str)
    assert streamed(spark, tmp_path, batches) == want
    assert {r[3] for r in want} == {"FULL", "ONLY_PARAGRAPHS", None} and {r[4] for r in want} == {"no image", None}


def test_options_expire(spark, submissions, tmp_path):
    """Equal options again: nothing while they are known, a first job once they are forgotten."""
    rows = submissions.filter("page_id = 2 and version = 1")
    again = rows.withColumn("version", F.lit(9))
    first = (2, 1, 1, "FULL", None)
    assert streamed(spark, tmp_path / "known", [rows, again]) == [first]
    assert streamed(spark, tmp_path / "gone", [rows, again], days=1 / 86_400_000) == [first, (2, 9, 1, "FULL", None)]
