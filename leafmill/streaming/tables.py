"""Streams into tables: keyed upserts that a repeated micro-batch doesn't change, and a pass over documents with two sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.incremental import CHEAP, OTHER
from leafmill.sources import hocr, results

Batch = Callable[[DataFrame, int], None]


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def upserting(path: str, delta: Callable[[DataFrame], DataFrame], merge: dict[str, Column], after: dict[str, Column] | None = None, pages: int = results.RANGE) -> Batch:
    """For ``foreachBatch``: keeps one row for each page_id under ``path``. ``delta`` makes rows of a micro-batch that ``merge`` (aggregates by column) joins with the stored ones, and ``after`` puts columns of the outcome in order; only
    partitions of pages that come are read and replaced.

    The ids of finished micro-batches are kept beside the table, so one that comes again changes nothing, whatever it holds. One that broke off after it had replaced some partitions is
    merged into them once more, so ``merge`` must not change by that: maxima, sets, the latest of a version."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = f"{path.rstrip('/')}-finished"
        if _there(spark, done) and not spark.read.parquet(done).filter(F.col("batch_id") >= batch_id).isEmpty():
            return
        new = delta(batch)
        if _there(spark, path):
            part = F.floor(F.col("page_id") / pages)
            touched = new.select(part.alias("part")).distinct()
            old = spark.read.parquet(path).join(touched, "part", "left_semi").drop("part")
            new = old.unionByName(new)
        merged = new.groupBy("page_id").agg(*(x.alias(c) for c, x in merge.items())).withColumns(after or {})
        if not batch.isEmpty():
            results.write(merged, path, pages)
        spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).coalesce(1).write.mode("append").parquet(done)

    return apply


def job_state(path: str, pages: int = results.RANGE) -> Batch:
    """Upserts jobs (kind, job_id) into the live state of pages: job_id, the last one submitted, and the jobs that ended and weren't overtaken by then."""

    def delta(jobs: DataFrame) -> DataFrame:
        last = F.max(F.when(F.col("kind") == "submit", F.col("job_id"))).alias("job_id")
        ended = F.collect_set(F.when(F.col("kind") == "done", F.col("job_id"))).alias("ended")
        return jobs.groupBy("page_id").agg(last, ended)

    # a job that ends before its submission is seen is kept until that comes
    ended = F.array_distinct(F.flatten(F.collect_list("ended")))
    current = F.filter("ended", lambda j: j >= F.coalesce("job_id", F.lit(0)))
    return upserting(path, delta, {"job_id": F.max("job_id"), "ended": ended}, {"ended": current}, pages)


def live_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of pages that ``job_state`` keeps, as ``incremental.current_state`` gives it: page_id, the last job, and whether it has ended."""
    return spark.read.parquet(path).filter("job_id is not null").select("page_id", "job_id", F.array_contains("ended", F.col("job_id")).alias("finished"))


def latest_options(path: str, pages: int = results.RANGE) -> Batch:
    """Upserts options (version, OTHER, CHEAP) by page: those of the highest version stand."""
    names = [*OTHER, *CHEAP]
    latest = lambda rows: rows.groupBy("page_id").agg(F.max("version").alias("version"), F.max_by(F.struct(*names), "version").alias("options"))
    return upserting(path, latest, {"version": F.max("version"), "options": F.max_by("options", "version")}, pages=pages)


def good_and_bad(words_path: str, bad_path: str, key: str = "doc") -> Batch:
    """For ``foreachBatch`` over hOCR documents (key, content): readable words under ``words_path``, and under ``bad_path`` what can't be read, with the reason: whole documents, or single words with their place.

    Documents are parsed once for both. Every micro-batch has a folder of its own in either table and replaces it, so one that comes again after a restart, be it between the two sinks,
    leaves each row once."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        parsed = hocr.parsed(batch)
        words = hocr.words(parsed, key).persist()
        place = ["page_no", "line_no", "word_no"]
        try:
            words.filter("error is null").drop("error").write.mode("overwrite").parquet(f"{words_path}/batch={batch_id}")
            documents = parsed.filter("error is not null").select(key, *(F.lit(None).cast("int").alias(c) for c in place), "error")
            single = words.filter("error is not null").select(key, *place, "error")
            documents.unionByName(single).withColumnRenamed("error", "reason").write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        finally:
            words.unpersist()

    return apply
