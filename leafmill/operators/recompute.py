"""Recomputation over stored results when options change: only what depends on them, and only in the partitions of the pages concerned.

A store holds five tables by page: ``words`` and ``measures`` (recognition and blur measures, which cheap options leave alone), ``kept`` (the words that are left after the
clean-up, by number), ``flags`` (blurred words) and ``options`` (the manifest of what the others were made with).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import blur as B
from leafmill.operators.hierarchy import LEVELS
from leafmill.operators.incremental import CHEAP, OTHER, recompute_mode
from leafmill.sources import results

Source = Callable[[DataFrame], DataFrame]


def _cleaned(words: DataFrame, options: DataFrame) -> DataFrame:
    own = options.select("page_id", "min_word_confidence")
    return words.join(own, "page_id").filter("confidence >= min_word_confidence").select(*LEVELS)


def _flags(measures: DataFrame, options: DataFrame) -> DataFrame:
    own = options.select("page_id", "blur_coef")
    return B.flagged(measures.join(own, "page_id"), F.col("blur_coef")).select("page_id", "cell", "blurred")


def create(options: DataFrame, recognise: Source, measure: Source, path: str, pages: int = results.RANGE) -> None:
    """A store of the pages of ``options`` (page_id and options). ``recognise`` and ``measure`` give the words and blur measures of a table of page_ids."""
    spark, ids = options.sparkSession, options.select("page_id")
    results.write(recognise(ids), f"{path}/words", pages)
    results.write(measure(ids), f"{path}/measures", pages)
    results.write(_cleaned(spark.read.parquet(f"{path}/words").drop("part"), options), f"{path}/kept", pages)
    results.write(_flags(spark.read.parquet(f"{path}/measures").drop("part"), options), f"{path}/flags", pages)
    results.write(options.select("page_id", *OTHER, *CHEAP), f"{path}/options", pages)


def recompute(options: DataFrame, recognise: Source, measure: Source, path: str, pages: int = results.RANGE) -> DataFrame:
    """Brings the store to ``options`` (page_id and options, one row for each page concerned) and returns page_id and mode.

    FULL pages are recognised and measured anew; ONLY_PARAGRAPHS ones take their stored words and measures, of which only the partitions with such pages are read; both go through clean-up and flags
    together. Partitions that hold a recomputed page are replaced whole, with what their other pages had; the files of all others stay. Pages of mode NONE and
    pages that ``options`` doesn't name keep their results. The manifest comes last, so a run that broke off is simply run again.
    """
    spark = options.sparkSession
    stored = lambda name: spark.read.parquet(f"{path}/{name}")
    modes = recompute_mode(options, stored("options").drop("part")).withColumn("part", F.floor(F.col("page_id") / pages))
    modes_at = f"{path}/modes"
    modes.write.mode("overwrite").parquet(modes_at)  # decided once, before anything changes
    modes = spark.read.parquet(modes_at)
    todo = modes.filter("mode <> 'NONE'")
    full, cheap = todo.filter("mode = 'FULL'").select("page_id"), todo.filter("mode = 'ONLY_PARAGRAPHS'")
    own = options.join(todo.select("page_id"), "page_id", "left_semi")

    def replaced(name: str, new: DataFrame, pages_changed: DataFrame) -> None:
        """The partitions of ``pages_changed`` with ``new`` in place of those pages' rows."""
        touched = pages_changed.select("part").distinct()
        old = stored(name).join(touched, "part", "left_semi").join(pages_changed.select("page_id"), "page_id", "left_anti").drop("part")
        results.write(old.unionByName(new), f"{path}/{name}", pages)

    def reused(name: str) -> DataFrame:
        return stored(name).join(cheap.select("part", "page_id"), ["part", "page_id"], "left_semi").drop("part")

    # FULL pages get their words and measures first; a broken run would only repeat it
    renewed = todo.filter("mode = 'FULL'")
    fresh = {"words": recognise, "measures": measure}
    if not renewed.isEmpty():
        for name, source in fresh.items():
            replaced(name, source(full), renewed)
    again = {name: stored(name).join(renewed.select("part", "page_id"), ["part", "page_id"], "left_semi").drop("part").unionByName(reused(name)) for name in fresh}
    if not todo.isEmpty():
        replaced("kept", _cleaned(again["words"], own), todo)
        replaced("flags", _flags(again["measures"], own), todo)
        replaced("options", own.select("page_id", *OTHER, *CHEAP), todo)
    return modes.select("page_id", "mode")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Each page of a store with the number of words left, of blurred ones, and its cheap options."""
    stored = lambda name: spark.read.parquet(f"{path}/{name}")
    kept = stored("kept").groupBy("page_id").agg(F.count("*").alias("n_words"), F.sum(F.col("line_no") * 31 + F.col("word_no")).alias("places"))
    blurred = stored("flags").filter("blurred").groupBy("page_id").agg(F.count("*").alias("n_blurred"))
    out = stored("options").select("page_id", *CHEAP).join(kept, "page_id", "left").join(blurred, "page_id", "left")
    return out.na.fill(0, ["n_words", "places", "n_blurred"])
