"""Incremental rules: which completion counts, and what has to be done again when options change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Options that change only what follows recognition.
CHEAP = ["min_word_confidence", "blur_coef"]
OTHER = ["fix_text_rotation", "text_min_fraction", "text_max_diff", "keep_size", "fix_page_orientation", "page_min_fraction", "page_max_diff"]

SUBMISSION = "page_id long, version int, has_image boolean, fix_text_rotation boolean, text_min_fraction double, text_max_diff double, keep_size boolean, fix_page_orientation boolean, page_min_fraction double, page_max_diff double, min_word_confidence double, blur_coef double"
STARTED = "page_id long, version int, job_id int, mode string, error string"


def published(jobs: DataFrame) -> DataFrame:
    """Completions (page_id, seq, job_id) whose job was the page's last submission when they came; others are stale."""
    last = F.max(F.when(F.col("kind") == "submit", F.col("job_id"))).over(W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    return jobs.withColumn("last", last).filter("kind = 'done' and job_id = last").select("page_id", "seq", "job_id")


def current_state(jobs: DataFrame) -> DataFrame:
    """Each page's last submission, and whether its result is there; none until the new job ends."""
    last = jobs.filter("kind = 'submit'").groupBy("page_id").agg(F.max("job_id").alias("job_id"))
    done = jobs.filter("kind = 'done'").select("page_id", "job_id").distinct().withColumn("done", F.lit(True))
    return last.join(done, ["page_id", "job_id"], "left").select("page_id", "job_id", F.coalesce("done", F.lit(False)).alias("finished"))


def recompute_mode(new: DataFrame, old: DataFrame) -> DataFrame:
    """page_id and mode: FULL without a previous run or where an option of recognition changed, ONLY_PARAGRAPHS where a cheap one did, else NONE."""
    before = old.select(F.col("page_id").alias("before"), *(F.col(c).alias(f"old_{c}") for c in OTHER + CHEAP))
    differs = lambda names: F.array_contains(F.array(*(~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in names)), True)
    mode = F.when(F.col("before").isNull() | differs(OTHER), "FULL").when(differs(CHEAP), "ONLY_PARAGRAPHS").otherwise("NONE")
    return new.join(before, new.page_id == before.before, "left").select("page_id", mode.alias("mode"))


def reused(words: DataFrame, modes: DataFrame, options: DataFrame) -> DataFrame:
    """The recognised words of pages that need ONLY_PARAGRAPHS, cleaned again by their new min_word_confidence, with blur_coef for their blur flags; pages of other modes give none."""
    again = modes.filter("mode = 'ONLY_PARAGRAPHS'").join(options.select("page_id", "min_word_confidence", "blur_coef"), "page_id").drop("mode")
    return words.join(again, "page_id").filter("confidence >= min_word_confidence")


def option_changes(options: DataFrame) -> DataFrame:
    """Versions that differ from the page's version before; equal options cause no work."""
    order = W.partitionBy("page_id").orderBy("version")
    all_ = F.struct(*OTHER, *CHEAP)
    return options.withColumn("same", F.lag(all_).over(order).eqNullSafe(all_)).filter("not same").select("page_id", "version")


def started(submissions: DataFrame) -> DataFrame:
    """What submitted options (SUBMISSION) start (STARTED): nothing where they equal the page's last accepted ones, an error where they differ and the page has no image, else a job with the page's
    next number: FULL for the first one or where an option of recognition changed, ONLY_PARAGRAPHS otherwise. A submission with an error leaves the accepted options as they were.

    After a submission with an image its options are the accepted ones either way, so those before a row are those of the last earlier row with an image: one window by page."""
    order = W.partitionBy("page_id").orderBy("version")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    has_image = F.coalesce(F.col("has_image"), F.lit(False))
    own = F.struct(*OTHER, *CHEAP)
    rows = submissions.withColumn("old", F.last(F.when(has_image, own), ignorenulls=True).over(earlier)).filter(~F.col("old").eqNullSafe(own))
    differs = F.col("old").isNull() | ~F.struct(*(F.col(f"old.{c}") for c in OTHER)).eqNullSafe(F.struct(*OTHER))
    job = F.count(F.when(has_image, 1)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")
    mode = F.when(differs, "FULL").otherwise("ONLY_PARAGRAPHS")
    return rows.select("page_id", "version", F.when(has_image, job).alias("job_id"), F.when(has_image, mode).alias("mode"), F.when(~has_image, "no image").alias("error"))
