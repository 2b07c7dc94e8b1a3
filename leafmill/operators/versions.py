"""What differs between two versions of nested pages: whole pages are compared as structs, null-safe, and only those that differ are taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.hierarchy import LEVELS, WORD, flat_words


def changed_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages (page_id, paragraphs) that are not the same in both: page_id, and the paragraphs of either, null where a page is missing. Nulls equal nulls, at every level; nested values are compared in order.

    Pages that are equal leave in the join itself, so what follows sees the others only."""
    a, b = old.select("page_id", F.col("paragraphs").alias("old")), new.select("page_id", F.col("paragraphs").alias("new"))
    return a.join(b, "page_id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Words (LEVELS) that are new, gone or changed (status) between two versions of flat words, by what they hold (WORD) and their line's box and baseline.

    Both versions are counted against each other as canonical structs, so words equal in all of it leave where they are read; what is left of both sides under one number has changed. Where
    both come from one exchange by page, nothing else is exchanged, and never more than the words of either."""
    held = F.struct(*WORD, "line_box", "line_baseline").alias("held")
    both = old.select(*LEVELS, held, F.lit(1).alias("side")).unionByName(new.select(*LEVELS, held, F.lit(-1).alias("side")))
    left = both.groupBy(*LEVELS, "held").agg(F.sum("side").alias("more")).filter("more <> 0")
    gone, came = (F.sum(F.greatest(F.col("more") * sign, F.lit(0))).alias(n) for n, sign in (("gone", 1), ("came", -1)))
    each = left.groupBy(*LEVELS).agg(gone, came)
    changed = (F.col("gone") > 0) & (F.col("came") > 0)
    status = F.when(changed, "changed").when(F.col("came") > 0, "new").otherwise("gone")
    times = F.when(changed, F.col("gone") * F.col("came")).otherwise(F.col("gone") + F.col("came"))  # words that share a number meet each of the other side's
    return each.select(*LEVELS, F.explode(F.array_repeat(status, times.cast("int"))).alias("status"))


def word_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``changes`` between two versions of nested pages: pages that are equal whole aren't taken apart, pages of one version alone are new or gone whole."""
    pages = changed_pages(old, new)
    words = {side: flat_words(pages.select("page_id", F.col(side).alias("paragraphs"))).select(*LEVELS, *WORD, "line_box", "line_baseline") for side in ("old", "new")}
    return changes(words["old"], words["new"])
