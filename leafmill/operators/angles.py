"""Text angles per page: means, the dominant angle on a circle, and the rotation to apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.scalars import near_zero_mod, positive_mod


def average_angle(words: DataFrame) -> DataFrame:
    """The mean angle of a page, weighted by chars; null without chars."""
    return words.groupBy("page_id").agg((F.sum(F.col("n_chars") * F.col("angle")) / F.nullif(F.sum("n_chars"), F.lit(0))).alias("angle"))


def dominant_angle(angles: DataFrame, wrap: float, window: float, key: str = "page_id") -> DataFrame:
    """(key, angle, fraction): the weighted mean angle in the window (e - ``window``, e] of the circle of size ``wrap`` that weighs most, and its share of all weight.

    ``angles``: key, angle, weight. Equal angles are summed first; then sums up to each distinct angle are taken once and looked up
    twice for each window, so the work is in proportion to the distinct angles, however many a window holds. Angles that a window across zero
    takes from the top count as angle - wrap. Ties: windows that don't cross zero, then the smallest end. Without weight both are null.
    """
    at = angles.select(key, positive_mod(F.col("angle"), wrap).alias("a"), F.col("weight").cast("double").alias("w")).groupBy(key, "a").agg(F.sum("w").alias("w"))
    over = at.select(key, "a", "w", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).filter(F.expr(f"copy = 0 or a - {wrap}D > -{window}D"))
    over = over.select(key, (F.col("a") - F.col("copy") * wrap).alias("a"), "w", "copy")
    # sums up to each angle; a window's are those up to its end less those up to where it begins, looked up as of there (what stands on the edge is outside)
    upto = W.partitionBy(key).orderBy("a", F.desc("copy")).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = F.struct(F.sum("w").over(upto).alias("w"), F.sum(F.col("w") * F.col("a")).over(upto).alias("m"), F.sum("copy").over(upto).alias("copies"))
    marks = F.array(F.struct(F.col("a").alias("at"), F.lit(0).alias("asks"), (-F.col("copy")).alias("last")), F.struct((F.col("a") - window).alias("at"), F.lit(1).alias("asks"), F.lit(0).alias("last")))
    asked = over.withColumn("own", sums).select(key, "a", "w", "copy", "own", F.explode(marks).alias("mark")).filter("mark.asks = 0 or copy = 0")
    before = W.partitionBy(key).orderBy("mark").rowsBetween(W.unboundedPreceding, W.currentRow)
    slid = asked.withColumn("begin", F.last(F.when(F.col("mark.asks") == 0, F.col("own")), ignorenulls=True).over(before)).filter("mark.asks = 1")
    less = lambda x: F.col(f"own.{x}") - F.coalesce(F.col(f"begin.{x}"), F.lit(0))
    slid = slid.select(key, "a", "w", less("w").alias("density"), less("m").alias("moment"), (less("copies") > 0).alias("crosses"))
    best = slid.groupBy(key).agg(F.max_by(F.struct("moment", "density"), F.struct("density", ~F.col("crosses"), -F.col("a"))).alias("best"), F.sum("w").alias("total"))
    total = F.nullif(F.col("total"), F.lit(0.0))
    return best.select(key, F.when(total.isNotNull(), F.col("best.moment") / F.nullif(F.col("best.density"), F.lit(0.0))).alias("angle"), (F.col("best.density") / total).alias("fraction"))


def rotation_decision(angles: DataFrame, fix_text: bool = True, text_fraction: float = 0.95, text_diff: float = 5.0, fix_page: bool = True, page_fraction: float = 0.95, page_diff: float = 5.0, window: float = 5.0) -> DataFrame:
    """page_id, dominant_deg, fraction and adjust_deg, the counter-clockwise rotation (degrees) that sets a page right.

    A page whose text runs near a multiple of a right angle is turned by that multiple, and by what is left if text rotation may be fixed too;
    else its text rotation alone counts, on the circle of 90 degrees.
    """
    full = dominant_angle(angles, 360.0, window).withColumnsRenamed({"angle": "a", "fraction": "f"})
    quarter = dominant_angle(angles, 90.0, window).withColumnsRenamed({"angle": "qa", "fraction": "qf"})
    angle = near_zero_mod(F.col("a"), 360.0)
    rest = near_zero_mod(angle, 90.0)
    turned = F.lit(fix_page) & (F.abs(rest) < page_diff) & (F.col("f") > page_fraction)
    also = F.when(F.lit(fix_text) & (F.abs(rest) < text_diff) & (F.col("f") > text_fraction), rest).otherwise(0.0)
    tilt = near_zero_mod(F.col("qa"), 90.0)
    small = F.lit(fix_text) & (F.abs(tilt) < text_diff) & (F.col("qf") > text_fraction)
    return full.join(quarter, "page_id").select("page_id", F.col("a").alias("dominant_deg"), F.col("f").alias("fraction"), F.when(turned, angle - rest + also).when(small, tilt).otherwise(0.0).alias("adjust_deg"))


def mean_of_means(words: DataFrame, value: str) -> DataFrame:
    """The mean over the lines of a paragraph of the mean over their words; 0 without values."""
    return words.groupBy("page_id", "par_no", "line_no").agg(F.avg(value).alias("m")).groupBy("page_id", "par_no").agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean"))


def good_lines(lines: DataFrame, most: float = 2.0) -> DataFrame:
    """``lines`` with good: whether the angle is less than ``most`` from the paragraph's mean angle."""
    mean = F.avg("angle_deg").over(W.partitionBy("page_id", "par_no"))
    return lines.withColumn("good", F.abs(F.col("angle_deg") - mean) < most)
