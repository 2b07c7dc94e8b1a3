"""Blurred words over a pixel table (page_id, y, x, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.scalars import bound

BUCKETS = 255


def gradients(pixels: DataFrame, keys: tuple[str, ...] = ("page_id",), keep: tuple[str, ...] = ()) -> DataFrame:
    """pixels with g = half of each 3 x 3 Sobel derivative, signed; borders mirror without repeating the edge. ``keys`` name an image (or a patch of one); columns of ``keep`` stay.

    Rows and columns are windows within an image, so one exchange by its keys serves both.
    """
    row, column = W.partitionBy(*keys, "y").orderBy("x"), W.partitionBy(*keys, "x").orderBy("y")

    def near(c: str, order) -> tuple:
        before, after = F.lag(c).over(order), F.lead(c).over(order)
        return F.coalesce(before, after, F.col(c)), F.coalesce(after, before, F.col(c))

    left, right = near("v", row)
    out = pixels.repartition(*keys).withColumns({"dx": right - left, "sx": left + 2 * F.col("v") + right})
    up, down = near("dx", column)
    over, under = near("sx", column)
    return out.select(*keys, *keep, "y", "x", "v", (0.5 * (up + 2 * F.col("dx") + down) + 0.5 * (under - over)).alias("g"))


def patches(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """The pixels of each word's box and of a border one pixel wide around it, as far as the image goes: all that gradients inside the box depend on. Boxes are dealt to image rows, so the join is an equi-join."""
    rows = cells.filter("box.y2 > box.y1 and box.x2 > box.x1").select("page_id", "cell", "box", F.explode(F.sequence(F.col("box.y1") - 1, F.col("box.y2"))).alias("y"))
    return rows.join(pixels, ["page_id", "y"]).filter("x >= box.x1 - 1 and x <= box.x2").select("page_id", "cell", "box", "y", "x", "v")


def inside(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels within each word's box (half open). Boxes are dealt to image rows first, so the join is an equi-join."""
    rows = cells.select("page_id", "cell", "n_chars", "box", F.explode(F.sequence(F.col("box.y1"), F.col("box.y2") - 1)).alias("y")).filter("box.y2 > box.y1")
    return rows.join(pixels, ["page_id", "y"]).filter("x >= box.x1 and x < box.x2")


def histogram(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of unit buckets over [0, 255); other values fall outside."""
    return values.filter((F.col(value) >= 0) & (F.col(value) < BUCKETS)).groupBy(*keys, F.floor(value).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def quantile_index(counts: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The smallest bucket whose cumulative count is at least q of all; 0 for q = 0."""
    if not 0 <= q <= 1:
        raise ValueError("q must be within 0 and 1")
    each = W.partitionBy(*keys)
    upto = counts.withColumns({"upto": F.sum("n").over(each.orderBy("bucket")), "total": F.sum("n").over(each)})
    at = F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket")))
    return upto.groupBy(*keys).agg((at if q > 0 else F.lit(0)).cast("int").alias("at"))


def quantile_of(counts: F.Column, q: float) -> F.Column:
    """``quantile_index`` of one histogram: an array of (bucket, n), in order of buckets."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x.n)
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("at"))
    step = lambda total: lambda s, x: F.struct((s.upto + x.n).alias("upto"), F.coalesce(s["at"], F.when(s.upto + x.n >= q * total, x.bucket)).alias("at"))
    return bound(total, lambda t: F.aggregate(counts, start, step(t), lambda s: s["at"]))


def measures(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """Each word's char_width, contrast and sharpness (0 without gradients). Gradients are taken on the words' patches alone, so pixels away from words leave before any window; where a patch ends
    inside the image, only gradients of its border are wrong, and they are left out. One exchange brings a word's patch together, for the gradients and for its two
    histograms, which meet as arrays of 255 buckets at most."""
    keys = ["page_id", "cell"]
    part = gradients(patches(cells, pixels), tuple(keys), ("box",)).filter("x >= box.x1 and x < box.x2 and y >= box.y1 and y < box.y2").select(*keys, F.explode(F.array(F.struct(F.lit("v").alias("kind"), F.col("v").cast("double").alias("x")), F.struct(F.lit("g").alias("kind"), F.col("g").cast("double").alias("x")))).alias("p"))
    counts = histogram(part.select(*keys, "p.kind", "p.x"), [*keys, "kind"], "x")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("bucket", "n")))).alias(kind)
    both = counts.groupBy(*keys).agg(of("v"), of("g"))
    side = F.greatest(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1"))
    words = cells.join(both, keys, "left").select(*keys, "box", "g", F.when(F.col("n_chars") > 0, F.nullif(F.floor(side / F.col("n_chars")).cast("int"), F.lit(0))).alias("char_width"), (F.coalesce(quantile_of(F.col("v"), 0.95), F.lit(0)) - F.coalesce(quantile_of(F.col("v"), 0.05), F.lit(0))).alias("contrast"))
    least = F.floor(F.col("contrast") / F.col("char_width"))
    sharp = F.coalesce(quantile_of(F.filter("g", lambda x: x.bucket >= least), 0.85), F.lit(0))
    return words.select(*keys, "box", "char_width", "contrast", sharp.alias("sharpness"))


def flagged(measured: DataFrame, coef: float | F.Column = 0.1) -> DataFrame:
    """``measures`` with blurred: contrast >= char_width * coef * sharpness. The measures don't depend on the coefficient, so another one needs no pixels."""
    coef = coef if isinstance(coef, F.Column) else F.lit(coef)
    return measured.withColumn("blurred", F.col("contrast") >= F.col("char_width") * coef * F.col("sharpness"))


def blurred(cells: DataFrame, pixels: DataFrame, coef: float = 0.1) -> DataFrame:
    """Each word's char_width, contrast, sharpness and whether it is blurred: contrast >= char_width * coef * q85 of its gradients without the background's."""
    return flagged(measures(cells, pixels), coef).drop("box")


def blurred_boxes(words: DataFrame) -> DataFrame:
    """The boxes of each page's blurred words (``flagged``), in order."""
    found = words.filter("blurred").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("cell", "box"))).alias("b"))
    return found.select("page_id", F.transform("b", lambda x: x.box).alias("boxes"))
