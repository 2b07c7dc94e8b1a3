"""Geometry of an invisible text layer: pens, advances and stretches of words and glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions.scalars import prec6

#: Pages numbered together by the export.
MANIFEST_RANGE = 10_000

LINE = ["page_id", "par_no", "line_no"]


def placeable(words: DataFrame) -> F.Column:
    """Whether each code point has its char box, so glyphs can be placed one by one."""
    return F.length("content") == F.col("n_chars")


def leveled_lines(words: DataFrame) -> DataFrame:
    """Words (x1.., lx1.., line_y, angle in radians, font_size) with their line's levelled angle, font and start."""
    flat = G.levelled(F.col("angle"), F.col("lx2") - F.col("lx1"))
    out = words.withColumn("flat", flat)
    return out.select("*", F.col("flat.angle").alias("line_angle"), G.font(F.col("font_size"), F.col("flat.grow")).alias("font"), F.col("lx1").cast("double").alias("start_x"), (F.col("ly2") + F.col("line_y") + F.col("flat.lower")).alias("start_y")).drop("flat")


def matrices(lines: DataFrame, page_height: float) -> DataFrame:
    """The text matrix of each line (a, b, c, d) and its start with y upwards."""
    a = -F.col("line_angle")
    return lines.select(*LINE, F.cos(a).alias("a"), F.sin(a).alias("b"), (-F.sin(a)).alias("c"), F.cos(a).alias("d"), F.col("start_x").alias("x"), (page_height - F.col("start_y")).alias("y")).distinct()


def word_pens(words: DataFrame) -> DataFrame:
    """dx, dy from the last word's position (the line's start for the first), turned into the line's direction."""
    order = W.partitionBy(*LINE).orderBy("word_no")
    y = F.col("y2") + F.col("word_y")
    out = words.withColumns({"mx": F.col("x1") - F.coalesce(F.lag("x1").over(order), F.col("start_x")), "my": y - F.coalesce(F.lag(y).over(order), F.col("start_y"))})
    cos, sin = F.cos("line_angle"), F.sin("line_angle")
    return out.withColumns({"dx": F.col("mx") * cos + F.col("my") * sin, "dy": F.col("my") * cos - F.col("mx") * sin}).drop("mx", "my")


def _glyphs(words: DataFrame, *keep: str | F.Column, last: F.Column | None = None) -> DataFrame:
    """``keep`` with a row for each code point of each word, its char_no, and for those of placeable words from (counted from the word's start) and advance: the first glyph starts with the word, others
    with their boxes, and the last ends with the word. ``last`` is the last char_no, if not that of the last code point. Element access in generated code; no function of higher order runs per glyph."""
    n = F.length("content")
    each = words.filter("content <> ''").select(*keep, n.alias("_n"), "content", F.col("x1").alias("_x1"), F.col("x2").alias("_x2"), F.col("char_boxes.x1").alias("_starts"), F.explode(F.sequence(F.lit(0), n - 1 if last is None else last)).alias("char_no"))
    start = F.when(F.col("char_no") == 0, F.col("_x1")).otherwise(F.get("_starts", F.col("char_no")))
    after = F.when(F.col("char_no") == F.col("_n") - 1, F.col("_x2")).otherwise(F.get("_starts", F.col("char_no") + 1))
    names = [c for c in each.columns if not c.startswith("_")]
    return each.select(*names, F.col("_n").alias("n"), (start - F.col("_x1")).alias("from"), (after - start).alias("advance"), F.substring("content", F.col("char_no") + 1, F.lit(1)).alias("text"))


def char_advances(words: DataFrame) -> DataFrame:
    """A row per glyph of placeable words (with char_boxes): from where its box starts to where the next one's does; the first starts with the word, the last ends with it."""
    return _glyphs(words.filter(placeable(words)), *LINE, "word_no", "x1", "font").select(*LINE, "word_no", "char_no", "text", "font", "x1", "advance")


def glyph_pens(words: DataFrame, ascent: float = 0.0) -> DataFrame:
    """The pen of each glyph along its word's turned baseline: x += cos * advance, y += sin * advance, from a word's own row."""
    pen = [F.col("x1").alias("pen_x"), (F.col("y2") + F.col("word_y") + ascent).alias("pen_y"), F.cos("line_angle").alias("cos"), F.sin("line_angle").alias("sin")]
    each = _glyphs(words.filter(placeable(words)), *LINE, "word_no", *pen)
    return each.select(*LINE, "word_no", "char_no", (F.col("pen_x") + F.col("cos") * F.col("from")).alias("x"), (F.col("pen_y") + F.col("sin") * F.col("from")).alias("y"))


def _whole_stretch() -> F.Column:
    """Stretch of a word whose glyphs can't be placed: its baseline's length shared among its code points."""
    n = F.nullif(F.length("content"), F.lit(0))
    return G.stretch(F.hypot(F.col("x2") - F.col("x1"), (F.col("x2") - F.col("x1")) * F.tan("line_angle")) / n, F.col("font"))


def stretches(words: DataFrame) -> DataFrame:
    """Whole-word stretch for words that can't be placed by glyph, with that of their trailing space."""
    return words.filter(~placeable(words)).select(*LINE, "word_no", _whole_stretch().alias("stretch"), (_whole_stretch() * G.SPACE_SHARE).alias("space"))


def text_layer(words: DataFrame, page_height: float = 0.0, digits: bool = True) -> DataFrame:
    """A row per glyph, or per word where glyphs can't be placed (char_no -1), and one for the space after each word (char_no one after the last glyph, or -2): the line's text matrix and start
    (a, b, c, d, line_x, line_y), the word's pen (dx, dy), font, stretch in percent and text, in six decimals or, without ``digits``, unrounded. One window per line and one explode; what belongs to lines and words is
    worked out and rounded before it, and words meet their glyphs in their own row.
    """
    exact = prec6 if digits else lambda x: x
    a = -F.col("line_angle")
    of_word = {"a": F.cos(a), "b": F.sin(a), "c": -F.sin(a), "d": F.cos(a), "line_x": F.col("start_x"), "line_y": page_height - F.col("start_y"), "line_angle": F.col("line_angle"), "dx": F.col("dx"), "dy": F.col("dy"), "font": F.col("font")}
    word = [*LINE, "word_no", *(exact(x).alias(c) for c, x in of_word.items())]
    own = [placeable(words).alias("placed"), _whole_stretch().alias("whole"), F.col("font").alias("size")]
    each = _glyphs(word_pens(words), *word, *own, last=F.when(placeable(words), F.length("content")).otherwise(1))
    placed, space = F.col("placed"), F.col("char_no") == F.when(F.col("placed"), F.col("n")).otherwise(1)
    stretch = F.when(placed & space, 100.0 * G.SPACE_SHARE).when(placed, G.stretch(F.col("advance"), F.col("size"))).when(space, F.col("whole") * G.SPACE_SHARE).otherwise(F.col("whole"))
    text = F.when(space, " ").when(placed, F.col("text")).otherwise(F.col("content"))
    return each.select(*LINE, "word_no", F.when(placed, F.col("char_no")).otherwise(-1 - F.col("char_no")).alias("char_no"), text.alias("text"), *of_word, exact(stretch).alias("stretch"))


def export_manifest(pages: DataFrame, mode: str = "WITH_OCR", stem: str = "scan", form: str = "images", session: str | None = None) -> DataFrame:
    """Names of exported images in page order, without the last page, which is still in progress; with form "pdf" all pages are in one file, page by page.

    ``pages``: page_id, and if there are such columns, has_image and has_result: error then tells what a page lacks for the export. ``session`` names a column: then each session has
    numbers, a last page and a folder of its own (a null session, the folder ""), and comes along. Pages are numbered in three levels of ranges of
    ids, so a task sees a range of pages, or of ranges, or the few ranges of ranges; one session may hold them all.
    """
    part, whole = F.floor(F.col("page_id") / MANIFEST_RANGE), F.floor(F.col("page_id") / MANIFEST_RANGE**2)
    lacks = [F.when(~F.col(c), text) for c, text in (("has_image", "no image"), ("has_result", "no result")) if c in pages.columns and (c == "has_image" or mode != "RAW")]
    own = [] if session is None else ["session"]
    ranged = pages.select("page_id", *([] if session is None else [F.coalesce(F.col(session).cast("string"), F.lit("")).alias("session")]), part.alias("part"), whole.alias("whole"), *([F.coalesce(*lacks).alias("error")] if lacks else []))
    counts = ranged.groupBy(*own, "whole", "part").agg(F.count("*").alias("own"))
    inner = counts.withColumn("inner", F.sum("own").over(W.partitionBy(*own, "whole").orderBy("part")) - F.col("own"))
    outer = counts.groupBy(*own, "whole").agg(F.sum("own").alias("own")).select(*own, "whole", (F.sum("own").over(W.partitionBy(*own).orderBy("whole")) - F.col("own")).alias("outer"), F.sum("own").over(W.partitionBy(*own)).alias("total"))
    before = inner.join(outer, [*own, "whole"]).select(*own, "part", (F.col("inner") + F.col("outer")).alias("before"), "total")
    within = F.row_number().over(W.partitionBy(*own, "part").orderBy("page_id"))
    n = F.col("at") + F.col("before")
    folder = F.lit("") if session is None else F.concat("session", F.lit("/"))
    file = F.concat(folder, F.lit(f"{stem}.pdf")) if form == "pdf" else F.concat(folder, F.lit(f"{stem}-"), n.cast("string"), F.lit(".png"))
    counted = ranged.withColumn("at", within).join(before, [*own, "part"]).filter(n < F.col("total"))
    return counted.select("page_id", *own, file.alias("file"), *([n.alias("file_page")] if form == "pdf" else []), F.lit("source" if mode == "RAW" else "adjusted").alias("image"), F.lit(mode != "RAW").alias("with_text"), *(["error"] if lacks else []))
