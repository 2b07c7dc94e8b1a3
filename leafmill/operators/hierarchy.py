"""Flattening, nesting and cleaning of the page - paragraph - line - word - char hierarchy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.geometry import baseline_from_points, moved_baseline
from leafmill.operators import control_break, nesting

LEVELS = ["page_id", "par_no", "line_no", "word_no"]
WORD = ["box", "baseline", "confidence", "font_size", "content", "char_boxes"]


def nest(words: DataFrame, ordered: bool = False) -> DataFrame:
    """Flat words (LEVELS, WORD, line_box, line_baseline) -> a row per page with paragraphs of lines of words; ordinals stay in the structs.

    One exchange by page and one sort, unless words stand in order already, a page's together (``ordered``), and one pass that cuts them at their levels (``nesting``): a task holds a page.
    """
    if not ordered:
        words = words.repartition("page_id").sortWithinPartitions(*LEVELS, *WORD)
    return nesting.pages(words, ["word_no", *WORD])


def flat_words(pages: DataFrame) -> DataFrame:
    """The words of nested pages, with their line's box; no exchange."""
    pars = pages.select("page_id", F.explode("paragraphs").alias("p"))
    lines = pars.select("page_id", "p.par_no", F.explode("p.lines").alias("l"))
    return lines.select("page_id", "par_no", "l.line_no", F.col("l.box").alias("line_box"), F.col("l.baseline").alias("line_baseline"), F.explode("l.words").alias("w")).select("page_id", "par_no", "line_no", "line_box", "line_baseline", "w.*")


def flat_chars(words: DataFrame, box_at: Callable[[F.Column, F.Column], F.Column] | None = None) -> DataFrame:
    """A row per char box, with its ordinal. ``box_at``: words have no char_boxes but n_chars, and this gives the box of an ordinal, so that no arrays of boxes are made; all in generated code."""
    if box_at is None:
        return words.select(*LEVELS, F.posexplode("char_boxes").alias("char_no", "box"))
    each = words.filter("n_chars > 0").select(*LEVELS, F.col("box").alias("_box"), F.explode(F.sequence(F.lit(0), F.col("n_chars") - 1)).alias("char_no"))
    return each.select(*LEVELS, "char_no", box_at(F.col("char_no"), F.col("_box")).alias("box"))


#: Kinds of blocks that hold no text.
NOT_TEXT = ("FLOWING_IMAGE", "HEADING_IMAGE", "PULLOUT_IMAGE", "HORZ_LINE", "VERT_LINE", "NOISE")


def _text(symbols: DataFrame) -> DataFrame:
    return symbols.filter(~F.col("block_type").isin(*NOT_TEXT))


def symbols_to_words(symbols: DataFrame, boxes: bool = False, dealt: bool = False, ordered: bool = False, lined: bool = False, made: control_break.Made | None = None) -> DataFrame:
    """A stream of recognised symbols -> words: a level begins where its flag is set; blocks that aren't text, words without text and symbols without text vanish. With ``boxes`` words have their chars' boxes, with ``lined`` their line's; ``dealt``: symbols stand by page in their partitions, ``ordered``: and in order. ``made``: ``symbols`` are
    rows from whose batches it makes symbols in order. One sort and one pass (``control_break``)."""
    return control_break.words(symbols if made else _text(symbols), boxes, dealt, ordered, lined, made, NOT_TEXT)


def symbols_to_pages(symbols: DataFrame, dealt: bool = False, ordered: bool = False, made: control_break.Made | None = None) -> DataFrame:
    """A stream of recognised symbols -> nested pages as ``nest`` gives them: the boxes of lines and paragraphs hold their words', a line's baseline runs through its points
    (base_x1, base_y1, base_x2, base_y2 and orientation, if there are such columns; else along its lower edge, and words are nested in the pass that makes them), and words have it moved to their own box. ``made`` as in ``symbols_to_words``."""
    if made or not {"base_x1", "base_y1", "base_x2", "base_y2", "orientation"} <= set(symbols.columns):
        return control_break.pages(symbols if made else _text(symbols), WORD, dealt, ordered, made, NOT_TEXT)
    words = symbols_to_words(symbols, boxes=True, dealt=dealt, ordered=ordered, lined=True)
    words = words.withColumn("box", F.struct(*(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))))
    text = _text(symbols).withColumn("line_no", F.sum(F.col("line_start").cast("int")).over(W.partitionBy("page_id").orderBy("seq")) - 1)
    rows = text.groupBy("page_id", "line_no").agg(*(F.min_by(c, "seq").alias(c) for c in ("base_x1", "base_y1", "base_x2", "base_y2", "orientation")))
    words = words.join(rows, ["page_id", "line_no"])
    base = baseline_from_points(F.col("line_box"), F.col("base_x1"), F.col("base_y1"), F.col("base_x2"), F.col("base_y2"), F.col("orientation"))
    words = words.withColumn("line_baseline", base)
    own = moved_baseline(F.col("line_baseline.x"), F.col("line_baseline.y"), F.col("line_baseline.angle"), F.col("line_box"), F.col("box"))
    return nest(words.withColumn("baseline", own))  # a join leaves no order


def confident(words: DataFrame, least: float) -> DataFrame:
    """Words of at least that confidence; NaN stays."""
    return words.filter(F.col("confidence") >= least)


def left_lines(words: DataFrame) -> DataFrame:
    """Lines that still have a word, with the number of words."""
    return words.groupBy("page_id", "par_no", "line_no").agg(F.count("*").alias("n_words"))


def left_paragraphs(words: DataFrame) -> DataFrame:
    return words.groupBy("page_id", "par_no").agg(F.countDistinct("line_no").alias("n_lines"), F.count("*").alias("n_words"))


def clean_nested(pages: DataFrame, least: float) -> DataFrame:
    """The same clean-up on nested pages: words below ``least`` go, then lines without words, then paragraphs without lines; boxes stay."""
    lines = lambda p: F.filter(F.transform(p.lines, lambda x: x.withField("words", F.filter(x["words"], lambda w: w.confidence >= least))), lambda x: F.size(x["words"]) > 0)
    pars = F.filter(F.transform("paragraphs", lambda p: p.withField("lines", lines(p))), lambda p: F.size(p["lines"]) > 0)
    return pages.withColumn("paragraphs", pars)


def page_text(words: DataFrame) -> DataFrame:
    """The text of each page: words in order, a space after each."""
    ordered = F.array_sort(F.collect_list(F.struct("par_no", "line_no", "word_no", "content")))
    return words.groupBy("page_id").agg(F.concat(F.array_join(F.transform(ordered, lambda w: w.content), " "), F.lit(" ")).alias("text"))
