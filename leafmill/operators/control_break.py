"""Control break: a stream of flagged symbols becomes words in one pass over partitions sorted by page and place.

A level closes where the next one's flag comes or the page ends. Tasks read Arrow batches in the order that one sort left and keep what is still
open, one word and three counters, from batch to batch; nothing is grouped or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.operators import nesting

FLAGS = ["par_start", "line_start", "word_start"]
EDGES = ["x1", "y1", "x2", "y2"]
WORDS = "page_id long, par_no int, line_no int, word_no int, content string, x1 int, y1 int, x2 int, y2 int, confidence double, font_size double, n_chars long"
BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
BOXES = f"char_boxes array<{BOX}>"
LINE_BOX = f"line_box {BOX}"

_NO_PAGE = -(2**63)


def _numbers(column: pa.Array, of: type) -> np.ndarray:
    """A column as numpy has it; null floats are NaN, null flags are off."""
    if of is bool:
        return pc.fill_null(column, False).to_numpy(zero_copy_only=False)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if of is float else pc.fill_null(column.cast(pa.int64()), _NO_PAGE).to_numpy(zero_copy_only=False)


class _Open:
    """Symbols of the word (or line) that the last batch left open, with the page's counters after them."""

    def __init__(self) -> None:
        self.rows: pa.Table | None = None
        self.page: int | None = None
        self.levels = np.zeros(len(FLAGS), np.int64)


def _words(table: pa.Table, page: np.ndarray, levels: list[np.ndarray], heads: np.ndarray, boxes: bool, lines: np.ndarray | None) -> pa.RecordBatch:
    """The words that begin at ``heads``, from symbols that have text; every symbol belongs to one of them. ``lines``: where lines begin, if words are to have their line's box."""
    text = table["text"].combine_chunks().cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    ends = np.append(heads[1:], len(text))
    content = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(np.ascontiguousarray(offsets[np.append(heads, len(text))])), text.buffers()[2])
    edge = {c: _numbers(table[c].combine_chunks(), int) for c in EDGES}
    reduced = [f.reduceat(edge[c], heads).astype(np.int32) for c, f in zip(EDGES, (np.minimum, np.minimum, np.maximum, np.maximum), strict=True)]
    conf, height = (_numbers(table[c].combine_chunks(), float) for c in ("conf", "row_height"))
    known = ~np.isnan(conf)
    n = np.add.reduceat(known.astype(np.int64), heads)
    mean = np.add.reduceat(np.where(known, conf, 0.0), heads) / np.maximum(n, 1)
    font = np.maximum.reduceat(np.where(np.isnan(height), -np.inf, height), heads)
    columns = [
        pa.array(page[heads], mask=page[heads] == _NO_PAGE), *(pa.array(x[heads].astype(np.int32)) for x in levels), content.cast(pa.string()), *map(pa.array, reduced),
        pa.array(mean, mask=n == 0), pa.array(font, mask=np.isinf(font)), pa.array(ends - heads),
    ]
    names = [x.split()[0] for x in WORDS.split(", ")]
    if boxes:
        each = pa.StructArray.from_arrays([table[c].combine_chunks().cast(pa.int32()) for c in EDGES], EDGES)
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(heads, len(text)).astype(np.int32)), each))
        names.append("char_boxes")
    if lines is not None:
        of_line = np.repeat(np.arange(len(lines)), np.diff(np.append(np.searchsorted(heads, lines), len(heads))))
        edges = [f.reduceat(edge[c], lines).astype(np.int32)[of_line] for c, f in zip(EDGES, (np.minimum, np.minimum, np.maximum, np.maximum), strict=True)]
        columns.append(pa.StructArray.from_arrays([pa.array(x) for x in edges], EDGES))
        names.append("line_box")
    return pa.RecordBatch.from_arrays(columns, names)


def _broken(boxes: bool, lined: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = _Open()
        for batch in batches:
            yield from _step(pa.Table.from_batches([batch]), open_, boxes, lined, last=False)
        yield from _step(None, open_, boxes, lined, last=True)

    return run


def _step(new: pa.Table | None, open_: _Open, boxes: bool, lined: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Words that ``new`` closes; with ``lined``, words of lines that it closes. The word (line) that it leaves open, and the numbers of its levels, stay in ``open_``; its symbols bring their numbers along."""
    if new is not None and new.num_rows:
        page = _numbers(new["page_id"].combine_chunks(), int)
        turn = np.flatnonzero(np.diff(page, prepend=page[0] if open_.page is None else open_.page) != 0)
        if open_.page is None:
            turn = np.append(0, turn)
        of_page = np.zeros(len(page), np.int64)
        of_page[turn] = 1
        of_page = np.cumsum(of_page)
        numbered = []
        for i, flag in enumerate(FLAGS):
            total = np.cumsum(_numbers(new[flag].combine_chunks(), bool).astype(np.int64))
            base = np.concatenate([[-open_.levels[i]], np.where(turn > 0, total[turn - 1], 0)])[of_page]
            numbered.append(total - base)
            open_.levels[i] = numbered[-1][-1]
        open_.page = int(page[-1])
        new = new.select(["page_id", "text", *EDGES, "conf", "row_height"])
        for flag, level in zip(FLAGS, numbered, strict=True):
            new = new.append_column(flag, pa.array(level - 1))
        new = new.filter(pc.fill_null(pc.not_equal(new["text"], ""), False))
        both = new if open_.rows is None else pa.concat_tables([open_.rows, new])
    else:
        both = open_.rows
    if both is None or not both.num_rows:
        return
    page = _numbers(both["page_id"].combine_chunks(), int)
    levels = [both[flag].combine_chunks().to_numpy() for flag in FLAGS]
    turned = page[1:] != page[:-1]
    line_turn = np.append(True, turned | (levels[1][1:] != levels[1][:-1]))
    word_turn = np.append(True, turned | (levels[2][1:] != levels[2][:-1]))
    if lined:
        word_turn |= line_turn
    heads, lines = np.flatnonzero(word_turn), np.flatnonzero(line_turn)
    cut = both.num_rows if last else int((lines if lined else heads)[-1])
    open_.rows = None if last else both.slice(cut)
    if cut:
        yield _words(both.slice(0, cut), page[:cut], [x[:cut] for x in levels], heads[heads < cut], boxes, lines[lines < cut] if lined else None)


Made = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _text(made: Made, kinds: tuple[str, ...]) -> Made:
    """``made`` without symbols of blocks of those kinds, or of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in made(batches):
            kind = batch["block_type"]
            kept = pc.and_(kind.is_valid(), pc.invert(pc.is_in(kind, pa.array(kinds, pa.string()))))
            yield batch if pc.all(kept).as_py() else batch.filter(kept)

    return run


def _rows(symbols: DataFrame, dealt: bool, ordered: bool) -> DataFrame:
    rows = symbols.select("page_id", *FLAGS, "text", *(F.col(c).cast("int").alias(c) for c in EDGES), "conf", "row_height", *([] if ordered else ["seq"]))
    rows = rows if dealt or ordered else rows.repartition("page_id")
    return rows if ordered else rows.sortWithinPartitions("page_id", "seq")


def words(symbols: DataFrame, boxes: bool = False, dealt: bool = False, ordered: bool = False, lined: bool = False, made: Made | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Symbols (page_id, seq, FLAGS, text, EDGES, conf, row_height) -> words (WORDS, with ``boxes`` BOXES, and with ``lined`` their LINE_BOX): levels are numbered by their flags within a page, symbols without text
    count for that alone, and words without text vanish. Null flags are off; conf and row_height skip nulls. One exchange by page, unless symbols are ``dealt`` by page already, and one sort by page and seq, unless they stand so (``ordered``).

    With ``made``, ``symbols`` are rows from whose batches that function makes symbols, in order, with their block_type; those of kinds ``without`` are left out. They go on as columns, and never stand as rows of Spark."""
    run = _broken(boxes, lined)
    rows = symbols if made else _rows(symbols, dealt, ordered)
    return rows.mapInArrow(_after(made, without, run), ", ".join([WORDS, *([BOXES] if boxes else []), *([LINE_BOX] if lined else [])]))


def _after(made: Made | None, without: tuple[str, ...], run: Made) -> Made:
    if made is None:
        return run
    text = _text(made, without)
    return lambda batches: run(text(batches))


def _leveled(words: pa.RecordBatch) -> pa.RecordBatch:
    """Words with boxes and baselines as nesting takes them: lines run along their lower edge, and words have that moved to their own box."""
    edges = [words[e] for e in EDGES]
    none = pa.array(np.zeros(words.num_rows))
    y = pc.subtract(words["line_box"].field("y2"), words["y2"]).cast(pa.float64())
    line = lambda y: pa.StructArray.from_arrays([none, y, none], ["x", "y", "angle"])
    made = {"box": pa.StructArray.from_arrays(edges, EDGES), "baseline": line(y), "line_baseline": line(none)}
    kept = {n: words[n] for n in words.schema.names if n not in EDGES}
    return pa.RecordBatch.from_pydict(kept | made)


def pages(symbols: DataFrame, word: list[str], dealt: bool = False, ordered: bool = False, made: Made | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """``words`` with boxes and lines, nested in the same pass: page_id and paragraphs of lines, along their lower edge, of words (word_no and ``word``)."""
    base = "struct<x:double,y:double,angle:double>"
    flat = ", ".join([WORDS, BOXES, LINE_BOX, f"box {BOX}", f"baseline {base}", f"line_baseline {base}"])
    broken = _broken(boxes=True, lined=True)
    nested = nesting.by_page(lambda table: nesting._pages(table, word))
    run = lambda batches: nested(_leveled(b) for b in broken(batches))
    rows = symbols if made else _rows(symbols, dealt, ordered)
    return rows.mapInArrow(_after(made, without, run), nesting.schema(StructType.fromDDL(flat), word))
