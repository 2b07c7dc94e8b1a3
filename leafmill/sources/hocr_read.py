"""hOCR documents read by columns: the tags of many documents at once, by their bytes.

What is read here is nested as ``hocr_text.written`` nests it: one element of a class per level, titles in double quotes, the five named entities of XML in chars. Documents that hold anything else are told apart
(``odd``), never guessed at: Spark's parser reads those.
"""

from __future__ import annotations

import contextlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from leafmill.operators.nesting import EDGES
from leafmill.sources.hocr_text import _entries, _offsets, _runs

#: What can be wrong with a document, its lines, words and chars.
ERRORS = ("malformed", "no body", "line", "word", "char")

#: Bytes of documents that are read at a time, so that their columns stay in the cache.
BLOCK = 4 << 20

_BOX = pa.struct([(e, pa.int32()) for e in EDGES])
_WORD = pa.struct([("word_no", pa.int32()), ("box", _BOX), ("confidence", pa.float64()), ("content", pa.string()), ("char_boxes", pa.list_(_BOX)), ("bad_char", pa.bool_())])
_LINE = pa.struct([("page_no", pa.int32()), ("par_no", pa.int32()), ("line_no", pa.int32()), ("par_box", _BOX), ("box", _BOX), ("slope", pa.float64()), ("line_y", pa.float64()), ("font_size", pa.float64()), ("bad_line", pa.bool_()), ("words", pa.list_(_WORD))])

_OUTLINE = pa.struct([_LINE.field(n) for n in ("page_no", "par_no", "line_no", "par_box", "box")] + [pa.field("n_words", pa.int32())])

#: The same as Spark's types.
LINES, OUTLINE = ArrayType(from_arrow_type(_LINE)), ArrayType(from_arrow_type(_OUTLINE))

_PROLOG = re.compile(
    rb'[ \t\n\x0b\f\r]*(?:<\?xml version="1\.0"(?: encoding="UTF-8")?\?>\s*)?(?:<!DOCTYPE html(?: PUBLIC "[\w/ .-]*" "[\w/:. -]*")?>\s*)?<html(?: xmlns="[\w/:. -]*")?>\s*(?:<head>\s*(?:<title>[^<>&]*</title>\s*)?</head>\s*)?<body>'
)
_ENTITIES = re.compile(rb"(?:[^&]|&(?:amp|lt|gt|quot|apos);)*", re.DOTALL)
_CHAR = b'<span class="ocrx_cinfo" title="'
_BOXED = _CHAR + b"x_bboxes "
#: Levels from pages to words, each with its tag to the title, and if it needs one.
_LEVELS = [(1, b'<div class="ocr_page"', False), (2, b'<div class="ocr_carea"', False), (3, b'<p class="ocr_par"', False), (4, b'<span class="ocr_line"', True), (5, b'<span class="ocrx_word"', True)]
_TITLE = b' title="'
#: Closing tags and the element of each level from the root's -1 on.
_CLOSE = [b"</html>", b"</body>", b"</div>", b"</p>", b"</span>"]
_ELEMENT = np.array([0, 1, 2, 2, 3, 4, 4, 4], np.int8)


def _taken(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Those pieces of the bytes, one by one."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[_runs(starts, sizes)])])


def _of(found: tuple, name: str, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of titles (``_entries``): whether they have the property with so many numbers, and where these start."""
    owner, names, (first, size), _, wrong = found
    last = np.full(len(wrong), -1)
    hit = np.flatnonzero(pc.equal(names, name).to_numpy(zero_copy_only=False))
    last[owner[hit]] = hit
    known = (last >= 0) & ~wrong
    known[known] = size[last[known]] == count
    return known, np.where(known, first[last] if len(first) else 0, 0)


def _values(found: tuple) -> np.ndarray:
    values = found[3].to_numpy(zero_copy_only=False)
    return values if len(values) else np.zeros(1)


def _number(found: tuple, name: str, count: int = 1, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    known, start = _of(found, name, count)
    return known, _values(found)[np.where(known, start + at, 0)]


def _ints(found: tuple, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes (edges by titles), whether there is one, and where a title has four numbers that aren't all ints."""
    known, start = _of(found, name, len(EDGES))
    x = np.trunc(_values(found)[np.where(known, start + np.arange(len(EDGES))[:, None], 0)])
    whole = (np.abs(x) < 2**31).all(0)  # NaN is not
    return np.where(whole, x, 0).astype(np.int32), known & whole, known & ~whole


def _struct(edges: np.ndarray, known: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(e)) for e in edges], fields=list(_BOX), mask=None if known.all() else pa.array(~known))


def _char_boxes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, named: np.ndarray, gone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The boxes of chars from their titles, whether there is one, and the titles that were read as texts. ``named``: titles begin with ``gone`` bytes of a name, and four whole numbers are likely to follow."""
    n = len(starts)
    edges, known = np.zeros((len(EDGES), n), np.int32), np.zeros(n, bool)
    fast = np.flatnonzero(named)
    texts = _taken(data, starts[fast] + gone, np.maximum(sizes[fast] - gone, 0)).cast(pa.string())
    letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if len(fast) and not (letters > 57).any() and not ((letters < 48) & (letters != 32)).any():  # digits and spaces
        parts = pc.split_pattern(texts, " ")
        four = np.diff(_offsets(parts)) == len(EDGES)
        if not four.all():
            fast, parts = fast[four], parts.filter(pa.array(four))
        with contextlib.suppress(pa.ArrowInvalid):  # too large, or two spaces
            edges[:, fast] = pc.cast(parts.flatten(), pa.int32()).to_numpy(zero_copy_only=False).reshape(-1, len(EDGES)).T
            known[fast] = True
    rest = np.flatnonzero(~known)
    if len(rest):
        titles = _taken(data, starts[rest], sizes[rest]).cast(pa.string())
        some = np.flatnonzero(pc.match_substring(titles, "x_bboxes").to_numpy(zero_copy_only=False))  # others have no box
        edges[:, rest] = 0
        if len(some):
            found, own, _ = _ints(_entries(titles.take(pa.array(some))), "x_bboxes")
            edges[:, rest[some]], known[rest[some]] = found, own
    return edges, known, rest


def _places(whole: bytes, data: np.ndarray, byte: int) -> np.ndarray:
    """Where a byte stands."""
    is_it = data == byte
    if np.count_nonzero(is_it) > 1000:
        return np.flatnonzero(is_it)
    found, at, sign = [], whole.find(bytes([byte])), bytes([byte])
    while at >= 0:
        found.append(at)
        at = whole.find(sign, at + 1)
    return np.array(found, np.int64)


def _tags(whole: bytes, data: np.ndarray, low: np.ndarray, high: np.ndarray, docs: np.ndarray) -> tuple:
    """The tags of documents (between ``low`` and ``high``) that have as many < as >: where each begins and ends, where the next begins, and its document. A tag without end ends before it begins."""
    lt = np.flatnonzero(data == 60)
    a, b = (np.searchsorted(lt, x[docs]) for x in (low, high))
    even = np.array([np.count_nonzero(data[low[i] : high[i]] == 62) for i in docs], np.int64) == b - a
    docs, a, n = docs[even], a[even], (b - a)[even]
    left, doc = lt[_runs(a, n)], np.repeat(docs, n)
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    after = np.append(left[1:], 0)[: len(left)]
    after[last] = high[doc[last]]
    right, todo = left - 1, np.arange(len(left))
    for k in (2, 1, 3, 4, 5, 6):  # texts of chars are short
        at = after[todo] - k
        hit = (data[at] == 62) & (at > left[todo])
        right[todo[hit]] = at[hit]
        todo = todo[~hit]
    for j in todo:
        right[j] = whole.find(b">", left[j], after[j])
    return left, right, after, last, doc


def _words(whole: bytes, data: np.ndarray, chars: tuple, of_word: np.ndarray, word: list[np.ndarray]) -> pa.StructArray:
    """Words that have chars, with these."""
    starts, sizes, edges, known = chars
    word_no, word_edges, word_known, conf, conf_known, bad_char = word
    begin, length = starts, sizes.copy()
    lead = data[begin]
    space = (length > 0) & ((lead == 32) | (lead == 9) | (lead == 10) | (lead == 13))
    for i in np.flatnonzero(space & (length > 1)):
        space[i] = not whole[begin[i] : begin[i] + length[i]].strip(b" \t\n\r")
    length[space] = 0  # not read as text
    letters = data[_runs(begin, length)]
    stop = np.concatenate([[0], np.cumsum(length)])[of_word].astype(np.int32)
    content = pa.Array.from_buffers(pa.string(), len(word_no), [None, pa.py_buffer(stop), pa.py_buffer(letters)])
    if (letters == 38).any():
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            content = pc.replace_substring(content, name, sign)
    boxes = pa.ListArray.from_arrays(pa.array(of_word.astype(np.int32)), _struct(edges, known))
    held = np.diff(of_word) > 0
    kept = np.flatnonzero(held)
    return pa.StructArray.from_arrays(
        [
            pa.array(word_no[kept]), _struct(word_edges[:, kept], word_known[kept]), pa.array(conf[kept] / 100, mask=~conf_known[kept]), content.take(pa.array(kept)) if len(kept) < len(word_no) else content,
            boxes.take(pa.array(kept)) if len(kept) < len(word_no) else boxes, pa.array(bad_char[kept]),
        ],
        fields=list(_WORD),
    )


def _read(texts: pa.Array, full: bool = True) -> pa.RecordBatch:
    """odd, error, first (the place in ``ERRORS`` of the first error of words) and lines of documents, with their words or (not ``full``) the number of them."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    raw = memoryview(texts.buffers()[2] or b"")[: offsets[-1]]
    data = np.concatenate([np.frombuffer(raw, np.uint8)[offsets[0] :], np.zeros(64, np.uint8)])
    offsets -= offsets[0]
    whole = data.tobytes()
    low, high = offsets[:-1].copy(), offsets[1:]
    odd = texts.is_null().to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~odd):
        found = _PROLOG.match(whole, int(low[i]), int(high[i]))
        odd[i] = found is None
        low[i] = found.end() if found else low[i]
    malformed = np.zeros(n, bool)

    low_bytes = np.count_nonzero(data[: offsets[-1]] < 32)
    small = _places(whole[: offsets[-1]], data[: offsets[-1]], 10)
    if low_bytes > len(small):
        small = np.flatnonzero(data[: offsets[-1]] < 32)
        byte = data[small]
        bad = (byte != 9) & (byte != 10) & (byte != 13)
        odd[np.searchsorted(offsets, small[bad], "right") - 1] = True
        small = small[~bad]

    left, right, after, last, doc = _tags(whole, data, low, high, np.flatnonzero(~odd))
    uneven = ~odd
    uneven[doc] = False
    odd |= uneven
    odd[doc[right < left]] = True
    first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    if odd[doc].any():
        keep = ~odd[doc]
        left, right, doc, after, last, first = (x[keep] for x in (left, right, doc, after, last, first))
    m = len(left)

    # what the tags are: the level that an opening one begins, the element that a closing one ends
    size = right - left + 1
    closing = data[left + 1] == 47
    slices = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.append(left, after[-1:] if m else [0]).astype(np.int32)), pa.py_buffer(data)])  # each with what stands up to the next
    starts = lambda pattern, some=None: pc.starts_with(slices if some is None else slices.take(pa.array(some)), pattern).to_numpy(zero_copy_only=False)
    level = np.zeros(m, np.int8)
    title = np.zeros(m, np.int32)  # where it begins in the tag; 0 for none
    boxed = starts(_BOXED)
    level[boxed], title[boxed] = 6, len(_CHAR)
    ends = np.full(m, -1, np.int8)
    span = closing & (size == len(_CLOSE[4])) & starts(_CLOSE[4])
    ends[span] = 4
    rest = np.flatnonzero(~boxed & ~span)
    for no, tag in enumerate(_CLOSE[:4]):
        some = rest[closing[rest] & (size[rest] == len(tag))]
        ends[some[starts(tag, some)]] = no
    for no, tag, needed in [*_LEVELS, (6, _CHAR[: -len(_TITLE)], True)]:
        some = rest[starts(tag, rest)]
        titled = starts(tag + _TITLE, some)
        level[some[titled]], title[some[titled]] = no, len(tag + _TITLE)
        if not needed:
            bare = some[~titled & (size[some] == len(tag) + 1)]
            level[bare] = no
    unclosed = (title > 0) & ((data[right - 1] != 34) | (size < title + 2))
    level[unclosed] = 0

    # levels must follow each other; up to the first tag that doesn't fit, what is open is known
    step = np.where(closing, -1, 1)
    depth = np.cumsum(step)
    base = (depth - step)[first]
    depth -= np.repeat(base, np.diff(np.append(np.flatnonzero(first), m)))
    before = depth - step
    element = _ELEMENT[np.clip(before, -1, 6) + 1]
    fits = np.where(closing, (ends == element) & (before >= -1), (level == depth) & (level > 0))
    wrong = np.flatnonzero(~fits)
    text_at, text_size = right + 1, after - right - 1
    loose = np.flatnonzero((text_size > 0) & (level != 6))  # text that is no char's
    one = text_size[loose] == 1
    alone = data[text_at[loose]]
    blank = (alone == 10) | (alone == 32) | (alone == 9) | (alone == 13)
    for i in np.flatnonzero(~one & blank):
        j = loose[i]
        blank[i] = not whole[text_at[j] : after[j]].strip(b" \t\n\r")
    unread = np.zeros(m, bool)
    unread[loose[~blank]] = True
    if len(wrong) or unread.any():
        at = np.flatnonzero(~fits | unread)
        docs, head = np.unique(doc[at], return_index=True)
        at = at[head]
        # an element that is closed by another's tag ends the reading of any parser
        crossed = ~fits[at] & closing[at] & (ends[at] >= 0) & (before[at] >= -1)
        malformed[docs[crossed]] = True
        odd[docs[~crossed]] = True
    open_ = last & (depth > -2)
    malformed[doc[open_ & ~odd[doc]]] = True
    empty = ~odd & ~malformed
    empty[doc] = False
    malformed |= empty  # not even the body is closed

    # titles are plain, and & and what isn't a space or char stands in chars alone
    for pos in (small, _places(whole, data, 38)):
        if len(pos) and m:
            j = np.searchsorted(left, pos, "right") - 1
            owner = np.searchsorted(offsets, pos, "right") - 1
            ours = (j >= 0) & (doc[j] == owner) & (pos >= low[owner])
            odd[owner[ours & (pos <= right[j])]] = True
            if pos is small:
                cr = ours & (data[pos] == 13) & (level[j] == 6) & (text_size[j] > 1)
                odd[owner[cr]] = True
            else:
                odd[owner[ours & (level[j] != 6)]] = True
                for k in np.unique(j[ours & (level[j] == 6) & (pos > right[j])]):
                    if not _ENTITIES.fullmatch(whole, int(text_at[k]), int(after[k])):
                        odd[doc[k]] = True
    titled = np.flatnonzero((title > 0) & ~boxed)
    if len(titled):
        quoted = pc.match_substring(_taken(data, (left + title)[titled], (size - title - 2)[titled]), b'"').to_numpy(zero_copy_only=False)
        odd[doc[titled[quoted]]] = True
    malformed &= ~odd

    fine = ~(odd | malformed)[doc]
    at = lambda no: np.flatnonzero(fine & (level == no))
    page, par, line, word, char = at(1), at(3), at(4), at(5), at(6)
    titles = lambda some: _taken(data, (left + title)[some], (size - title - 2)[some]).cast(pa.string())

    # chars
    edges, known, slow = _char_boxes(data, (left + title)[char], (size - title - 2)[char], boxed[char], len(_BOXED) - len(_CHAR))
    slow = char[slow[boxed[char[slow]]]]
    if len(slow):
        odd[doc[slow[pc.match_substring(titles(slow), '"').to_numpy(zero_copy_only=False)]]] = True
    of_word = np.append(np.searchsorted(char, word), len(char))
    held = np.diff(of_word) > 0
    bad_char = np.add.reduceat(np.append(~known, False), of_word[:-1])[: len(word)] > 0 if len(word) else np.zeros(0, bool)

    # words
    of = _entries(titles(word))
    word_edges, word_known, not_int = _ints(of, "bbox")
    odd[doc[word[not_int & held]]] = True
    conf_known, conf = _number(of, "x_wconf")
    bad_word = ~(word_known & conf_known)
    line_of = np.searchsorted(line, word) - 1
    of_line = np.append(np.searchsorted(word, line), len(word))
    word_no = np.arange(len(word)) - of_line[line_of]

    # lines and their paragraphs
    of = _entries(titles(line))
    line_edges, line_known, not_int = _ints(of, "bbox")
    odd[doc[line[not_int]]] = True
    (based, slope), (_, line_y), (sized, font) = _number(of, "baseline", 2), _number(of, "baseline", 2, 1), _number(of, "x_size")
    bad_line = ~based
    named = title[par] > 0
    own, own_known = np.zeros((len(EDGES), len(par)), np.int32), np.zeros(len(par), bool)
    own[:, named], own_known[named], not_int = _ints(_entries(titles(par[named])), "bbox")
    odd[doc[par[named][not_int]]] = True
    par_of, page_of = np.searchsorted(par, line) - 1, np.searchsorted(page, par) - 1
    line_no = np.arange(len(line)) - np.searchsorted(line, par)[par_of]
    par_no = np.arange(len(par)) - np.searchsorted(par, page)[page_of]
    page_no = np.arange(len(page)) - np.searchsorted(doc[page], doc[page])
    places = [pa.array(page_no[page_of][par_of].astype(np.int32)), pa.array(par_no[par_of].astype(np.int32)), pa.array(line_no.astype(np.int32)), _struct(own[:, par_of], own_known[par_of]), _struct(line_edges, line_known)]
    of_kept = np.concatenate([[0], np.cumsum(held)])[of_line].astype(np.int32)
    if full:
        chars = (text_at[char], text_size[char], edges, known)
        words = _words(whole, data, chars, of_word, [word_no.astype(np.int32), word_edges, word_known, conf, conf_known, bad_char])
        lines = pa.StructArray.from_arrays([*places, pa.array(slope, mask=~based), pa.array(line_y, mask=~based), pa.array(font, mask=~sized), pa.array(bad_line), pa.ListArray.from_arrays(pa.array(of_kept), words)], fields=list(_LINE))
    else:
        lines = pa.StructArray.from_arrays([*places, pa.array(np.diff(of_kept))], fields=list(_OUTLINE))
    of_doc = np.searchsorted(doc[line], np.arange(n + 1)).astype(np.int32)
    code = np.where((bad_line | ~line_known | ~sized)[line_of], 3, np.where(bad_word, 4, np.where(bad_char, 5, 0)))
    hit = np.flatnonzero((code > 0) & held)
    docs, head = np.unique(doc[word[hit]], return_index=True)
    worst = np.zeros(n, np.int32)
    worst[docs] = code[hit[head]]
    unknown = odd | malformed
    error = pa.array(np.where(malformed, ERRORS[0], None), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(odd), error, pa.array(worst, mask=unknown | (worst == 0)), pa.ListArray.from_arrays(pa.array(of_doc, mask=np.append(unknown, False)), lines)], ["odd", "error", "first", "lines"])


def _blocks(texts: pa.Array, full: bool) -> pa.Array:
    texts = texts.cast(pa.string())
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(size) // BLOCK
    heads = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(texts) else [0], len(texts))
    table = pa.Table.from_batches([_read(texts.slice(a, b - a), full) for a, b in zip(heads, heads[1:], strict=False)])
    return pa.StructArray.from_arrays([c.combine_chunks() for c in table.columns], names=table.column_names)


def _document(lines: ArrayType) -> StructType:
    return StructType().add("odd", BooleanType()).add("error", StringType()).add("first", IntegerType()).add("lines", lines)


@F.arrow_udf(_document(LINES))
def _full(texts: pa.Array) -> pa.Array:
    return _blocks(texts, True)


@F.arrow_udf(_document(OUTLINE))
def _thin(texts: pa.Array) -> pa.Array:
    return _blocks(texts, False)


#: Documents as their lines and words, or the numbers of words; or what is wrong with them, or that they are odd. They aren't deterministic to Spark, so that filters aren't pushed below them and they run once.
read, outline = _full.asNondeterministic(), _thin.asNondeterministic()
