"""Super-k-mers: runs of consecutive windows that share a minimiser, packed per bucket.

Windows of ``k`` units (words or bytes) with equal content have the same minimiser, the smallest hash of their ``m``-unit
pieces, so comparing windows within a minimiser's bucket misses nothing; and a run of r windows with one minimiser
travels as one string of r + k - 1 units. What a task has for a bucket travels as one compressed blob.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

#: Bytes of text per bucket, and bytes of packed strings a task gathers before it gives them out.
BUCKET_BYTES, FLUSH_BYTES = 6 << 20, 64 << 20
#: Bytes cut at once: arrays of numbers for each byte stay in a core's cache.
CUT_BLOCK = 256 << 10
#: A minimiser is hot if it heads a large part of a bucket's super-k-mers; so many at most, those with the most (8 MB).
HOT_MOST = 1 << 20

#: Buckets for each group of settled marks.
MARK_SHARE = 4

_LEAST = -(2**63)
MARKS = "doc long, text_hash int, first array<int>, n array<int>"

_TYPES = [np.dtype(x) for x in ("int64", "uint64", "int32", "uint32", "uint8")]
ZSTD_LEVEL = 3


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; numbers go byte by byte of their places, so the high bytes, mostly alike, take little."""
    head = np.array([[_TYPES.index(a.dtype), len(a)] for a in arrays], "<i8")
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(b"".join([np.int64(len(arrays)).tobytes(), head.tobytes(), *planes]))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, size in head.tolist():
        width = _TYPES[kind].itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T).view(_TYPES[kind]).reshape(size))
        at += size * width
    return out


def sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The smallest (np.minimum) or largest (np.maximum) of each ``width`` neighbours."""
    out, w = values, 1
    while 2 * w <= width:
        out = best(out[:-w], out[w:])
        w *= 2
    rest = width - w
    return best(out[: len(out) - rest], out[rest:]) if rest else out


class Runs(NamedTuple):
    """Super-k-mers of a block, in order: first window and number of windows, and the minimiser."""

    first: np.ndarray
    count: np.ndarray
    minimiser: np.ndarray
    twice: np.ndarray  #: whether the minimiser may stand in it more than once, so that a window may come again within it


def runs(sums: np.ndarray, row: np.ndarray, k: int, m: int) -> Runs:
    """``sums``: running hash over the units; ``row``: the row of each unit."""
    n = len(row)
    start = np.flatnonzero(row[: n - k + 1] == row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    if not len(start):
        return Runs(start, start, start.astype(np.uint64), start.astype(bool))
    at = np.arange(n - m + 1)
    own, width = K.span_hash(sums, at, at + m), k - m + 1
    every = sliding(np.minimum, own, width)
    least = every[start]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    begin, count = start[first], np.diff(np.concatenate([first, [len(start)]]))
    # pieces that are the least of some window, and pairs of equal ones in one window
    edge = np.zeros(width - 1, np.uint64)
    led = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, every, edge]), width) == own)
    pair = np.flatnonzero((own[led[1:]] == own[led[:-1]]) & (led[1:] - led[:-1] < width))
    touched = np.zeros(len(begin) + 1, np.int64)
    np.add.at(touched, np.maximum(np.searchsorted(begin, led[pair + 1] - width + 1, "right") - 1, 0), 1)
    np.add.at(touched, np.searchsorted(begin, led[pair], "right"), -1)
    return Runs(begin, count, least[first], (np.cumsum(touched[:-1]) > 0) | (count > width))


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of ``data``, end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(start - (ends - size), size) + np.arange(total)]


class Source(NamedTuple):
    """What the windows of one kind of unit need."""

    k: int  #: units of a window
    m: int  #: units of a minimiser
    units: Callable  #: block -> running hash of its units, row of each, first unit of each row, and spans(first, units) -> (bytes, start, size)
    repeats: Callable  #: block of strings -> the content of each window as comparable numbers (a list of arrays), its row, its place in it


class Cut(NamedTuple):
    doc: np.ndarray
    text_hash: np.ndarray
    first: np.ndarray  #: first window, counted in its document
    count: np.ndarray  #: windows
    key: np.ndarray  #: minimiser
    twice: np.ndarray  #: whether a window may come again within it
    content: np.ndarray  #: hash of the whole string
    size: np.ndarray  #: its bytes
    text: np.ndarray  #: the strings, end to end


def cut(source: Source, batches, hot: np.ndarray | None = None, texts: bool = True):
    """The super-k-mers of a task, block by block."""
    for batch in batches:
        doc = K.column(batch, "doc").to_numpy(zero_copy_only=False)
        th = (K.column(batch, "text_hash").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        for block in K.blocks(K.column(batch, "text"), limit=CUT_BLOCK):
            sums, rows, heads, spans = source.units(block)
            first, count, key, twice = runs(sums, rows, source.k, source.m)
            if hot is not None and len(hot) and len(key):
                at = np.searchsorted(hot, key)
                at[at == len(hot)] = 0
                single = hot[at] == key
                if single.any():  # a record for each window, dealt by the window itself
                    n = count[single]
                    alone = np.repeat(first[single] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    first = np.concatenate([first[~single], alone])
                    count = np.concatenate([count[~single], np.ones(len(alone), np.int64)])
                    twice = np.concatenate([twice[~single], np.zeros(len(alone), bool)])
                    key = np.concatenate([key[~single], K.span_hash(sums, alone, alone + source.k)])
            if len(first):
                row = rows[first]
                length = count + source.k - 1
                text, size = np.zeros(0, np.uint8), np.zeros(len(first), np.int64)
                if texts:
                    data, start, size = spans(first, length)
                    text = gather(data, start, size)
                content = _contents(text, size) if texts else K.span_hash(sums, first, first + length)  # without texts, only to count
                yield Cut(doc[row + block.first], th[row + block.first], first - heads[row], count, key, twice.astype(np.uint8), content, size, text)


def _hot(source: Source, least: int):
    """Minimisers that head ``least`` of a task's distinct super-k-mers or more."""

    def run(batches):
        parts = [np.unique(np.stack([c.key, c.content]), axis=1) for c in cut(source, batches, texts=False)]
        if not parts:
            return
        value, count = np.unique(np.unique(np.concatenate(parts, axis=1), axis=1)[0], return_counts=True)
        big = count >= least
        yield pa.RecordBatch.from_arrays([pa.array(K.as_long(value[big])), pa.array(count[big], pa.int64())], ["key", "n"])

    return run


def _flush(parts: list[Cut], buckets: int):
    doc, th, at, count, key, twice, content, size, text = (np.concatenate([p[i] for p in parts]) for i in range(9))
    where = np.cumsum(size) - size
    first, later = _once(content, doc, th, at)
    bucket = (K.mix(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
    first = first[np.lexsort((content[first], key[first], bucket[first]))]
    key = (key >> np.uint64(32)).astype(np.uint32)
    i32 = lambda x: x.astype(np.int32)

    def blob(b: int, f: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        made = packed(doc[f], th[f], i32(at[f]), i32(count[f]), key[f], twice[f], i32(size[f]), gather(text, where[f], size[f]), doc[t], th[t], i32(at[t]), i32(count[t]))
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([made], pa.binary())], ["bucket", "blob"])

    none = first[:0]
    for b, f in _by(bucket[first], first):
        yield blob(b, f, none)
    # marks are settled here, so they go by document to groups of their own (below 0): a passage of very many documents burdens no bucket
    for b, t in _by((K.mix(doc[later].view(np.uint64)) % np.uint64(-(-buckets // MARK_SHARE))).astype(np.int64), later):
        yield blob(-1 - b, none, t)


def _by(kind: np.ndarray, rows: np.ndarray):
    """Rows by kind, in their order."""
    order = np.argsort(kind, kind="stable")
    kind, rows = kind[order], rows[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(kind)), bool), kind[1:] != kind[:-1]]))
    for a, b in zip(head, np.append(head[1:], len(kind)), strict=False):
        yield int(kind[a]), rows[a:b]


def _once(content: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each content, and those later; a repeated row has the same doc, text hash and place and is the same occurrence, so neither."""
    order = np.lexsort((at, th, doc, *more, content))
    new = np.ones(len(order), bool)
    new[1:] = content[order[1:]] != content[order[:-1]]
    for x in more:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    same = (doc[order] == doc[lead]) & (th[order] == th[lead]) & (at[order] == at[lead])
    return order[new], order[~same]


def _deal(source: Source, hot: np.ndarray, buckets: int):
    """Blobs of distinct super-k-mers by bucket, and of the places of the others, as marks."""

    def run(batches):
        parts, held = [], 0
        for part in cut(source, batches, hot):
            parts.append(part)
            held += len(part.text)
            if held > FLUSH_BYTES:
                yield from _flush(parts, buckets)
                parts, held = [], 0
        if parts:
            yield from _flush(parts, buckets)

    return run


def _find(source: Source):
    """A bucket's marks: for each document the runs of windows that start earlier too. A group of marks alone is only joined."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [unpacked(b.as_py()) for b in table["blob"]]
        doc, th, at, count, key, twice, size, text = (np.concatenate([b[i] for b in blobs]) for i in range(8))
        marks = [tuple(np.concatenate([b[i] for b in blobs]) for i in range(8, 12))]
        del blobs
        size = size.astype(np.int64)
        content = _contents(text, size)
        first, later = _once(content, doc, th, at)
        marks.append((doc[later], th[later], at[later], count[later]))
        # windows in a super-k-mer whose minimiser stands in no other one, nor twice in it, can't repeat
        _, back, times = np.unique(key[first], return_inverse=True, return_counts=True)
        own = np.sort(first[(times[back] > 1) | (twice[first] > 0)])
        if len(own):
            where = np.cumsum(size) - size
            block = Block(0, len(own), gather(text, where[own], size[own]), np.concatenate([[0], np.cumsum(size[own])]))
            contents, row, within = source.repeats(block)
            place, of = at[own[row]] + within, own[row]
            _, hit = _once(contents[0], doc[of], th[of], place, *contents[1:])
            marks.append((doc[of[hit]], th[of[hit]], place[hit].astype(np.int32), np.ones(len(hit), np.int32)))
        out = _joined(*(np.concatenate([m[i] for m in marks]) for i in range(4)))
        del text, marks
        K.release()
        return out

    return run


def _contents(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each string of a bucket."""
    ends = np.cumsum(size)
    out = [np.zeros(0, np.uint64)]
    for part in np.array_split(np.arange(len(size)), max(1, len(text) // K.BLOCK_BYTES)):
        if len(part):
            a, b = ends[part[0]] - size[part[0]], ends[part[-1]]
            out.append(K.string_hashes(text[a:b], ends[part] - size[part] - a, ends[part] - a))
    return np.concatenate(out)


def _joined(doc, th, at, count) -> pa.Table:
    """A row per document, with its runs of windows; neighbours are joined."""
    order = np.lexsort((at, th, doc))
    doc, th, at, count = doc[order], th[order], at[order].astype(np.int64), count[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (at[1:] != at[:-1] + count[:-1])
    head = np.flatnonzero(new)
    total = np.add.reduceat(count, head) if len(head) else count
    doc, th, at = doc[head], th[head], at[head].astype(np.int32)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    head = np.flatnonzero(new)
    ends = pa.array(np.append(head, len(doc)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at, total)]
    return pa.table([pa.array(doc[head]), pa.array(th[head].view(np.int32)), *lists], ["doc", "text_hash", "first", "n"])


Block = K.Block


def row_key(doc_id: str) -> F.Column:
    """An id as a long that is never null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST))


def keyed(docs: DataFrame) -> DataFrame:
    """doc and text_hash, which tell documents apart even where ids are null or repeated, and the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(row_key("doc_id").alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def half(text_hash) -> F.Column:
    """The upper half of a text hash, which is what travels with the strings: it only has to tell texts of one id apart."""
    return F.shiftright(text_hash, 32).cast("int").alias("text_hash")


def doc_ids(doc: pa.Array) -> pa.Array:
    values = doc.to_numpy(zero_copy_only=False)
    return pa.array(values, pa.int64(), mask=values == _LEAST)


def repeated_windows(docs: DataFrame, source: Source, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` as ``keyed`` gives it -> rows of MARKS: for documents with windows that start earlier too, all runs of such windows (first window, windows)."""
    total, tasks = docs.select(F.octet_length("text").alias("n"), F.spark_partition_id().alias("task")).agg(F.sum("n"), F.max("task") + 1).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    # what heads ``most`` of all super-k-mers has that share of it in some task, and half of it at least in those that report it
    most = max(1000, bucket_bytes // 100)
    least = max(2, most // (2 * (tasks or 1)))
    hot = docs.mapInArrow(K.tidy(_hot(source, least)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= most / 2).orderBy(F.desc("n"), "key").limit(HOT_MOST)
    hot = np.sort(hot.select("key").toArrow()["key"].to_numpy().view(np.uint64))
    # partitions in proportion to the buckets, so a task's share doesn't grow with the input
    dealt = docs.mapInArrow(K.tidy(_deal(source, hot, buckets)), "bucket long, blob binary").repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets), "bucket")
    found = dealt.groupBy("bucket").applyInArrow(_find(source), MARKS)
    return found.groupBy("doc", "text_hash").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("n")).alias("n"))


def _zip(batches):
    squeeze = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress
    for batch in batches:
        text = [squeeze(x.as_buffer()) for x in K.column(batch, "text")]
        yield pa.RecordBatch.from_arrays([K.column(batch, "doc"), K.column(batch, "text_hash"), pa.array(text, pa.binary())], ["doc", "text_hash", "text"])


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc, text (compressed, as it travels; see ``texts``), first and n; no marks are null lists."""
    travelling = docs.select("doc", half("text_hash"), "text").mapInArrow(K.tidy(_zip), "doc long, text_hash int, text binary")
    return travelling.join(marks, ["doc", "text_hash"], "left").select("doc", "text", "first", "n")


def texts(batch: pa.RecordBatch) -> pa.Array:
    whole = zstandard.ZstdDecompressor().decompress
    return pa.array([whole(x.as_buffer()) for x in K.column(batch, "text")], pa.large_binary())


def covered_units(first: pa.ListArray, n: pa.ListArray, heads: np.ndarray, k: int, units: int) -> np.ndarray:
    """Which units the marked windows of a block's rows cover; ``heads``: first unit of each row."""
    size = first.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = first.flatten().to_numpy() + np.repeat(heads[: len(size)], size)
    return K.covered(units, start, n.flatten().to_numpy() + k - 1)
