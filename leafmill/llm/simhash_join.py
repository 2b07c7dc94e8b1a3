"""SimHash near-dedup with a hierarchical index in Gray order.

An upper node of the index is a masked bit pattern: a mask and the bits under it that all its fingerprints share. The nodes on top have masks of a fifth
of the bits each, so fingerprints that differ in MOST bits share the whole pattern of one of them; a node that holds too many
fingerprints is parted by masks of fifths of its free bits, which again share one. Spark deals fingerprints to these nodes. Below them a task sorts
fingerprints by Gray rank, so that neighbours share long patterns, and factors what neighbours share into nodes level by level. Every
fingerprint descends from its top node; each step adds the differences under the bits that the child has more than its parent, and a child
with more than MOST goes with all that is below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import components
from .shared import forget, written

SHINGLE, SEED, MOST = 4, 42, 4
#: Children of a node, fingerprints of a top node before it is parted and how often it may be (what is left is joined in its task all the same), fingerprints of a task.
FAN, NODE_ROWS, LEVELS, BUCKET_ROWS = 8, 16_384, 3, 8_192
#: Hashes turned to bits at once, and pairs of a fingerprint and a node expanded at once.
BITS_AT_ONCE, PAIRS_AT_ONCE = 1 << 15, 1 << 16

_ALL = np.uint64(2**64 - 1)
_LINKS = "a long, b long"


def _shingles(words: K.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each shingle, and its row; a row with fewer words is one shingle."""
    n = np.diff(words.first)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + words.first[row]
    return first, np.minimum(first + k, words.first[row + 1]) - 1, row


def _print_block(block: K.Block) -> np.ndarray:
    """The fingerprints of a block's rows."""
    words = K.tokens(block)
    counts, total = np.zeros((block.n, 64), np.int64), np.zeros(block.n, np.int64)
    if len(words.start):
        data, start, end = K.joined(block, words)
        first, last, row = _shingles(words, SHINGLE)
        text, digest = data.tobytes(), xxhash.xxh64_intdigest
        for at in range(0, len(row), BITS_AT_ONCE):
            part = slice(at, at + BITS_AT_ONCE)
            hashes = np.array([digest(text[a:b], SEED) for a, b in zip(start[first[part]].tolist(), end[last[part]].tolist(), strict=True)], "<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.diff(row[part], prepend=-1))
            counts[row[part][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        total = np.bincount(row, minlength=block.n)
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_print_block(b) for b in K.blocks(K.column(batch, "text"), lower=True)]
        if found:
            yield pa.RecordBatch.from_arrays([K.column(batch, "doc_id"), pa.array(K.as_long(np.concatenate(found)))], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (64 bits as a long) of each row of ``docs`` (doc_id, text): a bit is set if it is in over half of the text's shingles, repeats included."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(K.tidy(_printed), "doc_id long, print long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class Level(NamedTuple):
    pattern: np.ndarray
    mask: np.ndarray  #: bits that all below share
    more: np.ndarray  #: those that the parent doesn't have
    child: np.ndarray  #: index of the first child, and the number of children at the end
    last: np.ndarray  #: index of the last fingerprint below


def hierarchy(prints: np.ndarray, top: np.ndarray) -> list[Level]:
    """The index over fingerprints in Gray order within top nodes (``top``, their numbers, ascending): levels from the fingerprints upwards to one node for each top node."""
    n = len(prints)
    pattern, mask, last = prints, np.full(n, _ALL), np.arange(n)
    levels, child = [], np.arange(n + 1)
    while True:
        heads = np.flatnonzero(np.diff(top, prepend=-1))
        if len(heads) == len(top):
            levels.append(Level(pattern, mask, mask, child, last))
            return levels
        place = np.arange(len(top)) - np.repeat(heads, np.diff(np.append(heads, len(top))))
        first = np.flatnonzero((place % FAN) == 0)
        size = np.diff(np.append(first, len(top)))
        own = np.repeat(pattern[first], size)
        shared = np.bitwise_and.reduceat(mask, first) & ~np.bitwise_or.reduceat(pattern ^ own, first)
        levels.append(Level(pattern, mask, mask & ~np.repeat(shared, size), child, last))
        child = np.append(first, len(top))
        pattern, mask, top, last = pattern[first] & shared, shared, top[first], last[child[1:] - 1]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the smallest index of each component) after the links a - b."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def linked(prints: np.ndarray, top: np.ndarray, most: int = MOST) -> np.ndarray:
    """For each fingerprint (in Gray order within top nodes) the smallest index that it is linked with inside its top node, over any number of links.

    Nodes whose fingerprints all belong to the component of the one that descends go at once, so a group of near copies costs little more than its size.
    """
    n = len(prints)
    root = np.arange(n)
    near = np.flatnonzero((top[1:] == top[:-1]) & (np.bitwise_count(prints[1:] ^ prints[:-1]) <= most))
    root = _merge(root, near, near + 1)
    levels = hierarchy(prints, top)
    number = np.repeat(np.arange(len(levels[-1].child) - 1), np.diff(np.append(np.flatnonzero(np.diff(top, prepend=-1)), n))) if n else root
    for begin in range(0, n, PAIRS_AT_ONCE):
        of = np.arange(begin, min(begin + PAIRS_AT_ONCE, n))
        whole = []
        for level in levels:  # the component of all below, or -1
            if level is levels[0]:
                whole.append(root)
                continue
            low, high = (f.reduceat(whole[-1], level.child[:-1]) for f in (np.minimum, np.maximum))
            whole.append(np.where(low == high, low, -1))
        stack = [(len(levels) - 1, of, number[of], np.zeros(len(of), np.uint8))]
        while stack:
            height, who, node, sum_ = stack.pop()
            if height == 0:
                root = _merge(root, who, node)
                continue
            if len(who) > PAIRS_AT_ONCE:
                half = len(who) // 2
                stack += [(height, who[half:], node[half:], sum_[half:]), (height, who[:half], node[:half], sum_[:half])]
                continue
            level, below = levels[height], levels[height - 1]
            size = level.child[node + 1] - level.child[node]
            ends = np.cumsum(size)
            child = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - level.child[node], size)
            who, sum_ = np.repeat(who, size), np.repeat(sum_, size)
            later = (below.last[child] > who) & (whole[height - 1][child] != root[who])
            child, who, sum_ = child[later], who[later], sum_[later]
            sum_ = sum_ + np.bitwise_count((prints[who] ^ below.pattern[child]) & below.more[child])
            some = sum_ <= most
            if some.any():
                stack.append((height - 1, who[some], child[some], sum_[some]))
    return root


def _bucket_links(table: pa.Table) -> pa.Table:
    """Links that connect what is connected inside the top nodes of a bucket; one for each fingerprint at most."""
    mask, pattern, prints = (table[c].to_numpy().view(np.uint64) for c in ("mask", "pattern", "print"))
    order = np.lexsort((gray_rank(prints), pattern, mask))
    mask, pattern, prints = mask[order], pattern[order], prints[order]
    top = np.concatenate([[0], np.cumsum((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))]) if len(prints) else np.zeros(0, np.int64)
    root = linked(prints, top)
    other = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": K.as_long(prints[other]), "b": K.as_long(prints[root[other]])})


def _parts(mask: int, most: int = MOST) -> list[int]:
    """Masks of the ``most`` + 1 nearly equal parts of the bits that ``mask`` lacks, each with ``mask``."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [len(free) * i // (most + 1) for i in range(most + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >> 63 else mask


def dealt(prints: DataFrame, node_rows: int = NODE_ROWS, levels: int = LEVELS) -> DataFrame:
    """Distinct fingerprints (print) with the top nodes (mask, pattern) that they belong to. Nodes of more than ``node_rows`` are parted, ``levels`` deep at most."""
    masks, rows, done = [0], prints.select("print", F.lit(0).cast("long").alias("mask")), None
    for level in range(levels):
        longs = lambda values: F.array(*(F.lit(_signed(v)).cast("long") for v in values))
        parts = F.create_map(*(x for m in masks for x in (F.lit(_signed(m)).cast("long"), longs(_parts(m)))))
        masks = [p for m in masks for p in _parts(m)]
        rows = rows.select("print", F.explode(F.element_at(parts, F.col("mask"))).alias("mask")).withColumn("pattern", F.col("print").bitwiseAND(F.col("mask")))
        hot = rows.groupBy("mask", "pattern").count().filter(F.col("count") > node_rows).select("mask", "pattern")
        last = level == levels - 1 or hot.isEmpty()
        if not last:
            hot = written(hot, "nodes")
        keep = rows if last else rows.join(hot, ["mask", "pattern"], "left_anti")
        done = keep if done is None else done.unionByName(keep)
        if last:
            return done
        rows = rows.join(hot, ["mask", "pattern"], "left_semi").select("print", "mask")
    return done


def components_of(prints: DataFrame, node_rows: int = NODE_ROWS, levels: int = LEVELS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(node, root) of the distinct fingerprints (print) that are linked with another: root is the smallest of their component, as a signed number. Written."""
    rows = dealt(prints, node_rows, levels)
    buckets = max(1, -(-rows.count() // bucket_rows))
    links = rows.withColumn("bucket", F.pmod(F.xxhash64("mask", "pattern"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(_bucket_links, _LINKS)
    links = written(links, "links")
    found = components(links)
    forget(links)
    return found


def near_duplicates(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, print and component_id of each row of ``docs`` (doc_id, an integer, and text; other columns are ignored).

    Words are lower-cased in A-Z; a text with fewer than SHINGLE words is one shingle, one without words, empty or null has the fingerprint zero and is linked like any other.
    Rows are linked if their fingerprints differ in MOST bits at most; component_id is the smallest doc_id of all that are reachable, nulls apart (null if there is
    no other). Repeated rows and rows that share a doc_id are rows of their own. An empty table gives no rows. Equal fingerprints are joined by aggregation before the
    index sees them. ``bounds``: node_rows, levels and bucket_rows, as the constants.
    """
    sketch = written(fingerprints(docs), "prints")
    each = written(sketch.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components_of(each.select("print"), **bounds)
    labelled = each.join(roots.select(F.col("node").alias("print"), "root"), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "root").select("print", "component_id")
    return sketch.join(named, "print").select("doc_id", "print", "component_id")


def op12_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
