"""Vectorised text primitives for use inside Arrow tasks: whole blocks of documents as one byte array.

A block is the UTF-8 bytes of consecutive rows, laid end to end, with row offsets. Everything here works on whole
blocks with numpy; nothing loops over documents or words. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

# The white space of all word rules, 0x20 and 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BYTE = np.random.Generator(np.random.PCG64(20240517)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Block(NamedTuple):
    first: int  #: index of the first row in its batch
    n: int  #: rows
    data: np.ndarray  #: uint8
    offsets: np.ndarray  #: int64, n + 1


class Words(NamedTuple):
    start: np.ndarray  #: byte offsets in the block
    end: np.ndarray
    row: np.ndarray  #: row within the block
    first: np.ndarray  #: index of each row's first word, and the number of words at the end


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string column as blocks of about ``limit`` bytes."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        part = data[offsets[first] : offsets[last]]
        yield Block(first, last - first, LOWER[part] if lower else part, offsets[first : last + 1] - offsets[first])
        first = last


def tokens(block: Block, space: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes that aren't ``space``, within each row."""
    n = len(block.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(block.n + 1, np.int64))
    blank = space[block.data]
    word = ~blank
    cut = block.offsets[:-1][np.diff(block.offsets) > 0]
    begins = word.copy()
    begins[1:] &= blank[:-1]
    begins[cut] |= word[cut]
    ends = word.copy()
    ends[:-1] &= blank[1:]
    last = cut[1:] - 1
    ends[last] |= word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, block.offsets)
    return Words(start, end, np.repeat(np.arange(block.n), np.diff(first)), first)


def joined(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block with one space after each, and where each starts and ends there."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    held = np.ones(len(out), bool)
    held[end] = False
    inside = np.cumsum(np.bincount(words.start, minlength=len(block.data) + 1) - np.bincount(words.end, minlength=len(block.data) + 1))[:-1] > 0
    out[held] = block.data[inside]
    return out, end - size, end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of the base of the running hash, and of its inverse."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(n, BLOCK_BYTES + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse))
            self.n = size
        return self.up[:n], self.down[:n]


_powers = Powers()


_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Places:
    """A random number for each place in a string, by eight bytes."""

    def __init__(self) -> None:
        self.of = np.zeros(0, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.of):
            self.of = mix(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return self.of


_places = Places()


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: every eight bytes go through ``mix`` together with a random number of their place. There are no powers
    of one base, so regular texts (such as Thue-Morse words) don't collide."""
    size = end - start
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))
    out = mix(out ^ eight[start] & _FIRST_BYTES[np.minimum(size, 8)])
    more = np.flatnonzero(size > 8)
    if len(more):
        n = -(-size[more] // 8)
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) - np.repeat(ends - n, n)
        words = eight[np.repeat(start[more], n) + 8 * place]
        words[ends - 1] &= _FIRST_BYTES[size[more] - 8 * (n - 1)]
        words ^= _places.upto(int(n.max()))[place]
        out[more] = mix(out[more] ^ np.add.reduceat(mix(words), ends - n))
    return out


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums that give the hash of any span: see ``span_hash``."""
    up, _ = _powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def running_bytes(data: np.ndarray) -> np.ndarray:
    return running(_BYTE[data])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: equal content and length give equal hashes wherever the span stands. For windows of a few units; long spans of
    regular texts collide, so where a result rests on long spans it is ``string_hashes`` that tells them apart."""
    _, down = _powers.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(block: Block, words: Words) -> np.ndarray:
    return string_hashes(block.data, words.start, words.end)


def window_hashes(hashes: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of k words that lies within a row."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.row[: n - k + 1] == words.row[k - 1 :])
    return at, span_hash(running(hashes), at, at + k)


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed longs."""
    return x.astype(np.uint64).view(np.int64)


def hash_text(text: str) -> int:
    """The hash of one word, as ``word_hashes`` has it."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(string_hashes(data, np.array([0]), np.array([len(data)]))[0])


def covered(n: int, start: np.ndarray, length) -> np.ndarray:
    """Which of n places are covered by the spans of that length (one for all, or one each)."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(np.minimum(start + length, n), minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def release() -> None:
    """Gives freed memory back to the system: Python workers stay for later tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
