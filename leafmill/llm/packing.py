"""Best-fit packing by sum of squares.

Documents become token ids with an end id, only those above the length limit are cut, and the pieces are dealt at
random to shards of some 100,000 pieces. A shard places each piece where the sum over gaps of the squared number of
open sequences with that gap becomes smallest, so no gap piles up that later pieces can't fill. A shard leaves a
handful of part-filled sequences at most, so the number of shards, which grows with the pieces, costs next to nothing.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import textkernel as K

LENGTH = 2048
END_ID = 0
SHARD_PIECES = 100_000
#: Units whose ids a Python worker remembers; beyond that it starts anew.
CACHE_UNITS = 1_000_000
#: New units are merged into the sorted ones when they are this share of them.
MERGE_SHARE = 0.25
TOKEN_BLOCK = 2 << 20
#: Units that are encoded as one text.
JOINED = 512

# The pre-tokeniser's pattern that the units below are cut for. Classes of bytes: white space, letter, digit, apostrophe, other ASCII, beyond ASCII.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KIND = np.full(256, 4, np.uint8)
_KIND[K.SPACES] = 0
_KIND[ord("a") : ord("z") + 1] = _KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("'")] = 3
_KIND[0x80:] = 5
#: Whether the pattern always parts a byte of one class from a next one of another: ASCII letters from digits and marks, digits from all; an apostrophe stays with what follows.
_PARTS = np.zeros((6, 6), bool)
_PARTS[1, 2:5] = _PARTS[2, 1:5] = _PARTS[4, 1:3] = _PARTS[3, 2] = True


def units(block: K.Block) -> K.Words:
    """Parts of words between which no token reaches, by SPLIT_PATTERN."""
    kind = _KIND[block.data]
    word = kind > 0
    begins = word.copy()
    begins[1:] &= ~word[:-1] | _PARTS.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    cut = block.offsets[:-1][np.diff(block.offsets) > 0]
    begins[cut] |= word[cut]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, block.offsets)
    return K.Words(start, end, np.repeat(np.arange(block.n), np.diff(first)), first)


class WordIds:
    """Ids of texts by way of their units, each encoded once per worker: the tokenizer never joins characters across ASCII white space nor, if it
    splits by SPLIT_PATTERN, across the ends of ``units``; with another one, or in a block with a special token's text, words are the units."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path) as f:
            form = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"].encode() for t in form.get("added_tokens") or []]
        self.fine = SPLIT_PATTERN in json.dumps(form.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\") and "Lowercase" in json.dumps(form.get("normalizer"))
        mark = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.reset()

    def reset(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.tables = [none, none]  # the merged ones, and the latest: hashes in order, place of the ids, how many
        self.parts: list[np.ndarray] = []
        self.ids, self.n = np.zeros(0, np.uint32), 0

    def one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *encoded]), np.array([len(e) for e in encoded], np.int64)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, end to end, and how many each has. Many are encoded as one, with a digit of its own between them; those with a digit alone."""
        if self.mark is None or not self.fine:
            return self.one_by_one(texts)
        plain = [i for i, t in enumerate(texts) if not any(map(str.isdigit, t))]
        rest = sorted(set(range(len(texts))) - set(plain))
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        whole = self.tokenizer.encode_batch_fast([" 0 ".join(texts[i] for i in g) for g in groups], add_special_tokens=False)
        ids, size, order = [], [], []
        for g, e in zip(groups, whole, strict=True):
            found = np.array(e.ids, np.uint32)
            at = np.flatnonzero(found == self.mark)
            if len(at) == len(g) - 1:
                size.append(np.diff(np.concatenate([[-1], at, [len(found)]])) - 1)
                ids.append(np.delete(found, at))
            else:  # an id that isn't the mark's alone
                one, n = self.one_by_one([texts[i] for i in g])
                ids.append(one)
                size.append(n)
            order += g
        one, n = self.one_by_one([texts[i] for i in rest])
        ids, size, order = np.concatenate([*ids, one]), np.concatenate([*size, n]), np.array(order + rest, np.int64)
        begin = np.cumsum(size) - size
        back = np.argsort(order)
        return ids[spans(begin[back], size[back])], size[back]

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """``hashes`` in order, of ``texts``."""
        ids, size = self.encoded(texts)
        at = self.n + np.cumsum(size) - size
        self.parts.append(ids)
        self.n += len(ids)
        merge = lambda a, b: tuple(np.concatenate(x) for x in zip(a, b, strict=True))
        in_order = lambda t: tuple(x[o] for o in [np.argsort(t[0])] for x in t)
        self.tables[1] = in_order(merge(self.tables[1], (hashes, at, size)))
        if len(self.tables[1][0]) > MERGE_SHARE * len(self.tables[0][0]):
            self.tables = [in_order(merge(*self.tables)), tuple(x[:0] for x in self.tables[1])]
        self.ids = np.concatenate([self.ids, *self.parts])
        self.parts = []

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each; -1 where a hash isn't known."""
        at, size = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, place, n in self.tables:
            if len(known):
                i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[i] == hashes
                at[hit], size[hit] = place[i[hit]], n[i[hit]]
        return at, size

    def encode(self, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's rows, end to end, and where each row begins."""
        raw = block.data.tobytes()
        fine = self.fine and not any(t in raw for t in self.special)
        words = units(block) if fine else K.tokens(block)
        data = block.data
        if fine:  # units of ASCII alone are the same in lower case
            data = K.LOWER[data]
            other = np.concatenate([[0], np.cumsum(block.data >= 0x80)])
            keep = other[words.end] > other[words.start]
            at = spans(words.start[keep], words.end[keep] - words.start[keep])
            data[at] = block.data[at]
            raw = data.tobytes()
        hashes = K.string_hashes(data, words.start, words.end)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        first = order[new]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        distinct = hashes[first]
        if sum(len(t[0]) for t in self.tables) > CACHE_UNITS:
            self.reset()
        at, size = self.find(distinct)
        if (at < 0).any():
            some = first[at < 0]
            self.learn(distinct[at < 0], [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[some].tolist(), words.end[some].tolist(), strict=True)])
            at, size = self.find(distinct)
        at, size = at[back], size[back]
        ids = self.ids[spans(at, size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[words.first]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans, end to end."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece: the document's key, piece, start, length, ids_crc32 and, if asked for, the ids.

    A null text counts as empty; an empty text is one piece that holds the end id alone. Rows with equal keys are packed as they are.
    """
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(key, "text")

    def run(batches):
        own = encoder(tokenizer)
        for batch in batches:
            keys = K.column(batch, key)
            for block in K.blocks(K.column(batch, "text"), limit=TOKEN_BLOCK):
                ids, begins = own.encode(block)
                ids = np.insert(ids, begins[1:], END_ID).astype("<u4")
                begins = begins + np.arange(block.n + 1)
                size = np.diff(begins)
                pieces = -(-size // length)
                row = np.repeat(np.arange(block.n), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * length
                long = np.minimum(length, size[row] - start)
                ends = np.concatenate([[0], np.cumsum(long)]).tolist()
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                columns = [keys.take(pa.array(row + block.first)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(long, pa.int64()), pa.array(crc, pa.int64())]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns + lists, [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.mapInArrow(K.tidy(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed in the given order.

    Of the open sequences with room, one is taken whose gap makes the sum of squares smallest; ties go to the smallest gap. A sequence is opened
    only where none has room: with all pieces at hand, longest first, that packs tighter than opening one for the sum's sake.
    """
    open_at: list[list[int]] = [[] for _ in range(length + 1)]  # sequences by gap
    count = np.zeros(length + 1, np.int64)
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        after = 2 * count[: length - s + 1] + 1
        after[0] = 0  # a full sequence has no gap
        change = np.where(count[s : length + 1] > 0, after - 2 * count[s : length + 1] + 1, 1 << 60)
        best = int(change.argmin())
        if change[best] < 1 << 60:
            gap = best + s
            b = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = length, made, made + 1
        sequence[i], offset[i] = b, length - gap
        if gap > s:
            open_at[gap - s].append(b)
            count[gap - s] += 1
    return sequence, offset


def pack(pieces: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES, key: str = "doc_id") -> DataFrame:
    """``pieces`` (length; other columns stay) with sequence_id and offset: each piece's place, gapless from 0 in its sequence.

    Within a shard longer pieces come first; ties are in order of key and piece. No rows give no rows. The pieces are
    checkpointed once, so that counting them does not tokenise them again, with a number for each row, so that rows of one key are dealt to all shards. Columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def place(shard, table):
        table = table.select(names)
        table = table.sort_by([("length", "descending"), (key, "ascending"), ("piece", "ascending")])
        sequence, offset = sum_of_squares(table["length"].to_numpy(), length)
        return table.append_column("sequence_id", pa.array(sequence + (shard[0].as_py() << 40))).append_column("offset", pa.array(offset))

    pieces = pieces.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.select(*names, F.pmod(F.xxhash64(key, "piece", "_row"), F.lit(shards)).alias("_shard"))
    return dealt.groupBy("_shard").applyInArrow(place, schema)


def sequences(pieces_with_ids: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, pieces joined in order of offset."""
    both = pieces_with_ids.select(key, "piece", "ids").join(placed.select(key, "piece", "sequence_id", "offset"), [key, "piece"])
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)).alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    from .shared import checkpoint_dir

    checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, tokenizer_path()))
