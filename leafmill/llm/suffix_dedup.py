"""Suffix dedup by prefix doubling: each byte covered by a 100-byte string that also starts earlier is removed.

Positions are ranked by ever longer prefixes: pairs (rank of the first b bytes, rank of the b bytes after them) are
sorted and ranked anew, b doubles, and a position leaves once its rank is unique, or stays to the threshold.
Over all positions every round would move more than 16 bytes per byte of text, so Spark deals positions to partitions by
the smallest hash of the 16-byte pieces in their 100 bytes: equal strings meet, neighbours travel together as one packed
string, positions whose piece stands nowhere else are unique at the first round, and runs of positions whose whole
packed strings are equal are ranked as one. The doubling rounds run within the partitions on what is left, on bytes and without hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import superkmers as S
from . import textkernel as K

THRESHOLD, PIECE = 100, 16


def _units(block: K.Block):
    rows = np.repeat(np.arange(block.n), np.diff(block.offsets))
    return K.running_bytes(block.data), rows, block.offsets, lambda first, n: (block.data, first, n)


def _ranks(value: np.ndarray, live: np.ndarray, n: int) -> np.ndarray:
    """A number for each live position, the same for equal values; -1 where the value is unique or the position isn't live."""
    out = np.full(n, -1, np.int64)
    _, back, times = np.unique(value, return_inverse=True, return_counts=True)
    out[live] = np.where(times[back] > 1, back, -1)
    return out


def doubled(strings: K.Block, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``threshold`` bytes (within their string) come twice or more, and their rank."""
    n = len(strings.data)
    end = np.repeat(strings.offsets[1:], np.diff(strings.offsets))
    width = 8
    live = np.flatnonzero(np.arange(n) + width <= end)
    wide = np.concatenate([strings.data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words |= wide[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    rank = _ranks(words[live], live, n)
    while width < threshold:
        step = min(width, threshold - width)  # the last pair overlaps
        live = np.flatnonzero((rank >= 0) & (np.arange(n) + width + step <= end))
        live = live[rank[live + step] >= 0]
        rank = _ranks(rank[live] * np.int64(n + 1) + rank[live + step], live, n)
        width += step
    live = np.flatnonzero(rank >= 0)
    return live, rank[live]


def _repeats(strings: K.Block):
    at, rank = doubled(strings)
    row = np.searchsorted(strings.offsets, at, "right") - 1
    return [rank], row, at - strings.offsets[row]


BYTES = S.Source(THRESHOLD, PIECE, _units, _repeats)


def remove_repeated_bytes(docs: DataFrame, bucket_bytes: int = S.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, as byte offsets, end exclusive) and kept (remaining bytes) of each row of ``docs`` (doc_id, an integer, and text).

    A null text is empty. Rows with a null doc_id come first in the order; rows that share a doc_id come in order of a hash of their texts,
    and fully repeated rows are one occurrence: neither removes the other. Other columns are ignored. An empty table gives no rows.
    """
    docs = S.keyed(docs)
    marks = S.repeated_windows(docs, BYTES, bucket_bytes)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            removed, total, spans, kept = [], [], [], []
            for block in K.blocks(S.texts(batch)):
                first, n = (K.column(batch, c).slice(block.first, block.n) for c in ("first", "n"))
                gone = S.covered_units(first, n, block.offsets, THRESHOLD, len(block.data))
                at = block.offsets.tolist()
                removed += np.diff(np.concatenate([[0], np.cumsum(gone)])[block.offsets]).tolist()
                total += np.diff(block.offsets).tolist()
                for a, b in zip(at, at[1:], strict=False):
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).tolist()
                    spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(block.data[a:b][~gone[a:b]].tobytes())
            yield pa.RecordBatch.from_arrays([S.doc_ids(K.column(batch, "doc")), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return S.with_marks(docs, marks).mapInArrow(K.tidy(run), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
