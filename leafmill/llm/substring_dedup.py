"""Substring dedup by super-k-mers: each word covered by a 20-word window that also starts earlier is removed.

The windows of all documents are dealt to buckets by minimiser, as packed super-k-mers. Equal super-k-mers of a task
become one occurrence and marks for the rest; a bucket does the same over tasks, expands the windows of what is left,
sorts them by content and place, and marks all but the first of each content. A minimiser that heads a large share of
the distinct super-k-mers is hot: its windows travel one by one, dealt by their own content, so no bucket grows with it.
The marks, as runs of windows per document, are joined back to the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import superkmers as S
from . import textkernel as K

WINDOW, PIECE = 20, 4


def _normal(block: K.Block, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each; where each begins and ends there."""
    inside = ~K.SPACES[block.data]
    size = words.end - words.start
    begins = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(begins[-1], 0x20, np.uint8)
    out[np.repeat(begins[:-1] - words.start, size) + np.flatnonzero(inside)] = block.data[inside]
    return out, begins[:-1], begins[:-1] + size


def _units(block: K.Block):
    words = K.tokens(block)
    text, begin, end = _normal(block, words)
    return K.running(K.word_hashes(block, words)), words.row, words.first, lambda first, n: (text, begin[first], end[first + n - 1] - begin[first])


def _repeats(strings: K.Block):
    """Windows as two hashes of their words (128 bits), those of a kind only left out."""
    found = []
    for part in range(0, strings.n, 4096):
        at = strings.offsets[part : part + 4097]
        block = K.Block(0, len(at) - 1, strings.data[at[0] : at[-1]], at - at[0])
        words = K.tokens(block)
        start, window = K.window_hashes(K.word_hashes(block, words), words, WINDOW)
        other = K.mix(K.word_hashes(block._replace(data=block.data ^ np.uint8(0x55)), words))
        found.append((window, K.span_hash(K.running(other), start, start + WINDOW), words.row[start] + part, start - words.first[words.row[start]]))
    window, other, row, within = (np.concatenate([f[i] for f in found]) for i in range(4))
    _, back, times = np.unique(window, return_inverse=True, return_counts=True)
    pick = np.flatnonzero(times[back] > 1)
    return [window[pick], other[pick]], row[pick], within[pick]


WORDS = S.Source(WINDOW, PIECE, _units, _repeats)


def remove_repeats(docs: DataFrame, bucket_bytes: int = S.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of each row of ``docs`` (doc_id, an integer, and text).

    A null text has no words. Rows with a null doc_id come first in the order; rows that share a doc_id come in order of a hash of their
    texts, and fully repeated rows are one occurrence: neither removes the other. Other columns are ignored. An empty table gives no rows.
    """
    docs = S.keyed(docs)
    marks = S.repeated_windows(docs, WORDS, bucket_bytes)

    def run(batches):
        for batch in batches:
            removed, total, kept = [], [], []
            for block in K.blocks(S.texts(batch)):
                words = K.tokens(block)
                first, n = (K.column(batch, c).slice(block.first, block.n) for c in ("first", "n"))
                gone = S.covered_units(first, n, words.first, WINDOW, len(words.start))
                text, begin, end = _normal(block, words)
                removed += np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first]).tolist()
                total += np.diff(words.first).tolist()
                left = ~gone
                size = end[left] - begin[left] + 1
                raw = S.gather(text, begin[left], size).tobytes()
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(left)])[words.first]].tolist()
                kept += [raw[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([S.doc_ids(K.column(batch, "doc")), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return S.with_marks(docs, marks).mapInArrow(K.tidy(run), "doc_id long, n_words long, n_removed long, kept_text string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
