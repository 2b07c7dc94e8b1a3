"""Benchmark decontamination with one Aho-Corasick automaton over word sequences.

The patterns are the 10-word windows of the benchmark texts (a shorter text is one window), over the alphabet of
benchmark words; any other word is the letter 0, which no pattern has. Each task scans its texts once, whatever the
number of patterns, and hits keep the byte offsets of the words in the original text.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

WINDOW = 10
#: Most bytes of benchmark text for one automaton; a larger benchmark is split by item and scanned in several passes.
AUTOMATON_BYTES = 16 << 20

# Bytes that are no part of a word, after lower-casing A-Z.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:0x80] = True
NOT_WORD[ord("0") : ord("9") + 1] = False
NOT_WORD[ord("a") : ord("z") + 1] = False

FOUND = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


def normalised(text: str) -> list[bytes]:
    block = next(iter(K.blocks(pa.array([text]), lower=True)))
    w = K.tokens(block, NOT_WORD)
    raw = block.data.tobytes()
    return [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]


def automaton(items: list[tuple[str, str]], window: int = WINDOW):
    """The automaton and its alphabet (hash of a word to its letter); a pattern's value is its length and its items."""
    letters: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        word = [letters.setdefault(w, len(letters) + 1) for w in normalised(text)]
        for i in range(max(1, len(word) - window + 1) if word else 0):
            patterns.setdefault(tuple(word[i : i + window]), set()).add(item)
    trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, of in patterns.items():
        trie.add_word(key, (len(key), frozenset(of)))
    if patterns:
        trie.make_automaton()
    hashes = np.array([K.hash_text(w.decode()) for w in letters], np.uint64)
    order = np.argsort(hashes)
    return (trie if patterns else None), hashes[order], np.arange(1, len(letters) + 1)[order]


_built: dict[int, tuple] = {}


def _scan(block: K.Block, built: tuple) -> tuple[K.Words, dict[int, tuple[np.ndarray, set[str]]]]:
    """The words, and for each row with a match its hit words and its items."""
    trie, hashes, letters = built
    words = K.tokens(block, NOT_WORD)
    found: dict[int, tuple[np.ndarray, set[str]]] = {}
    if trie is None or not len(words.start):
        return words, found
    own = K.word_hashes(block, words)
    at = np.searchsorted(hashes, own)
    at[at == len(hashes)] = 0
    letter = np.where(hashes[at] == own, letters[at], 0)
    for row in np.flatnonzero(np.bincount(words.row[letter > 0], minlength=block.n)).tolist():
        a, b = words.first[row], words.first[row + 1]
        hit, items = None, set()
        for end, (length, of) in trie.iter(tuple(letter[a:b].tolist())):
            hit = np.zeros(b - a, bool) if hit is None else hit
            hit[end - length + 1 : end + 1] = True
            items |= of
        if hit is not None:
            found[row] = hit, items
    return words, found


def _spans(block: K.Block, row: int, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the original text."""
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    first, last = starts[np.flatnonzero(edge == 1)], ends[np.flatnonzero(edge == -1) - 1]
    base = block.offsets[row]
    points = np.concatenate([[0], np.cumsum((block.data[base : block.offsets[row + 1]] & 0xC0) != 0x80)])
    return [{"start": int(points[a - base]), "end": int(points[b - base])} for a, b in zip(first, last, strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (text; other columns stay, or only those of ``carry``) with the columns of FOUND: words, words inside a benchmark window, the items
    (as strings, sorted) and the merged spans as code points of the original text.

    A null or empty text, or one without words, has no hits; so has every text if the benchmark is empty. Benchmark rows with a null text are
    skipped, a null item_id counts as ''. Items with the same id count once. The benchmark is broadcast only in parts of ``automaton_bytes``; with more
    than one part, hits of the passes are merged. Columns of ``docs`` named like those added are replaced.
    """
    added = [x.split()[0] for x in FOUND.split(", ", 3)]
    docs = docs.drop(*added, "_hit")
    items = benchmark.filter("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").dropDuplicates(["item", "text"])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    # further passes need the texts, the last one doesn't
    names = docs.columns if carry is None or parts > 1 else carry
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", " + FOUND + ", _hit binary"
    out = docs
    for part in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        shared = docs.sparkSession.sparkContext.broadcast(sorted((r.item, r.text) for r in own.collect()))

        def run(batches, shared=shared, part=part):
            key = id(shared.value)
            if key not in _built:
                _built.clear()
                _built[key] = automaton(shared.value, window), shared
            built = _built[key][0]
            for batch in batches:
                old = None if not part else (K.column(batch, "_hit").to_pylist(), K.column(batch, "item_ids").to_pylist())
                n_words, n_hit, ids, spans, bits = [], [], [], [], []
                for block in K.blocks(K.column(batch, "text"), lower=True):
                    words, found = _scan(block, built)
                    for row in range(block.n):
                        a, b = words.first[row], words.first[row + 1]
                        hit, of = found.get(row, (None, set()))
                        if old and old[0][block.first + row]:
                            before = np.unpackbits(np.frombuffer(old[0][block.first + row], np.uint8), count=b - a).astype(bool)
                            hit, of = (before if hit is None else hit | before), of | set(old[1][block.first + row])
                        n_words.append(int(b - a))
                        n_hit.append(0 if hit is None else int(hit.sum()))
                        ids.append(sorted(of))
                        spans.append([] if hit is None else _spans(block, row, words.start[a:b], words.end[a:b], hit))
                        bits.append(None if hit is None or parts == 1 else np.packbits(hit).tobytes())
                span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                yield pa.RecordBatch.from_arrays([*(K.column(batch, c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(span)), pa.array(bits, pa.binary())], [*names, *added, "_hit"])

        out = out.mapInArrow(K.tidy(run), schema)
    return out.select(*(names if carry is None else carry), *added)


def items_digest(ids) -> F.Column:
    return F.sha2(F.array_join(ids, ","), 256)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items_digest("item_ids").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
