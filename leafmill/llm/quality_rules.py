"""Quality rules by distribution divergence.

Each document's histogram of character classes and its histogram of the corpus's common words are compared with
references per language by Jensen-Shannon distance. The references come from three passes over all documents: mergeable
frequency summaries give a superset of the words that reach a share of a language's words, the counts of these words and of the character
classes are then summed exactly over the corpus, and the documents are scored. However the documents are split among tasks, the references are the same. A label has a reference of its own from
REF_DOCS documents and REF_WORDS words on; no label, and smaller ones, count in the pooled reference alone. A document is compared
with every reference, its own counts left out of those that hold them, and the nearest counts, so a wrong or null ``lang`` does no harm
and no document passes by likeness to itself. Plain counting rules come beside it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import forget, written

#: Least share of a language's words for a word to be common; counters of a summary, which misses 1 / COUNTERS of the words at most.
SHARE, COUNTERS = 0.001, 4000
#: Words of a reference.
COMMON = 100
#: Least documents and words of a label with a reference of its own.
REF_DOCS, REF_WORDS = 10, 1000
#: Largest distance to the nearest reference, and least words for the comparison to count.
CHAR_LIMIT, WORD_LIMIT = 0.32, 0.42
CHAR_MIN_WORDS, WORD_MIN_WORDS = 50, 200
#: Base rules.
MIN_WORDS, REPEAT_PERCENT = 50, 50

# The symbols counted, and the character classes (lower, upper, digit, space, stop, symbol, other mark, and beyond ASCII
# by first byte: Latin, Greek to Cyrillic, Armenian to Arabic and on, Indic and signs, Far Eastern, others); bytes that continue a character have no class.
SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 7, np.int64)
_CLASS[0xCB:0xD4] = 8
_CLASS[0xD4:0xE0] = 9
_CLASS[0xE0:0xE3] = 10
_CLASS[0xE3:0xF0] = 11
_CLASS[0xF0:] = 12
_CLASS[0x80:0xC0] = -1
_CLASS[:0x80] = 6
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[K.SPACES] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(SYMBOLS)] = 5
N_CLASSES = 13
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _class_counts(block: K.Block) -> np.ndarray:
    kind = _CLASS[block.data]
    row = np.repeat(np.arange(block.n), np.diff(block.offsets))
    use = kind >= 0
    return np.bincount(row[use] * N_CLASSES + kind[use], minlength=block.n * N_CLASSES).reshape(block.n, N_CLASSES)


def _common_kinds(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Place of each word among the common words, which are followed by all others."""
    at = np.searchsorted(common, hashes)
    at[at == len(common)] = 0
    return np.where(common[at] == hashes, at, len(common)) if len(common) else np.zeros(len(hashes), np.int64)


def _cells(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below ``most``) and their counts."""
    if most > max(1 << 16, 4 * len(key)):
        return np.unique(key, return_counts=True)
    count = np.bincount(key, minlength=most)
    at = np.flatnonzero(count)
    return at, count[at]


def _lower(block: K.Block) -> K.Block:
    return block._replace(data=K.LOWER[block.data])


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    return K.column(batch, "lang").cast(pa.string()).fill_null("").to_numpy(zero_copy_only=False)


def _summed(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(value)
    value, count = value[order], count[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(value)), bool), value[1:] != value[:-1]]))
    return value[head], np.add.reduceat(count, head) if len(head) else count


def _bounded(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most COUNTERS words: if there are more, all counts go down by that of the next one, so that each is short by 1 / COUNTERS of the words at most."""
    if len(value) <= COUNTERS:
        return value, count
    count = count - np.partition(count, -COUNTERS - 1)[-COUNTERS - 1]
    return value[count > 0], count[count > 0]


def _candidates(batches):
    """Summaries of this task's words by language; and each language's words and documents, beside a null word."""
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    total: dict[str, int] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        lang = _languages(batch)
        for block in K.blocks(K.column(batch, "text")):
            block = _lower(block)
            words = K.tokens(block)
            codes, names = pd.factorize(lang[block.first : block.first + block.n])
            kind = codes[words.row]
            hashes = K.word_hashes(block, words)
            for code, name in enumerate(names):
                own = hashes[kind == code]
                total[name] = total.get(name, 0) + len(own)
                docs[name] = docs.get(name, 0) + int((codes == code).sum())
                both = _summed(own, np.ones(len(own), np.int64))
                if name in seen:
                    both = _summed(*(np.concatenate(x) for x in zip(seen[name], both, strict=True)))
                seen[name] = _bounded(*both)
    for name, (value, count) in seen.items():
        n = len(value)
        word = pa.array([*K.as_long(value).tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([name] * (n + 1)), word, pa.array([*count.tolist(), total[name]], pa.int64()), pa.array([0] * n + [docs[name]], pa.int64())], ["lang", "word", "n", "docs"])


def _codes(batch: pa.RecordBatch, labels: list[str]) -> np.ndarray:
    """Place of each row's label among ``labels``, -1 for others."""
    return pd.Index(labels, dtype=object).get_indexer(_languages(batch))


def _sums(common: np.ndarray, labels: list[str]):
    size = N_CLASSES + len(common) + 1

    def run(batches):
        total = np.zeros((len(labels) + 1) * size, np.int64)  # other labels last
        for batch in batches:
            codes = _codes(batch, labels)
            for block in K.blocks(K.column(batch, "text")):
                code = codes[block.first : block.first + block.n]
                code = np.where(code < 0, len(labels), code)
                chars = _class_counts(block)
                for c in np.unique(code):
                    total[c * size : c * size + N_CLASSES] += chars[code == c].sum(axis=0)
                block = _lower(block)
                words = K.tokens(block)
                at, n = _cells(code[words.row] * size + N_CLASSES + _common_kinds(K.word_hashes(block, words), common), len(total))
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    return run


def references(docs: DataFrame) -> dict:
    """Reference histograms, from all documents: labels with one of their own, word hashes, and rows of class and word counts: one for each label, and the pooled one last.

    What reaches the driver grows with the labels only: fewer than 2 / SHARE words for each, and their counts for each label."""
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    found = docs.mapInArrow(K.tidy(_candidates), "lang string, word long, n long, docs long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = written(found, "candidates")
    # totals by aggregation: a language's candidate words are never in one task. They have a row for each label, as what reaches the driver does
    of_word = F.when(F.col("word").isNull(), F.col("n"))
    large = found.groupBy("lang").agg(F.max("docs").alias("most"), F.max(of_word).alias("words")).filter((F.trim("lang") != "") & (F.col("most") >= REF_DOCS) & (F.col("words") >= REF_WORDS))
    named = found.join(F.broadcast(large.select("lang", F.lit(True).alias("large"))), "lang", "left").groupBy(F.when(F.col("large"), F.col("lang")).alias("label"), "word").agg(F.sum("n").alias("n"))
    # counts of the summaries are too small by 1 / COUNTERS of the words, no more; so this holds all words of the share, and 1 / (SHARE - 1 / COUNTERS) at most
    totals = named.groupBy("label").agg(F.max(of_word).alias("words")).withColumnRenamed("label", "of")
    often = named.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of")), "left")
    seen = often.filter(F.col("word").isNull() | (F.col("n") >= (SHARE - 1 / COUNTERS) * F.col("words"))).select("label", "word").toArrow()
    forget(found)
    found = seen
    labels = sorted(found["label"].drop_null().unique().to_pylist())
    common = np.unique(found["word"].drop_null().to_numpy().view(np.uint64))
    sums = docs.mapInArrow(K.tidy(_sums(common, labels)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    size = N_CLASSES + len(common) + 1
    table = np.zeros((len(labels) + 1) * size)
    table[sums["at"].to_numpy()] = sums["n"].to_numpy()
    table = table.reshape(len(labels) + 1, size)
    table[-1] = table.sum(axis=0)  # all together
    count = table[:, N_CLASSES:-1]
    first = np.argsort(-count, axis=1, kind="stable")[:, :COMMON]  # ties in order of the hash
    often = np.take_along_axis(count, first, axis=1) >= np.maximum(SHARE * table[:, N_CLASSES:].sum(axis=1, keepdims=True), 1)
    keep = np.unique(first[often])
    rest = table[:, N_CLASSES:].sum(axis=1, keepdims=True) - table[:, N_CLASSES:-1][:, keep].sum(axis=1, keepdims=True)
    return {"labels": labels, "words": common[keep], "chars": table[:, :N_CLASSES], "common": np.hstack([table[:, N_CLASSES:-1][:, keep], rest])}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of p to the distribution q; an all-zero row is at 0."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)
        out = np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    return np.where(p.sum(axis=1) > 0, out, 0.0)


def _held(own: np.ndarray | None, r: int, refs: int, n: int) -> np.ndarray:
    """Whether reference ``r`` holds each row's own counts: that of its label, and the pooled one; none does if ``own`` is None."""
    if own is None:
        return np.zeros(n, bool)
    return (own == r) | (r == refs - 1)


def _nearest_chars(counts: np.ndarray, table: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Distance of each row of counts to the nearest reference; 0 if all are empty."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    best = np.full(len(counts), np.inf)
    for r, ref in enumerate(table):
        left = np.maximum(ref - counts * _held(own, r, len(table), len(counts))[:, None], 0)
        total = left.sum(axis=1)
        best = np.where(total > 0, np.minimum(best, js_distance(p, left / np.maximum(total, 1)[:, None])), best)
    return np.where(np.isfinite(best), best, 0.0)


def _nearest_words(row: np.ndarray, kind: np.ndarray, n: int, table: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """The same of words given by row and kind; only kinds that a row has are visited, all others of a reference count whole."""
    at, count = _cells(row * table.shape[1] + kind, n * table.shape[1])
    row, kind = np.divmod(at, table.shape[1])
    total = np.bincount(row, count, minlength=n)
    p = count / total[row]
    best = np.full(n, np.inf)
    for r, ref in enumerate(table):
        held = _held(own, r, len(table), n)
        left = np.maximum(ref.sum() - total * held, 0)
        q = np.maximum(ref[kind] - count * held[row], 0) / np.maximum(left, 1)[row]
        m = (p + q) / 2
        part = p * np.log2(p / m) + q * np.log2(np.where(q > 0, q, m) / m) - q  # what isn't visited adds 1 less the sum of q
        found = np.sqrt(np.clip((np.bincount(row, part, minlength=n) + 1) / 2, 0, 1))
        best = np.where(left > 0, np.minimum(best, found), best)
    return np.where(np.isfinite(best) & (total > 0), best, 0.0)


def _measure(block: K.Block, ref: dict, own: np.ndarray | None) -> dict[str, np.ndarray]:
    n, data = block.n, block.data
    per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[block.offsets])
    words = K.tokens(block)
    out = {"n_words": np.diff(words.first), "word_chars": per_row(~K.SPACES[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_row(_SYMBOL[data])}
    # lines: within a row, with a word, equal to an earlier one
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, block.offsets[1:]]))
    row = np.repeat(np.arange(n), per_row(data == 10) + 1)
    held = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends, row = starts[held], ends[held], row[held]
    salt = K.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    distinct = np.unique(K.string_hashes(data, starts, ends) ^ salt[row], return_index=True)[1]
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[distinct], minlength=n)
    # words in windows of three that come twice
    hashes = K.word_hashes(block, words)
    at, window = K.window_hashes(hashes, words, 3)
    if len(at):
        _, back, count = np.unique(window ^ salt[words.row[at]], return_inverse=True, return_counts=True)
        hit = K.covered(len(hashes), at[count[back] > 1], 3)
        out["n_repeat_words"] = np.bincount(words.row[hit], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    low = _lower(block)
    out["char_distance"] = _nearest_chars(_class_counts(block), ref["chars"], own)
    out["word_distance"] = _nearest_words(words.row, _common_kinds(K.word_hashes(low, words), ref["words"]), n, ref["common"], own)
    return out


def quality_rules(docs: DataFrame, ref: dict | None = None, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (text, lang; other columns stay, or only those of ``carry``) with the columns of REPORT; ``ref`` as ``references`` gives it of another corpus; if None, it is that of ``docs``, and each document's own counts are left out of it.

    Null and empty texts have no words and fail the base rules. ``kept`` is false too where, with enough words
    (CHAR_MIN_WORDS, WORD_MIN_WORDS), a distance to the nearest reference is above its limit. Columns of ``docs`` named like those added are replaced. Each row
    is judged by itself, so repeated rows and ids have equal results.
    """
    within = ref is None
    ref = references(docs) if within else ref
    added = [x.split()[0] for x in REPORT.split(", ")]
    docs = docs.drop(*added)
    names = docs.columns if carry is None else carry

    def run(batches):
        for batch in batches:
            own = _codes(batch, ref["labels"]) if within else None
            parts = [_measure(b, ref, own[b.first : b.first + b.n] if within else None) for b in K.blocks(K.column(batch, "text"))]
            if not parts:
                continue
            m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            m["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
            far = (m["n_words"] >= CHAR_MIN_WORDS) & (m["char_distance"] > char_limit) | (m["n_words"] >= WORD_MIN_WORDS) & (m["word_distance"] > word_limit)
            m["kept"] = ~m["base_failed"] & ~far
            yield pa.RecordBatch.from_arrays([*(K.column(batch, c) for c in names), *(pa.array(m[k]) for k in added)], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", " + REPORT
    return docs.mapInArrow(K.tidy(run), schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs, carry=["doc_id"])
