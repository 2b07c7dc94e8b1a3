"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), so pairs of all features are weighed
in time linear in the features. It is fitted on a bounded sample of labelled documents (TRAIN_ROWS) and scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .hmm import held_out
from .quality_rules import _class_counts

#: Most labelled documents to fit on, chosen by a hash of their id; their features are a few MB.
TRAIN_ROWS = 6000
WORD_BITS, FACTORS, EPOCHS, RATE, PENALTY, SEED = 15, 8, 8, 0.1, 1e-5, 5
THRESHOLD = 0.3
WORDS = 1 << WORD_BITS
#: Structure statistics and metadata, binned to STEPS levels each: every level is a feature of its own.
STRUCTURE = ["lower", "upper", "digit", "space", "stop", "symbol", "mark", "beyond", "words", "distinct", "word_length", "line_length", "repeat", "dup_lines", "capitals", "chars"]
STEPS = 12
FEATURES = WORDS + len(STRUCTURE) * STEPS


def _structure(block: K.Block, words: K.Words, hashes: np.ndarray) -> np.ndarray:
    """Shares (0 to 1) of each row, in the order of STRUCTURE."""
    n = block.n
    kinds = _class_counts(block)
    kinds = np.hstack([kinds[:, :7], kinds[:, 7:].sum(axis=1, keepdims=True)])
    chars = kinds.sum(1)
    share = kinds / np.maximum(chars, 1)[:, None]
    count = np.diff(words.first)
    salt = K.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    per = lambda keep: np.bincount(words.row[keep], minlength=n)
    distinct = per(np.unique(hashes ^ salt[words.row], return_index=True)[1]) if len(hashes) else np.zeros(n)
    at, window = K.window_hashes(hashes, words, 3)
    _, back, times = np.unique(window ^ salt[words.row[at]], return_inverse=True, return_counts=True)
    repeat = per(at[times[back] > 1]) if len(at) else np.zeros(n)
    breaks = np.flatnonzero(block.data == 10)
    lines = np.bincount(np.searchsorted(block.offsets, breaks, "right") - 1, minlength=n) + 1
    starts = np.unique(np.concatenate([block.offsets[:-1][np.diff(block.offsets) > 0], breaks[breaks + 1 < len(block.data)] + 1])).astype(np.int64)
    ends = np.append(starts[1:], len(block.data))
    row = np.searchsorted(block.offsets, starts, "right") - 1
    line = K.string_hashes(block.data, starts, ends) ^ salt[row]
    once = np.bincount(row[np.unique(line, return_index=True)[1]], minlength=n) if len(starts) else np.zeros(n)
    first = block.data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    capital = per((first >= 65) & (first <= 90))
    log = lambda x, top: np.log1p(x) / np.log1p(top)
    over = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([share, log(count, 20_000), over(distinct, count), log(over(chars, count), 40), log(over(chars, lines), 5000), over(repeat, count), 1 - over(once, lines), over(capital, count), log(chars, 200_000)])


def features(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature, value, and where each row begins. Words weigh log(1 + times), rows of words have length 1."""
    words = K.tokens(block)
    low = block._replace(data=K.LOWER[block.data])
    hashes = K.word_hashes(block, words)
    bucket = (K.word_hashes(low, words) % np.uint64(WORDS)).astype(np.int64)
    pair, times = np.unique(words.row * WORDS + bucket, return_counts=True)
    row, feature, value = pair // WORDS, pair % WORDS, np.log1p(times)
    value = value / np.sqrt(np.maximum(np.bincount(row, value**2, block.n), 1e-12))[row]
    level = np.clip((_structure(block, words, hashes) * STEPS).astype(np.int64), 0, STEPS - 1)
    s = len(STRUCTURE)
    row = np.concatenate([row, np.repeat(np.arange(block.n), s)])
    feature = np.concatenate([feature, (WORDS + np.arange(s) * STEPS + level).ravel()])
    value = np.concatenate([value, np.full(block.n * s, 1 / np.sqrt(s))])
    order = np.argsort(row, kind="stable")
    return feature[order], value[order], np.searchsorted(row[order], np.arange(block.n + 1))


class FM:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, FACTORS))

    def raw(self, feature: np.ndarray, value: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of v_if x_i, of rows that each have a feature."""
        xv = self.v[feature] * value[:, None]
        s = np.add.reduceat(xv, begins[:-1], axis=0)
        pairs = 0.5 * (s**2 - np.add.reduceat(xv**2, begins[:-1], axis=0)).sum(1)
        return self.w0 + np.add.reduceat(self.w[feature] * value, begins[:-1]) + pairs, s

    def score(self, feature: np.ndarray, value: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(feature, value, begins)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, seed: int = SEED) -> FM:
        """Adagrad on the log loss. Without rows of both labels, the score is the share of label 1 (1/2 without rows)."""
        if len(labels) == 0 or labels.min() == labels.max():
            share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
            self.w0, self.v = float(np.log(share / (1 - share))), self.v * 0
            return self
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-6, np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6)
        for _ in range(epochs):
            for pick in np.array_split(rng.permutation(len(labels)), -(-len(labels) // batch)):
                feature, value = (np.concatenate([rows[i][k] for i in pick]) for k in (0, 1))
                begins = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
                raw, s = self.raw(feature, value, begins)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
                of = np.repeat(np.arange(len(pick)), np.diff(begins))
                used, back = np.unique(feature, return_inverse=True)
                e = error[of] * value
                dw = np.bincount(back, e, len(used)) + PENALTY * self.w[used]
                dv = e[:, None] * (s[of] - self.v[feature] * value[:, None])
                dv = np.stack([np.bincount(back, dv[:, f], len(used)) for f in range(FACTORS)], 1) + PENALTY * self.v[used]
                g0 += error.sum() ** 2
                gw[used] += dw**2
                gv[used] += dv**2
                self.w0 -= RATE * error.sum() / np.sqrt(g0)
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
        return self


def _featurise(batches):
    for batch in batches:
        for block in K.blocks(K.column(batch, "text")):
            feature, value, begins = features(block)
            yield pa.RecordBatch.from_arrays([K.column(batch, "label").slice(block.first, block.n), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(feature, pa.int32())), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(value.astype(np.float32)))], ["label", "feature", "value"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality") -> FM:
    """Fitted on at most ``rows`` of the labelled documents outside the held-out fifth, those of the smallest hashes. Null labels and ids don't count;
    of contrary labels of one id the larger does. Rows that are equal in id and text are one, and of ids with many texts no more than ``rows`` texts in all are taken, so what
    reaches the driver is bounded by rows, not by ids."""
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out("doc_id", 5)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    # the ids first, a few thousand longs; then the texts of these alone
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id", "text"])
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows)
    table = texts.mapInArrow(K.tidy(_featurise), "label double, feature array<int>, value array<float>").toArrow()
    label_of = np.array(table["label"].to_pylist(), float)
    pairs = [(np.asarray(f.values, np.int64), np.asarray(v.values, np.float64)) for f, v in zip(table["feature"], table["value"], strict=True)]
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), pairs[i][0][:4].tolist(), float(pairs[i][1].sum())))  # not as tasks end
    return FM().fit([pairs[i] for i in order], label_of[order])


def classify(docs: DataFrame, model: FM, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (text; other columns stay, or only those of ``carry``) with score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold``).

    A null text is scored as the empty one. Columns of ``docs`` named like those added are replaced; the label, lang, source and ids are never looked at.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(shared.value.score(*features(b)) for b in K.blocks(K.column(batch, "text")))])
            yield pa.RecordBatch.from_arrays([*(K.column(batch, c) for c in names), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(K.tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", score double, predicted int")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model, carry=["doc_id"]).select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", "predicted")
