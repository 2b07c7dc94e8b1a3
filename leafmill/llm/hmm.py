"""LM scoring with a hidden Markov model.

Every training token is counted over the whole corpus. The states of the model emit classes: the most
frequent words are classes of their own, as many as the square root of the vocabulary (within CLASS_WORDS), other words fall into SHAPES classes by length and last byte, and within such
a class a word has its smoothed share of the class's training tokens. Baum-Welch counts come from all training documents, whole, are
summed across partitions, and give the next parameters; the scaled forward recursion then gives the exact likelihood of
whole texts. Counts of the HEAVY most frequent words reach the tasks by broadcast (so many words at most); those of all other words by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import written

STATES, ROUNDS, SEED = 8, 3, 11
#: Least and most words with a class of their own; classes of the others.
CLASS_WORDS, SHAPES = (1000, 8000), 64
HEAVY = 300_000
#: Baum-Welch reads training texts whole up to so many tokens, longer ones in pieces of that size, of which the first alone counts as a start; scoring doesn't cut.
TRAIN_TOKENS = 1_000_000
#: Tokens, with padding, that it holds at once; a longer text is alone.
TOGETHER = 200_000
ALPHA = 0.1  # of the base score, and of words within a class
_MASK = np.uint64(SHAPES - 1)


def word_keys(block: K.Block) -> tuple[K.Words, np.ndarray]:
    """A key for each word: 58 bits of its hash and 6 bits of its shape."""
    words = K.tokens(block)
    if not len(words.start):
        return words, np.zeros(0, np.int64)
    length = np.minimum(words.end - words.start - 1, 7).astype(np.uint64)
    last = block.data[words.end - 1].astype(np.uint64) & np.uint64(7)
    return words, K.as_long(K.word_hashes(block, words) & ~_MASK | length << np.uint64(3) | last)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    key = np.concatenate([k for k, _ in parts])
    value, back = np.unique(key, return_inverse=True)
    return [(value, np.bincount(back, np.concatenate([n for _, n in parts]), len(value)).astype(np.int64))]


def _count(batches):
    parts, held = [], 0
    for batch in batches:
        for block in K.blocks(K.column(batch, "text"), lower=True):
            parts.append(np.unique(word_keys(block)[1], return_counts=True))
            held += len(parts[-1][0])
            if held > 4_000_000:
                parts = _merged(parts)
                held = len(parts[0][0])
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["key", "n"])
                    parts, held = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(parts)[0]], ["key", "n"])


def held_out(doc_id, folds: int = 10) -> F.Column:
    """Whether crc32 of the id as text has remainder 0; a null id is that of an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


class Vocabulary:
    """What tasks need of the counts: totals, and the most frequent words with count and class."""

    def __init__(self, counts: DataFrame, documents: int, heavy: int = HEAVY) -> None:
        totals = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
        self.n = (totals.n or 0) + documents
        self.v = totals.v + (documents > 0)
        self.end = documents
        self.class_words = min(max(CLASS_WORDS[0], int(totals.v**0.5)), CLASS_WORDS[1])
        shapes = counts.groupBy((F.col("key").bitwiseAND(SHAPES - 1)).alias("s")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).toArrow()
        top = counts.orderBy(F.desc("n"), "key").limit(heavy).toArrow().sort_by([("n", "descending"), ("key", "ascending")])
        key, n = top["key"].to_numpy(), top["n"].to_numpy()
        order = np.argsort(key)
        rank = np.arange(len(key))
        shape = (key & (SHAPES - 1)).astype(np.int64)
        own = rank < self.class_words
        cls = np.where(own, rank, self.class_words + shape)
        self.key, self.count, self.cls = key[order], n[order].astype(np.int64), cls[order].astype(np.int16)
        self.shape_n, self.shape_v = np.zeros(SHAPES), np.zeros(SHAPES)
        self.shape_n[shapes["s"].to_numpy()], self.shape_v[shapes["s"].to_numpy()] = shapes["n"].to_numpy(), shapes["v"].to_numpy()
        np.subtract.at(self.shape_n, shape[own], n[own])
        np.subtract.at(self.shape_v, shape[own], 1)
        self.class_counts = np.concatenate([np.zeros(self.class_words), self.shape_n, [documents]])
        self.class_counts[: own.sum()] = n[own]

    def base(self, c):
        return np.log10((c + ALPHA) / (self.n + ALPHA * (self.v + 1)))

    def rare(self, c, shape):
        return np.log10((c + ALPHA) / (self.shape_n[shape] + ALPHA * (self.shape_v[shape] + 1)))


def _encode(shared):
    """Texts as classes, with the sums over their heavy words; the keys of other words go along."""

    def run(batches):
        vocab: Vocabulary = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for block in K.blocks(K.column(batch, "text"), lower=True):
                words, key = word_keys(block)
                at = np.searchsorted(vocab.key, key)
                at[at == len(vocab.key)] = 0
                known = vocab.key[at] == key if len(vocab.key) else np.zeros(len(key), bool)
                shape = key & (SHAPES - 1)
                cls = np.where(known, vocab.cls[at] if len(vocab.key) else 0, vocab.class_words + shape).astype(np.int16)
                c = np.where(known, vocab.count[at] if len(vocab.key) else 0, 0)
                base = np.where(known, vocab.base(c), 0.0)
                rare = np.where(known & (cls >= vocab.class_words), vocab.rare(c, shape), 0.0)
                add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words.first])
                tail, tail_at = key[~known], np.concatenate([[0], np.cumsum(~known)])[words.first]
                classes = np.insert(cls, words.first[1:], np.int16(vocab.class_words + SHAPES))
                ends = words.first + np.arange(block.n + 1)
                out[0] += np.diff(ends).tolist()
                out[1] += [classes[a:b].astype("<i2").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                out[2] += (add(known.astype(np.int64)) + (vocab.end > 0)).tolist()
                out[3] += (np.bincount(words.row, base, block.n) + vocab.base(vocab.end)).tolist()
                out[4] += np.bincount(words.row, rare, block.n).tolist()
                out[5] += [tail[a:b] for a, b in zip(tail_at, tail_at[1:], strict=False)]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
            names = ["n_tokens", "classes", "known", "base", "rare", "tail"]
            yield pa.RecordBatch.from_arrays([*(K.column(batch, x) for x in ("rid", "doc_id", "held_out")), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["rid", "doc_id", "held_out", *names])

    return run


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, class_counts: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed)
        emit = (class_counts + 1) * rng.uniform(0.5, 1.5, (states, len(class_counts)))
        move = rng.uniform(0.5, 1.5, (states, states))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, counts: np.ndarray, states: int = STATES) -> Model:
        start = counts[:states] + 0.1
        move = counts[states : states + states**2].reshape(states, states) + 0.1
        emit = counts[states + states**2 :].reshape(states, -1) + 0.01
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts by place and text, longest first; how many have each place."""
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), size.max()), np.int16)
    out[np.arange(size.max()) < size[:, None]] = np.concatenate(texts)
    return np.ascontiguousarray(out.T), np.searchsorted(-size, -np.arange(size.max()), "left")


def log10_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Scaled forward recursion over whole texts, all of them side by side."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out = np.zeros(len(texts))
    emit = np.ascontiguousarray(model.emit.T)
    group: list[int] = []
    groups = []
    for i in order:  # texts of like length together, so padding stays small
        if group and (len(texts[i]) < 0.5 * len(texts[group[0]]) or len(group) * len(texts[group[0]]) > 2_000_000):
            groups.append(group)
            group = []
        group.append(i)
    for group in [*groups, group] if group else groups:
        obs, live = _padded([texts[i] for i in group])
        a = model.start * emit[obs[0]]
        total = np.zeros(len(group))
        for t in range(len(obs)):
            n = live[t]
            if t:
                a = (a[:n] @ model.move) * emit[obs[t, :n]]
            scale = a.sum(1)
            a /= scale[:, None]
            total[:n] += np.log10(scale)
        out[group] = total
    return out


def expected_counts(model: Model, texts: list[np.ndarray], begins: list[bool] | None = None) -> np.ndarray:
    """Baum-Welch counts of start, moves and emissions over texts of at least a token, side by side; ``begins``: whether each is the begin of its text (all, if None)."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    head = np.ones(len(texts)) if begins is None else np.array([begins[i] for i in order], float)
    texts = [texts[i] for i in order]
    obs, live = _padded(texts)
    T, n, k = len(obs), len(texts), len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    alpha = np.zeros((T, n, k))
    scale = np.ones((T, n))
    a = model.start * emit[obs[0]]
    for t in range(T):
        m = live[t]
        if t:
            a = (alpha[t - 1, :m] @ model.move) * emit[obs[t, :m]]
        scale[t, :m] = a.sum(1)
        alpha[t, :m] = a / scale[t, :m, None]
    beta = np.ones((n, k))
    move = np.zeros((k, k))
    for t in range(T - 1, 0, -1):
        m = live[t]
        eb = emit[obs[t, :m]] * beta[:m] / scale[t, :m, None]
        move += alpha[t - 1, :m].T @ eb
        alpha[t, :m] *= beta[:m]  # now the posterior
        beta[:m] = eb @ model.move.T
    alpha[0] *= beta
    flat = (np.arange(T)[:, None] * 0 + obs).ravel()
    c = model.emit.shape[1]
    counts = np.stack([np.bincount(flat, alpha[:, :, j].ravel(), c) for j in range(k)])
    return np.concatenate([head @ alpha[0], (move * model.move).ravel(), counts.ravel()])


def long_counts(model: Model, text: np.ndarray, piece: int) -> np.ndarray:
    """``expected_counts`` of one text, ``piece`` tokens at a time: the forward pass keeps what it has at each edge, the backward pass takes the pieces from the last to the first, forward once more within each, and carries
    its own values over the edges. Memory is a piece's."""
    k = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)

    def forward(a, obs, alpha=None, scale=None):
        for t, o in enumerate(obs.tolist()):
            a = (model.start if a is None else a @ model.move) * emit[o]
            total = a.sum()
            a = a / total
            if alpha is not None:
                alpha[t], scale[t] = a, total
        return a

    pieces = [text[i : i + piece] for i in range(0, len(text), piece)]
    before: list[np.ndarray | None] = [None]
    for obs in pieces[:-1]:
        before.append(forward(before[-1], obs))
    beta, move, emitted = np.ones(k), np.zeros((k, k)), np.zeros((k, model.emit.shape[1]))
    for obs, a in zip(reversed(pieces), reversed(before), strict=True):
        alpha, scale = np.zeros((len(obs), k)), np.ones(len(obs))
        forward(a, obs, alpha, scale)
        for t in range(len(obs) - 1, -1, -1):
            eb = emit[obs[t]] * beta / scale[t]
            last = alpha[t - 1] if t else a
            if last is not None:
                move += np.outer(last, eb)
            alpha[t] = alpha[t] * beta  # now the posterior
            beta = model.move @ eb
        for j in range(k):
            emitted[j] += np.bincount(obs, alpha[:, j], emitted.shape[1])
    return np.concatenate([alpha[0], (move * model.move).ravel(), emitted.ravel()])


def _expect(shared):
    def run(batches):
        model: Model = shared.value
        total, pieces, held = None, [], 0

        def add():
            nonlocal total
            pieces.sort(key=lambda p: -len(p[0]))
            at = 0
            while at < len(pieces):  # texts of like length together, so that padding stays small
                most = len(pieces[at][0])
                n = max(1, TOGETHER // most)
                few = next((i for i in range(at + n // 8 + 1, min(at + n, len(pieces))) if len(pieces[i][0]) < 0.7 * most), at + n)
                part = expected_counts(model, *zip(*pieces[at:few], strict=True))
                total = part if total is None else total + part
                at = few

        for batch in batches:
            for raw in K.column(batch, "classes"):
                text = np.frombuffer(raw.as_buffer(), "<i2")
                if len(text) > TRAIN_TOKENS:
                    part = long_counts(model, text, TRAIN_TOKENS)
                    total = part if total is None else total + part
                    continue
                pieces.append((text, True))
                held += len(text)
                if held > 10 * TOGETHER:
                    add()
                    pieces, held = [], 0
        if pieces:
            add()
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "x"])

    return run


def train(encoded: DataFrame, first: Model, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of ``encoded`` (classes); without rows the first model stays."""
    model, states = first, len(first.start)
    sc = encoded.sparkSession.sparkContext
    for _ in range(rounds):
        sums = encoded.select("classes").mapInArrow(K.tidy(_expect(sc.broadcast(model))), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        if len(sums):
            counts = np.zeros(states + states**2 + first.emit.size)
            counts[sums["at"].to_numpy()] = sums["x"].to_numpy()
            model = Model.of_counts(counts, states)
    return model


def _likelihood(shared):
    def run(batches):
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), "<i2") for x in K.column(batch, "classes")]
            rest = [i for i, x in enumerate(batch.schema.names) if x != "classes"]
            out = log10_likelihood(shared.value, texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(out)], [*(batch.schema.names[i] for i in rest), "forward"])

    return run


def score(docs: DataFrame, folds: int = 10, rounds: int = ROUNDS, heavy: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    A null text is empty: its end is its only token. Repeated rows are scored, and counted in training, as often as they come. Without training rows every
    token is unknown and the model stays as it began. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", held_out("doc_id", folds).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.filter("not held_out")
    counts = written(known.select("text").mapInArrow(K.tidy(_count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "tokens")
    vocab = Vocabulary(counts, known.count(), heavy)
    shared = spark.sparkContext.broadcast(vocab)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, classes binary, known long, base double, rare double, tail array<long>"
    encoded = written(docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(K.tidy(_encode(shared)), schema), "encoded")
    model = train(encoded.filter("not held_out"), Model.first(vocab.class_counts), rounds)

    # words beyond the heavy ones: their counts by a join
    tail = encoded.select("rid", F.explode("tail").alias("key")).groupBy("rid", "key").agg(F.count("*").alias("times"))
    light = tail.join(counts, "key", "left").select("rid", "times", F.coalesce("n", F.lit(0)).alias("c"), F.col("key").bitwiseAND(SHAPES - 1).cast("int").alias("shape"))
    below = F.element_at(F.array(*(F.lit(float(x)) for x in vocab.shape_n + ALPHA * (vocab.shape_v + 1))), F.col("shape") + 1)
    log = lambda below: F.sum(F.col("times") * F.log10((F.col("c") + ALPHA) / below))
    light = light.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known2"), log(F.lit(vocab.n + ALPHA * (vocab.v + 1))).alias("base2"), log(below).alias("rare2"))

    scored = encoded.drop("tail").mapInArrow(K.tidy(_likelihood(spark.sparkContext.broadcast(model))), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, rare double, forward double")
    both = scored.join(light, "rid", "left")
    plus = lambda *names: sum((F.coalesce(x, F.lit(0)) for x in names[1:]), F.col(names[0]))
    return both.select("doc_id", "held_out", "n_tokens", plus("known", "known2").alias("n_known"), F.lit(int(vocab.n)).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), plus("forward", "rare", "rare2").alias("score"))


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
