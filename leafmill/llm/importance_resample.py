"""Importance resampling towards a target, with n-grams hashed by prefix CRCs.

A text's words, joined by single spaces, are scanned once; the CRC register is kept where words begin and end. The CRC is linear over GF(2): what a prefix adds
to a longer one is its own register shifted by the bytes between, so the CRC of any run of words follows from two
prefixes, whatever stands before them, and no run is read again. As prefixes cancel, the texts of a block are scanned as one string.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .decontaminate import NOT_WORD
from .shared import written

RUN, BUCKETS, SEED, PERCENT, LEAST_WORDS = 2, 10_000, 7, 25, 20
#: Bytes that one step of the scan takes from each row of the block, and scores of a band of places.
ROW, BAND = 64, 1000

# Fixed value: the polynomial of CRC-32, lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320

_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return t


_TABLE = _byte_table()
_ROWS_OF_BYTES = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]


def _look_up(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given by what it makes of each byte in each place."""
    return tables[0][x & np.uint32(255)] ^ tables[1][x >> np.uint32(8) & np.uint32(255)] ^ tables[2][x >> np.uint32(16) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]


class Shifts:
    """Maps that move a register past so many bytes: by each number below ``SMALL``, and by powers of two."""

    SMALL = 256

    def __init__(self) -> None:
        one = _TABLE[_ROWS_OF_BYTES & np.uint32(255)] ^ (_ROWS_OF_BYTES >> np.uint32(8))
        self.powers, small = [one], [_ROWS_OF_BYTES]
        for _ in range(40):
            self.powers.append(_look_up(self.powers[-1], self.powers[-1]))
        for _ in range(self.SMALL - 1):
            small.append(_look_up(one, small[-1]))
        self.small = np.concatenate(small).reshape(-1)

    def by(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Registers ``x``, each moved past ``n`` bytes."""
        at = (n % self.SMALL) * 1024
        byte = [(x >> np.uint32(8 * i) & np.uint32(255)).astype(np.int64) for i in range(4)]
        out = self.small[at + byte[0]] ^ self.small[at + 256 + byte[1]] ^ self.small[at + 512 + byte[2]] ^ self.small[at + 768 + byte[3]]
        rest = n // self.SMALL
        if rest.any():
            for i, power in enumerate(self.powers[8:]):
                some = np.flatnonzero(rest >> i & 1)
                out[some] = _look_up(power, out[some])
        return out


_shifts: list[Shifts] = []


def shifts() -> Shifts:
    if not _shifts:
        _shifts.append(Shifts())
    return _shifts[0]


def prefix_registers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The CRC register (begun at zero) after the first ``at`` bytes. Rows of ROW bytes are scanned side by side; what stands before each row comes from doubling."""
    rows = max(1, -(-len(data) // ROW))
    by_place = np.ascontiguousarray(np.concatenate([data, np.zeros(rows * ROW - len(data), np.uint8)]).reshape(rows, ROW).T)
    state, kept = np.zeros(rows, np.uint32), np.zeros((ROW + 1, rows), np.uint32)
    for i in range(ROW):
        state = _TABLE[state & np.uint32(255) ^ by_place[i]] ^ (state >> np.uint32(8))
        kept[i + 1] = state
    upto, power, step = state, ROW.bit_length() - 1, 1
    while step < rows:
        moved = _look_up(shifts().powers[power], upto[:-step])
        upto = np.concatenate([upto[:step], upto[step:] ^ moved])
        power, step = power + 1, 2 * step
    before = np.concatenate([[np.uint32(0)], upto[:-1]])
    row = np.minimum(at // ROW, rows - 1)
    return kept[at - row * ROW, row] ^ shifts().by(before[row], at - row * ROW)


def span_crcs(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of ``size`` bytes from the registers before and after them."""
    return ~(last ^ shifts().by(first ^ _ONES, size))


class Features(NamedTuple):
    words: K.Words
    buckets: list[np.ndarray]  #: for runs of 1, 2, ... words: the bucket of the run that begins with each word
    held: list[np.ndarray]  #: whether that run lies within its row


def features(block: K.Block, run: int = RUN, n_buckets: int = BUCKETS) -> Features:
    """The buckets of all runs of 1 to ``run`` words of a block's rows: CRC-32 of the run (words joined by one space) modulo ``n_buckets``."""
    words = K.tokens(block, NOT_WORD)
    n = len(words.start)
    if not n:
        return Features(words, [np.zeros(0, np.int64)] * run, [np.zeros(0, bool)] * run)
    data, start, end = K.joined(block, words)
    edges = prefix_registers(data, np.concatenate([start, end]))
    before, after = edges[:n], edges[n:]
    buckets, held = [], []
    for k in range(run):
        m = max(0, n - k)
        within = words.row[:m] == words.row[k:]
        crc = span_crcs(before[:m], after[k:], end[k:] - start[:m])
        buckets.append((crc % np.uint32(n_buckets)).astype(np.int64))
        held.append(within)
    return Features(words, buckets, held)


def bucket_counts(texts: DataFrame, run: int = RUN, n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (text) each bucket holds. Every task sums its own; ``n_buckets`` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for block in K.blocks(K.column(batch, "text"), lower=True):
                found = features(block, run, n_buckets)
                for bucket, held in zip(found.buckets, found.held, strict=True):
                    total += np.bincount(bucket[held], minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(K.tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of a bucket's smoothed shares in target and source)."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A fixed Gumbel draw of a document, in thousandths; a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, run: int = RUN, seed: int = SEED) -> DataFrame:
    """SCORED of each row of ``docs`` (doc_id, text): weight is the floored mean gain of its features (0 without any), score adds the noise. Written."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for block in K.blocks(K.column(batch, "text"), lower=True):
                found = features(block, run, len(own))
                total, count = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
                for bucket, held in zip(found.buckets, found.held, strict=True):
                    upto = np.concatenate([[0], np.cumsum(np.where(held, own[bucket], 0))])
                    many = np.concatenate([[0], np.cumsum(held)])
                    edge = np.minimum(found.words.first, len(held))
                    total += np.diff(upto[edge])
                    count += np.diff(many[edge])
                n_words.append(np.diff(found.words.first))
                n_features.append(count)
                weight.append(total // np.maximum(count, 1))
            if not n_words:
                continue
            n_words, n_features, weight = map(np.concatenate, (n_words, n_features, weight))
            ids = K.column(batch, "doc_id")
            total = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight, total))], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.tidy(score), SCORED)
    return written(rows, "scores")


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (SCORED) with rank: 1, 2, 3, ... for the floor(percent * N / 100) highest scores of the N rows with ``least_words`` words or more, ties to the smaller doc_id (nulls last); null for others.

    How many rows stand above each score is summed over scores, of which there are 115,000 at most (weights lie within 44,000 of zero, noise between -3,200 and
    22,900), in bands; only rows of one score are ordered among one another. Rows equal in all columns are one row with a count until they are numbered.
    """
    enough = F.col("n_words") >= least_words
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    counts = rows.filter(enough).groupBy("score").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col("score") / BAND))
    above = lambda order: F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bands = counts.groupBy("band").agg(F.sum("n").alias("n")).select("band", above(W.orderBy(F.desc("band"))).alias("over"), F.sum("n").over(W.partitionBy()).alias("all"))
    places = counts.select("score", "band", above(W.partitionBy("band").orderBy(F.desc("score"))).alias("inner")).join(F.broadcast(bands), "band")
    places = places.select("score", (F.col("inner") + F.col("over")).alias("before"), F.floor(F.lit(percent) * F.col("all") / 100).alias("draws"))
    placed = each.join(F.broadcast(places), "score", "left")
    drawn = F.coalesce(enough & (F.col("before") < F.col("draws")), F.lit(False))
    tied = W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_words", "n_features", "weight").rowsBetween(W.unboundedPreceding, -1)
    names = rows.columns
    inside = placed.filter(drawn).select(*names, "copies", "draws", (F.col("before") + F.coalesce(F.sum("copies").over(tied), F.lit(0))).alias("at"))
    number = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("i")
    inside = inside.select(*names, "draws", "at", number).select(*names, F.when(F.col("at") + F.col("i") <= F.col("draws"), F.col("at") + F.col("i")).alias("rank"))
    outside = placed.filter(~drawn).select(*names, number).select(*names, F.lit(None).cast("long").alias("rank"))
    return inside.unionByName(outside)


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, n_buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """SCORED and rank of each row of ``docs`` (doc_id, an integer, and text), drawn towards the texts of ``target`` (text); other columns of both are ignored.

    Words are lower-cased in A-Z, of letters, digits and all characters beyond ASCII. A null text has no words; without features the weight is 0. A null doc_id has
    the noise of an empty one and comes after all others among ties. Repeated rows count, score and rank as often as they come. No rows give none;
    without target texts all gains come from the source alone.
    """
    gain = gains(bucket_counts(docs, run, n_buckets), bucket_counts(target, run, n_buckets))
    return ranked(scored(docs, gain, run, seed), percent, least_words)


def op11_importance_resample(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_RUNS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"

OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, {_RUNS} AS f FROM d), bf AS (SELECT {_RUNS} AS f FROM b),
step AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i))),
crc AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM bf), step),
own AS (SELECT doc_id, bucket FROM df JOIN crc USING (f)),
s AS (SELECT bucket, count(*) AS n FROM own GROUP BY ALL), t AS (SELECT bucket, count(*) AS n FROM bf JOIN crc USING (f) GROUP BY ALL),
n AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s.n + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain FROM n, s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN gain USING (bucket) GROUP BY ALL),
sc AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_words >= {LEAST_WORDS})
SELECT sc.doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id)
"""
