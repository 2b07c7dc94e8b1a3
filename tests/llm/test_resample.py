"""Importance resampling and the source audit against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import low

from leafmill.llm import importance_resample as R
from leafmill.llm import source_divergence as D
from leafmill.llm import textkernel as K

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.data())
def test_crc_of_any_span(data, pick):
    at = sorted(pick.draw(st.lists(st.integers(0, len(data)), min_size=2, max_size=12)))
    a, b = np.array(at[:-1]), np.array(at[1:])
    raw = np.frombuffer(data, np.uint8)
    got = R.span_crcs(R.prefix_registers(raw, a), R.prefix_registers(raw, b), b - a)
    assert got.tolist() == [zlib.crc32(data[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_crc_of_long_spans():
    raw = np.random.default_rng(1).integers(0, 256, 300_000).astype(np.uint8)
    a, b = np.array([0, 5, 64, 1]), np.array([300_000, 70_005, 64 + 65_536, 2])
    got = R.span_crcs(R.prefix_registers(raw, a), R.prefix_registers(raw, b), b - a)
    assert got.tolist() == [zlib.crc32(raw[x:y].tobytes()) for x, y in zip(a, b, strict=True)]


def plain_features(text, run=2):
    w = WORDS.findall(low(text))
    return [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def test_buckets_of_blocks():
    texts = ["One two, three-four", "", None, "x", "é ß é", "12 34  " * 40, "a" * 3000 + " b"]
    for limit in (8, 1 << 20):
        for run in (1, 2, 3):
            got = []
            for block in K.blocks(pa.array(texts), lower=True, limit=limit):
                found = R.features(block, run, 97)
                for row in range(block.n):
                    a, b = found.words.first[row], found.words.first[row + 1]
                    got.append(Counter(x for bucket, held in zip(found.buckets, found.held, strict=True) for x in bucket[a:b][held[a:b]].tolist()))
            assert got == [Counter(zlib.crc32(f.encode()) % 97 for f in plain_features(t, run)) for t in texts]


def plain_resample(rows, target, n_buckets=10_000, percent=25, least=20):
    """(doc_id, n_features, weight, score) of all, and the drawn ones in order of rank."""
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = Counter(), Counter()
    own = [[bucket(f) for f in plain_features(text)] for _, text in rows]
    for b in own:
        s.update(b)
    for text in target:
        t.update(bucket(f) for f in plain_features(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + n_buckets) / ((s[b] + 1) * (t_all + n_buckets)))) for b in s}
    out = []
    for (doc, text), b in zip(rows, own, strict=True):
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(WORDS.findall(low(text)))))
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[4], r[1], r[2]))
    return out, enough[: percent * len(enough) // 100]


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resample(spark, corpus, rows, percent):
    """Nulls, repeated rows and ids, texts without words and long ones, clashing columns."""
    target = ["spam and more of it", None, "", "x y x y"]
    docs = corpus.withColumnsRenamed({"score": "weight", "n": "rank", "first": "copies", "rid": "before", "region": "band"})
    got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent).collect()
    want, drawn = plain_resample([(r[0], r[1]) for r in rows], target, percent=percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(r[:4] for r in want)
    ranks = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranks] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in ranks] == [(r[3], r[0]) for r in drawn]


def test_resample_of_repeated_rows_and_nothing(spark, nothing):
    many = spark.createDataFrame([(5, "word " * 30)] * 90 + [(None, "other " * 30)] * 10, "doc_id long, text string")
    got = R.resample(many, spark.createDataFrame([], "text string"))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 26))
    assert R.resample(nothing, many).collect() == []


def plain_divergences(rows, min_docs, top=50, scale=10**9, smooth=5):
    each = [(lang or "", source or "", TERMS.findall(low(text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in each}:
        own = [r for r in each if r[0] == lang]
        docs, count = Counter(t for r in own for t in set(r[2])), {}
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        for _, source, words in own:
            count.setdefault(source, Counter()).update(w for w in words if docs[w] >= min_docs)
        share = lambda c, t: 1 + math.floor(Fraction(scale * (c[t] + smooth), sum(c.values()) + smooth * len(kept)))
        whole = sum(count.values(), Counter())
        p = {s: [share(c, t) for t in kept] for s, c in count.items()}
        q = [share(whole, t) for t in kept]
        for s in count:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in count if o != s))
            terms = sorted((-(a - b), t.encode()) for t, a, b in zip(kept, p[s], q, strict=True) if count[s][t] and a > b)[:top]
            out += [(lang, s, part, item.decode(), -value, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in "abé" for b in "xyzß" for c in "mn"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice([None, "s1", "s2", "S2", "é", "z9", "hot", "hot", "hot"]), " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))], k=rng.randint(0, 30)))) for _ in range(260)]
    return [*rows, ("en", "silent", None), ("en", "digits", "1234 ### 5"), ("fr", "alone", "mot"), ("it", "one", "a b"), ("it", "two", ""), ("en", "s1", "LOUD Loud\tloud-loud é" * 300), *[("de", "hot", "axm axm byn")] * 40]


@pytest.mark.parametrize(("min_docs", "top", "blocks"), [(30, 50, (64, 1024)), (5, 3, (2, 4)), (1, 50, (1, 1)), (10**6, 50, (3, 3))])
def test_divergences(spark, audited, min_docs, top, blocks):
    """Nulls, groups without terms, languages without kept terms, one hot source, repeated rows; cells of one group and one term give the same."""
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in audited], "lang string, source string, text string, term string, n long, bi int, held string").repartition(3)
    got = D.divergences(docs, min_docs, top, *blocks)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergences(audited, min_docs, top)


def test_divergences_of_nothing(spark, nothing):
    assert D.divergences(nothing).collect() == []


def test_shares_of_huge_counts(spark):
    n, total, terms = 7 * 10**12, 9 * 10**14, 3 * 10**6
    from pyspark.sql import functions as F

    got = spark.range(1).select(D._share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)
