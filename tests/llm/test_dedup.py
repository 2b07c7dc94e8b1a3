"""Dedup operators against plain versions."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from plain import WORD, low

from leafmill.llm import components, jaccard_join, line_dedup, substring_dedup, suffix_dedup
from leafmill.llm import superkmers as S
from leafmill.llm import textkernel as K

LEAST = -(2**63)


def gone_units(ordered, split, k):
    """Which units of each (id, hash) go: those in a window that also starts earlier."""
    seen, out = set(), {}
    for doc, th, text in ordered:
        units = split(text)
        gone = [False] * len(units)
        for i in range(len(units) - k + 1):
            w = tuple(units[i : i + k])
            if w in seen:
                gone[i : i + k] = [True] * k
            seen.add(w)
        out[doc, text] = units, gone
    return out


@pytest.mark.parametrize("bucket", [S.BUCKET_BYTES, 700])
def test_substring(corpus, ordered, bucket):
    want = gone_units(ordered, WORD.findall, 20)
    expect = sorted((r.doc_id is not None, r.doc_id or 0, len(u), sum(g), " ".join(x for x, y in zip(u, g, strict=True) if not y)) for r in corpus.select("doc_id", "text").collect() for u, g in [want[LEAST if r.doc_id is None else r.doc_id, r.text or ""]])
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(corpus, bucket).collect())
    assert got == expect
    assert sum(g[3] for g in got) > 300


@pytest.mark.parametrize("bucket", [S.BUCKET_BYTES, 3000])
def test_suffix(corpus, ordered, bucket):
    want = gone_units(ordered, lambda t: t.encode(), 100)
    expect = sorted((r.doc_id is not None, r.doc_id or 0, len(u), sum(g), bytes(x for x, y in zip(u, g, strict=True) if not y)) for r in corpus.select("doc_id", "text").collect() for u, g in [want[LEAST if r.doc_id is None else r.doc_id, r.text or ""]])
    rows = suffix_dedup.remove_repeated_bytes(corpus, bucket).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows) == expect
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)


def test_hot_minimisers(spark):
    """One minimiser in most windows: its windows are dealt one by one, and nothing changes."""
    rng = np.random.default_rng(0)
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 30, 12)), "the same four words", *(f"w{x}" for x in rng.integers(0, 30, 12))]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = gone_units([(i, 0, t) for i, t in enumerate(texts)], WORD.findall, 20)
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df, 2000).collect()}
    assert got == {i: sum(want[i, t][1]) for i, t in enumerate(texts)}


def test_prefix_doubling():
    rng = np.random.default_rng(1)
    strings = [rng.integers(97, 99, n).astype(np.uint8) for n in (0, 5, 130, 130, 300)] + [np.full(140, 97, np.uint8)]
    data, ends = np.concatenate(strings), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    at, rank = suffix_dedup.doubled(K.Block(0, len(strings), data, ends), 20)
    windows = defaultdict(list)
    for a, b in itertools.pairwise(ends):
        for i in range(a, b - 19):
            windows[data[i : i + 20].tobytes()].append(i)
    found = defaultdict(list)
    for a, r in zip(at.tolist(), rank.tolist(), strict=True):
        found[r].append(a)
    assert sorted(found.values()) == sorted(v for v in windows.values() if len(v) > 1)


@pytest.mark.parametrize("bounds", [{}, {"meeting": 1}, {"region_rows": 4, "rounds": 1}, {"region_rows": 3, "meeting": 1, "rounds": 3}])
def test_jaccard(corpus, rows, bounds):
    sets = []
    for r in rows:
        w = WORD.findall(low(r[1]))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    want = sorted((str(r[0]), len(sets[i]), str(least[root(i)])) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(corpus, **bounds).collect())
    assert got == want
    assert len({g[2] for g in got}) < len(rows) - 12


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (None, 3), (60, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((40, 45, 50), 40), 60: 60}


def test_lines(corpus, unique):
    rows = sorted((r.doc_id, r.text or "", r.source) for r in unique.collect())
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for i, x in enumerate(t.split("\n")):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
                first.setdefault(x.strip(" "), (d, i))
    want = {}
    for d, t, _ in rows:
        parts = t.split("\n")
        gone = [bool(x.strip(" ")) and len(sites[x.strip(" ")] - {None}) >= 6 and first[x.strip(" ")] != (d, i) for i, x in enumerate(parts)]
        want[d] = (sum(bool(x.strip(" ")) for x in parts), sum(gone), "\n".join(x for x, g in zip(parts, gone, strict=True) if not g))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_boilerplate(unique).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 5
    assert line_dedup.remove_boilerplate(corpus, broadcast_lines=0).count() == corpus.count()


def test_empty_tables(nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert suffix_dedup.remove_repeated_bytes(nothing).count() == 0
    assert jaccard_join.jaccard_components(nothing).count() == 0
    assert line_dedup.remove_boilerplate(nothing).count() == 0
