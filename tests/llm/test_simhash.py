"""SimHash near-dedup against plain versions."""

import os
import random

import numpy as np
import pytest
import xxhash
from plain import WORD, low

from leafmill.llm import simhash_join as H


def plain_print(text):
    words = WORD.findall(low(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=4):
    """For each fingerprint the smallest index of its component."""
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def groups(rng, n):
    """Chains, dense groups, pairs at 4 and 5 differences and lone fingerprints."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for x in out[: n // 4]:
        out += [flipped(rng, x, rng.choice([1, 2, 4, 5, 8])) for _ in range(2)]
    x = rng.getrandbits(64)
    for _ in range(n // 2):  # a chain
        x = flipped(rng, x, rng.choice([3, 4, 4, 5]))
        out.append(x)
    out += [flipped(rng, out[0], rng.randint(0, 3)) for _ in range(n)]  # a dense group
    out += [0, 1, 2**64 - 1, 2**63, 0b11111, 0b1111]
    return sorted(set(out))


def test_gray_order():
    ranks = H.gray_rank(np.array([i ^ i >> 1 for i in range(1000)], np.uint64))
    assert ranks.tolist() == list(range(1000))


@pytest.mark.parametrize("shift", [64, 60, 3])
def test_index_inside_top_nodes(shift):
    """One top node for all, and several: links inside each, and no others."""
    rng = random.Random(shift)
    prints = np.array(groups(rng, 300), np.uint64)
    top = (prints >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(prints), np.int64)
    top = np.unique(top, return_inverse=True)[1]
    order = np.lexsort((H.gray_rank(prints), top))
    prints, top = prints[order], top[order]
    root = H.linked(prints, top)
    for t in range(top.max() + 1):
        own = np.flatnonzero(top == t)
        assert (root[own] - own[0]).tolist() == plain_components(prints[own].tolist())


def test_nodes_share_the_pattern_of_all_below():
    rng = random.Random(4)
    prints = np.sort(np.array(groups(rng, 200), np.uint64))
    prints = prints[np.argsort(H.gray_rank(prints))]
    levels = H.hierarchy(prints, np.zeros(len(prints), np.int64))
    assert len(levels[-1].pattern) == 1
    first = np.arange(len(prints) + 1)
    for i, level in enumerate(levels):
        first = first[level.child] if i else first
        for a, b, pattern, mask in zip(first, first[1:], level.pattern, level.mask, strict=False):
            below = prints[a:b]
            shared = ~np.bitwise_or.reduce(below ^ below[0])
            assert (mask & ~shared) == 0 and ((below ^ pattern) & mask == 0).all() and level.last[np.flatnonzero(first == a)[0]] == b - 1
            assert mask == shared


@pytest.mark.parametrize("bounds", [{}, {"node_rows": 3, "bucket_rows": 50}, {"node_rows": 40, "levels": 2, "bucket_rows": 10**6}, {"node_rows": 1, "levels": 1}])
def test_components_however_nodes_are_parted(spark, bounds):
    prints = groups(random.Random(9), 150)
    df = spark.createDataFrame([(H._signed(x),) for x in prints], "print long")
    found = {r.node % 2**64: r.root for r in H.components_of(df, **bounds).collect()}
    root = plain_components(prints)
    least = {r: min(H._signed(prints[i]) for i in range(len(prints)) if root[i] == r) for r in set(root)}
    want = {x: least[r] for x, r in zip(prints, root, strict=True) if root.count(r) > 1}
    assert found == want


def test_masks_part_all_bits():
    for mask in (0, *H._parts(0), H._parts(H._parts(0)[2])[4]):
        parts = [p & ~mask for p in H._parts(mask)]
        assert all(p & mask == mask for p in H._parts(mask)) and sum(parts) == ~mask & (2**64 - 1) and all(x & y == 0 for i, x in enumerate(parts) for y in parts[:i])


def test_documents_against_plain_version(spark, corpus, rows):
    """Nulls, repeated rows and ids, texts without words, long texts and clashing columns."""
    got = sorted(((r.doc_id, r.print % 2**64, r.component_id) for r in H.near_duplicates(corpus.withColumnsRenamed({"n": "print", "first": "least", "rid": "mask"})).collect()), key=str)
    prints = sorted({plain_print(r[1]) for r in rows})
    root = dict(zip(prints, plain_components(prints), strict=True))
    ids = {}
    for r in rows:
        ids.setdefault(root[plain_print(r[1])], []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    assert got == sorted(((r[0], plain_print(r[1]), least[root[plain_print(r[1])]]) for r in rows), key=str)


def test_empty_table_and_query(spark, nothing, corpus):
    assert H.near_duplicates(nothing).collect() == []


def test_blocks_and_bits_at_once(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 3, 4, 5, 400, 7, 0, 900)]
    monkeypatch.setattr(H, "BITS_AT_ONCE", 64)
    import pyarrow as pa

    (batch,) = H._printed(iter([pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])]))
    assert [x % 2**64 for x in batch.column(1).to_pylist()] == [plain_print(t) for t in texts]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_on_a_table(spark):
    """The query over the smallest table: every fingerprint and every component."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = {d: plain_print(t) for d, t in docs.items()}
    each = sorted(set(prints.values()))
    root = dict(zip(each, plain_components(each), strict=True))
    least = {}
    for d in sorted(docs):
        least.setdefault(root[prints[d]], d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in H.op12_simhash_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (f"{p:016x}", least[root[p]]) for d, p in prints.items()}
