"""Very long texts, whole tables, clashing columns and empty tables, against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from plain import WORD, low
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, hmm, jaccard_join, line_dedup, packing, quality_fm, quality_rules, secrets, substring_dedup, suffix_dedup
from leafmill.llm import textkernel as K
from leafmill.llm.shared import checkpoint_dir, forget_written

SF = "/root/testdata/sf0.001"
ITEM = "these are the ten words that one benchmark question consists of"


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    lines = [" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(16_000)]
    a = "\n".join(lines)
    b = "\n".join(lines[:15_000] + [" ".join(reversed(x.split())) for x in lines[15_000:]])
    c = "\n".join(lines[9_000:9_040]) + f"\nnew words {ITEM} and more\n" + 'password = "hunter2hunter2Z9"'
    assert len(a.encode()) > K.BLOCK_BYTES
    return [a, b, c, "", None, "short text", "\n".join(lines[3:8]) + "\n" + ITEM.upper()]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    spark.createDataFrame([(i, t, "en", f"s{i}", 1) for i, t in enumerate(long_texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def gone(texts, split, k, join):
    """Units that go, with a number for each window instead of the window."""
    seen, out = set(), []
    for t in texts:
        units = split(t or "")
        edge = np.zeros(len(units) + 1, int)
        for i in range(len(units) - k + 1):
            w = hash(join(units[i : i + k]))
            if w in seen:
                edge[i] += 1
                edge[i + k] -= 1
            seen.add(w)
        out.append((units, np.cumsum(edge[:-1]) > 0))
    return out


def test_long_substrings(long_docs, long_texts):
    want = {i: (len(u), int(g.sum()), " ".join(x for x, y in zip(u, g, strict=True) if not y)) for i, (u, g) in enumerate(gone(long_texts, WORD.findall, 20, tuple))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(long_docs).collect()} == want
    assert want[1][1] > 170_000


def test_long_bytes(long_docs, long_texts):
    want = {i: (len(u), int(g.sum()), bytes(np.frombuffer(u, np.uint8)[~g])) for i, (u, g) in enumerate(gone(long_texts, str.encode, 100, bytes))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(long_docs).collect()} == want


def test_long_jaccard(long_docs, long_texts):
    sets = []
    for t in long_texts:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    assert 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(long_docs).collect()}
    assert got == {i: (len(s), 0 if i == 1 else i) for i, s in enumerate(sets)}


def test_long_lines_benchmark_and_secrets(spark, long_docs, long_texts):
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.remove_boilerplate(long_docs, min_sites=3).collect()}
    own = [[x for x in (t or "").split("\n") if x.strip(" ")] for t in long_texts]
    sites = Counter(x for t in own for x in set(t))
    first, want = set(), {}
    for i, t in enumerate(own):
        removed = 0
        for x in t:
            removed += sites[x] >= 3 and x in first
            first.add(x)
        want[i] = (len(t), removed)
    assert lines == want
    assert sum(n for _, n in want.values()) == 2 * 45
    bench = spark.createDataFrame([("q", ITEM)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.decontaminate(long_docs, bench).collect() if r.n_hit} == {2: 11, 6: 11}
    found = {r.doc_id: [long_texts[r.doc_id][s.start : s.end] for s in r.secrets] for r in secrets.scan(long_docs).collect() if r.secrets}
    assert found == {2: ['password = "hunter2hunter2Z9']}


def test_long_rules_scores_and_tokens(spark, long_docs, long_texts):
    from tokenizers import Tokenizer

    n = [len(WORD.findall(t or "")) for t in long_texts]
    assert {r.doc_id: r.n_words for r in quality_rules.quality_rules(long_docs).collect()} == dict(enumerate(n))
    assert {r.doc_id: r.n_tokens for r in hmm.score(long_docs, rounds=1).collect()} == {i: x + 1 for i, x in enumerate(n)}
    assert quality_fm.classify(long_docs, quality_fm.FM()).count() == len(n)
    checkpoint_dir(spark)
    tok = Tokenizer.from_file(packing.tokenizer_path())
    total = Counter()
    for r in packing.pack(packing.token_pieces(long_docs, packing.tokenizer_path())).collect():
        total[r.doc_id] += r.length
    assert total == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(long_texts)}


CLASHES = ["n_lines", "n_removed", "kept_text", "n_words", "n_hit", "item_ids", "spans", "_hit", "secrets", "kept", "n_symbols", "score", "predicted", "sequence_id", "piece", "line", "site", "row", "gone", "doc", "text_hash", "rid", "region", "own", "home", "part", "map"]


def test_columns_of_the_same_names(spark, long_docs):
    docs = long_docs.filter("doc_id > 1").withColumns({c: F.lit("x") for c in CLASHES})
    bench = spark.createDataFrame([("q", ITEM)], "item_id string, text string")
    for got, added in (
        (line_dedup.remove_boilerplate(docs), ["n_lines", "n_removed", "kept_text"]), (decontaminate.decontaminate(docs, bench), ["n_words", "n_hit", "item_ids", "spans"]),
        (secrets.scan(docs), ["secrets"]), (quality_rules.quality_rules(docs), ["n_words", "kept", "n_symbols"]), (quality_fm.classify(docs, quality_fm.FM()), ["score", "predicted"]),
    ):
        assert len(set(got.columns)) == len(got.columns)
        assert set(docs.columns) - set(added) - {"_hit"} <= set(got.columns)
        assert got.filter(" or ".join(f"cast({a} as string) = 'x'" for a in added)).isEmpty()
        assert got.count() == 5
    checkpoint_dir(spark)
    for f in (substring_dedup.remove_repeats, suffix_dedup.remove_repeated_bytes, jaccard_join.jaccard_components, hmm.score, lambda d: packing.pack(packing.token_pieces(d, packing.tokenizer_path()))):
        assert f(docs).count() == 5


def test_empty_tables(spark, long_docs):
    none = long_docs.limit(0)
    assert quality_fm.classify(none, quality_fm.FM()).count() == 0
    assert quality_fm.fit(none, spark.createDataFrame([], "doc_id long, quality int")) is not None
    checkpoint_dir(spark)
    assert packing.pack(packing.token_pieces(none, packing.tokenizer_path())).count() == 0


# The base patterns of the contract.
KINDS = {"assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def plain_secrets(text):
    found = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text):
            n = len(m[1]) if kind == "assign" else len(m[0])
            if n >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                found.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets_query(spark):
    """The query over a whole table: counts, digest and listed spans."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = secrets.op6_secrets(spark, SF).collect()
    assert rows[0].asDict().keys() == dict.fromkeys(["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]).keys()
    some = 0
    for r in rows:
        base = plain_secrets(texts[r.doc_id])
        count = Counter(k for k, _, _ in base)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(count[k] for k in KINDS)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("literal")] == listed.split(",") * bool(base)
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)
        some += len(base)
    assert len(rows) == len(texts) and some > 5


def test_secrets_of_crafted_texts():
    """Names that stand for each other again and again, and long runs of name characters: the work grows with the text."""
    add = lambda t: [t[a:b] for a, _, b in secrets.literal_spans(t, secrets.base_spans(t))]
    key = "hT7kQ2mZx9Lw"
    assert add(f'x0 = "{key}"\n' + "".join(f"x{i} = x{i - 1} + x{i - 1}\n" for i in range(1, 3000)) + "password = x2999") == [key]
    assert add(f'k0 = "{key}"\n' + "".join(f'k{i} = k{i - 1} + "ab"\n' for i in range(1, 20_000)) + "password = k19999") == [key]
    for run in ("a-", "a.", "1-", "a: b | ", "x[1]", "token "):
        assert add(run * 300_000) == []
    assert add("a-" * 50_000 + f'\npassword: str = "{key}"') == [key]
    assert len(secrets.base_spans('password="hT7kQ2mZx9Lw-1"\n' * 20_000)) == 20_000


def test_lm_score_is_the_plain_forward_pass(corpus, rows):
    got = Counter((str(r.doc_id), r.n_tokens, round(r.score, 5)) for r in hmm.score(corpus, rounds=0, heavy=50).collect())
    key = {}
    for r in rows:
        for w in WORD.findall(low(r[1])):
            b = w.encode()
            shape = min(len(b) - 1, 7) << 3 | b[-1] & 7
            key[w] = np.array([K.hash_text(w) & ~63 | shape], np.uint64).view(np.int64)[0].item()
    train = [r for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10]
    count = Counter(w for r in train for w in WORD.findall(low(r[1])))
    rank = {w: i for i, w in enumerate(sorted(count, key=lambda w: (-count[w], key[w])))}
    own = hmm.CLASS_WORDS[0]
    shape_n, shape_v, class_n = Counter(), Counter(), np.zeros(own + hmm.SHAPES + 1)
    # words beyond the heavy ones have no class of their own
    classed = {w for w in rank if rank[w] < min(own, 50)}
    for w, c in count.items():
        if w in classed:
            class_n[rank[w]] = c
        else:
            shape_n[key[w] & 63] += c
            shape_v[key[w] & 63] += 1
            class_n[own + (key[w] & 63)] += c
    class_n[-1] = len(train)
    m = hmm.Model.first(class_n)
    want = Counter()
    for r in rows:
        words = WORD.findall(low(r[1]))
        a, total = m.start, 0.0
        for i, w in enumerate([*words, None]):
            c = own + hmm.SHAPES if w is None else rank[w] if w in classed else own + (key[w] & 63)
            a = (a if i == 0 else a @ m.move) * m.emit[:, c]
            total += math.log10(a.sum())
            a = a / a.sum()
            if w is not None and w not in classed:
                s = key[w] & 63
                total += math.log10((count[w] + 0.1) / (shape_n[s] + 0.1 * (shape_v[s] + 1)))
        want[str(r[0]), len(words) + 1, round(total, 5)] += 1
    assert got == want


def test_training_reads_texts_whole():
    rng = np.random.default_rng(0)
    m = hmm.Model.first(np.ones(20), states=3)
    texts = [rng.integers(0, 20, n).astype(np.int16) for n in (900, 3, 40, 1)]
    whole = hmm.expected_counts(m, texts)
    assert whole[:3].sum() == pytest.approx(4)  # a start for each text
    assert whole[3:12].sum() == pytest.approx(sum(len(t) - 1 for t in texts))
    assert hmm.expected_counts(m, texts, [True, False, True, False])[:3].sum() == pytest.approx(2)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_on_the_held_out_fifth(spark):
    """Area under the curve on rows that weren't learned from."""
    rows = quality_fm.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and label.get(r.doc_id) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    area = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    right = sum((s >= quality_fm.THRESHOLD) == (y == 1) for s, y in held) / len(held)
    print(f"held out: {len(held)} rows, area {area:.3f}, right {right:.3f}")
    assert area > 0.85


def test_written_tables_can_be_dropped(spark, corpus):
    import glob

    path = checkpoint_dir(spark).removeprefix("file:")
    sketches = lambda: {p for p in glob.glob(f"{path}/*") if os.path.basename(p).startswith("sketch-")}
    forget_written(spark)
    before = sketches()
    assert jaccard_join.jaccard_components(corpus).count()
    assert len(sketches() - before) == 1
    forget_written(spark)
    assert sketches() == before


def test_sequences_hold_the_ids(spark, long_docs):
    """Exact round trip: the ids of the packed sequences are those of the pieces, in their places."""
    checkpoint_dir(spark)
    path = packing.tokenizer_path()
    docs = long_docs.filter("doc_id > 1")
    pieces = packing.token_pieces(docs, path, with_ids=True)
    placed = packing.pack(packing.token_pieces(docs, path))
    ids = {r.sequence_id: r.ids for r in packing.sequences(pieces, placed).collect()}
    of = {(r.doc_id, r.piece): r.ids for r in pieces.collect()}
    rows = placed.collect()
    assert all(ids[r.sequence_id][r.offset : r.offset + r.length] == of[r.doc_id, r.piece] for r in rows)
    assert sum(map(len, ids.values())) == sum(r.length for r in rows)
