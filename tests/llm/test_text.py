"""Operators on single texts, packing and models against plain versions."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import WORD, low
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, hmm, packing, quality_fm, quality_rules, secrets
from leafmill.llm import textkernel as K
from leafmill.llm.shared import checkpoint_dir

SF = "/root/testdata/sf0.001"


def thue_morse(units, n):
    """Two unlike strings of n units, equal under sums with powers of one odd base from 1,024 units on."""
    turn = [bin(i).count("1") & 1 for i in range(n)]
    return [units[x] for x in turn], [units[1 - x] for x in turn]


def test_hashes_of_regular_texts():
    for n in (8, 100, 1024, 2048, 5000):
        a, b = ("".join(x) for x in thue_morse("ab", n))
        assert K.hash_text(a) != K.hash_text(b)
        assert K.hash_text("x" * n) != K.hash_text("x" * (n + 1)) != K.hash_text("x" * n + chr(0))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain_rules(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = Counter(x for x in t.split("\n") if WORD.search(x))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), sum(lines.values()) - len(lines), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_rules(corpus, rows):
    got = quality_rules.quality_rules(corpus)
    assert set(corpus.columns) < set(got.columns)
    assert Counter((r.text, *(r[c] for c in BASE)) for r in got.collect()) == Counter((r[1], *plain_rules(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got.collect())
    loud = {r.text[:4]: r.kept for r in got.collect() if r.text and r.n_words > 60 and not r.base_failed}
    assert loud["LOUD"] is False


def test_quality_rules_lines(spark):
    texts = ["x y", "abc\nabc", "abc\n\nabc\n", "\nabc\nabc", "", "\n", "abc", "abc\nab\nabc\nab", " \nabc\n abc", None, "ab\n" * 5]
    got = quality_rules.quality_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)).collect()
    assert {r.doc_id: tuple(r[c] for c in BASE) for r in got} == {i: plain_rules(t) for i, t in enumerate(texts)}


def test_quality_query_and_layout(spark):
    """The query over a whole table against the plain rules; however the rows are split, all columns are the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = quality_rules.op8_quality_rules(spark, SF)
    assert got.columns[:8] == ["doc_id", *BASE[:5], "base_failed", "kept"]
    rows = {r.doc_id: r for r in got.collect()}
    assert {d: tuple(r[c] for c in BASE) for d, r in rows.items()} == {d: plain_rules(t) for d, t in text.items()}
    for n in (1, 16):
        again = quality_rules.quality_rules(docs.select("doc_id", "text", "lang").repartition(n), carry=["doc_id"]).collect()
        assert {r.doc_id: tuple(r) for r in again} == {d: tuple(r) for d, r in rows.items()}


def test_references_of_labels(spark):
    rng = random.Random(11)
    spell = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = []
    for k in range(40):  # languages of equal size
        vocab = [spell(rng.randint(2, 8)) for _ in range(60)]
        docs += [(f"l{k}", " ".join(rng.choice(vocab) for _ in range(250))) for _ in range(12)]
    junk = lambda: " ".join("#" * rng.randint(1, 9) + str(rng.randrange(10**9)) for _ in range(80))
    strange = lambda: " ".join(spell(6) for _ in range(250))
    docs += [("zz", junk()), ("zy", junk()), *((None, junk()) for _ in range(20)), ("zx", strange()), ("l0", junk()), (" ", strange())]
    got = quality_rules.quality_rules(spark.createDataFrame(docs, "lang string, text string")).collect()
    assert not any(r.base_failed for r in got)
    assert {r.lang for r in got if r.kept} == {f"l{k}" for k in range(40)}
    assert [r.lang for r in got if not r.kept and "#" in r.text].count("l0") == 1
    assert sum(r.kept for r in got) == 480


def test_nearest_words_is_the_dense_distance():
    rng = np.random.default_rng(4)
    table = rng.integers(0, 50, (4, 9)).astype(float)
    counts = rng.integers(0, 4, (6, 9)) * rng.integers(0, 2, (6, 9))
    row, kind = (np.repeat(x, counts.ravel()) for x in np.divmod(np.arange(counts.size), 9))
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    want = np.min([quality_rules.js_distance(p, q / q.sum()) for q in table], axis=0)
    assert quality_rules._nearest_words(row, kind, 6, table, None) == pytest.approx(want)
    table[1] += counts[2]
    table[3] = table[:3].sum(axis=0)
    less = [table[0], table[1] - counts[2], table[2], table[3] - counts[2]]
    want = min(quality_rules.js_distance(p[2:3], q / q.sum())[0] for q in less)
    assert quality_rules._nearest_words(row, kind, 6, table, np.array([-1, -1, 1, -1, -1, -1]))[2] == pytest.approx(want)


def test_js_distance():
    p = np.array([[1.0, 0], [0.5, 0.5], [0, 0]])
    half = math.sqrt((0.5 * math.log2(2) + 0.5 * math.log2(2 / 3) + math.log2(4 / 3)) / 2)
    assert quality_rules.js_distance(p, np.array([0.0, 1])) == pytest.approx([1, half, 0])
    assert quality_rules.js_distance(p[1:2], p[1]) == pytest.approx([0])


ITEMS = [("7", "what is the answer to the question that nobody asked before today then"), ("10", "Ünder, 9 mills"), ("a", None), ("b", "?!"), ("7", "second row of item seven")]


def plain_hits(text, items):
    split = lambda t: decontaminate_words(low(t))
    words = split(text or "")
    hit, ids = [False] * len(words), set()
    for item, t in items:
        w = split(t or "")
        for i in range(max(1, len(w) - 9) if w else 0):
            win = w[i : i + 10]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit[j : j + len(win)] = [True] * len(win)
                    ids.add(item)
    return len(words), sum(hit), sorted(ids)


def decontaminate_words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


@pytest.mark.parametrize("size", [1 << 24, 30])
def test_decontaminate(spark, corpus, size):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    extra = [(900, "so WHAT is the answer, to the question that; nobody asked before?"), (901, "ünder 9 mills and under 9 mills, Ünder-9-mills"), (902, "second row of item seven")]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = decontaminate.decontaminate(docs, bench, automaton_bytes=size).collect()
    assert Counter((r.text, r.n_words, r.n_hit, tuple(r.item_ids)) for r in rows) == Counter((r.text, n, h, tuple(i)) for r in docs.collect() for n, h, i in [plain_hits(r.text, ITEMS)])
    spans = {r.doc_id: [r.text[s.start : s.end] for s in r.spans] for r in rows if r.n_hit}
    assert spans[900] == ["WHAT is the answer, to the question that; nobody asked before"]
    assert spans[901] == ["Ünder-9-mills"]  # only A-Z are lower-cased
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").isEmpty()


def test_secrets(corpus):
    base = lambda t: [(t[a:b], secrets.KINDS[k]) for a, k, b in secrets.base_spans(t)]
    assert base('é password="abcdefghijkl" token=short') == [('password="abcdefghijkl', "assign")]
    assert base("password=token:abcdefghijklmnop") == []  # the failing match takes its text along
    assert base("API_KEY: " + "a" * 12) == [("API_KEY: " + "a" * 12, "assign")]
    assert base("AKIA" + "B" * 14 + " AKIA" + "B" * 13) == [("AKIA" + "B" * 14, "access")]
    assert base("x" + "0" * 16 + " " + "f" * 15) == [("0" * 16, "hex")]
    add = lambda t: [t[a:b] for a, _, b in secrets.literal_spans(t, secrets.base_spans(t))]
    assert add('k = "hunter2hunter2Z9"\ndb_password = k') == ["hunter2hunter2Z9"]
    assert add('a = "x7Kq92"\nb = "Lm0pRt55"\nsigning_key = a + b') == ["Lm0pRt55"]
    assert add('"client_credential": "Zx81-Kq7-22"') == ["Zx81-Kq7-22"]
    assert add('password = "changeme"') == add("title = 'Zx81-Kq7-22'") == add("we met at 10:30 and said: hello") == []
    found = secrets.scan(corpus)
    assert found.count() == corpus.count()
    red = found.select(secrets.redact(F.col("text"), F.col("secrets")).alias("red")).collect()
    assert not any("hunter2hunter2" in (r.red or "") or "AKIAABC" in (r.red or "") for r in red)


@pytest.mark.parametrize(
    "text",
    [
        'password: str = "{}"', 'const apiKey: string = "{}";', 'const apiKey: string | null = "{}"', "let password: &'static str = \"{}\";", 'val apiKey: String? = "{}"', 'token: Optional[Dict[str, str]] = "{}"', 'var password string = "{}"', 'char password[] = "{}";',
        "K={}\nDB_PASSWORD=$K", "K={}\nDB_PASSWORD=${{K}}", 'K={}\nDB_PASSWORD="$K"', 'cfg.k = "{}"\npassword = cfg.k', 'password = k\nk = "{}"', 'password = k\nk = j\nj = "{}"', 'password = k = "{}"', 'k = password = "{}"',
    ],
)
def test_assignment_forms(text):
    text = text.format("hT7kQ2mZx9Lw")
    base = secrets.base_spans(text)
    got = [text[a:b] for a, _, b in base + secrets.literal_spans(text, base)]
    assert any("hT7kQ2mZx9Lw" in x for x in got)
    assert all(text[a:b] == "hT7kQ2mZx9Lw" for a, _, b in secrets.literal_spans(text, base))


def test_joined_literals():
    add = lambda t: [t[a:b] for a, _, b in secrets.literal_spans(t, secrets.base_spans(t))]
    assert add('password = "hT7k" + "Q2mZ" + "x9Lw"') == ["hT7k", "Q2mZ", "x9Lw"]
    assert add('a = "hT7kQ2"\nDB_PASSWORD="${a}mZx9Lw"') == ["hT7kQ2", "mZx9Lw"]
    assert add("password = os.environ.get('K')") == add("token = k\nk = token") == []
    deep = "".join(f"k{i} = k{i + 1} + k{i + 1}\n" for i in range(40)) + 'k40 = "hT7kQ2mZx9Lw"\npassword = k0'
    assert add(deep) == ["hT7kQ2mZx9Lw"]


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    checkpoint_dir(spark)
    odd = [(1, "İstanbul ΣΑΣ x y <|endoftext|>z é 'tis we'll 12\x1c34"), (2, "mot " * 5000), (3, "")]
    odd += [(6, "x'y don't DON'T '' !'s 's, a'1 J̌, é≠ a≠b ²3 ½ ٣4 0 00 a0b 0,0 c'0 '0 ,'x ́a K ﬁ 中文。ab,cd"), (7, "wörd,and more. " * 90_000)]
    odd += [(8 + i, "".join(x)) for i, x in enumerate(thue_morse("ab", 2048))]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    pieces = packing.token_pieces(docs, path, with_ids=True)
    tok = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[r.doc_id, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in pieces.collect()) == want
    placed = packing.pack(packing.token_pieces(docs, path), shard_pieces=40)
    by = defaultdict(list)
    for r in placed.collect():
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for x in by.values() for _, n in x)
    assert len(by) <= -(-total // 2048) + 5  # a part-filled sequence per shard at most
    assert packing.pack(packing.token_pieces(corpus.limit(0), path)).count() == 0


def test_pieces_of_one_key_are_dealt_to_all_shards(spark):
    checkpoint_dir(spark)
    pieces = spark.range(1000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "1 + id % 9 as length", "7L as ids_crc32")
    shard = Counter(r.sequence_id >> 40 for r in packing.pack(pieces, shard_pieces=50).collect())
    assert sum(shard.values()) == 1000
    assert len(shard) == 20 and max(shard.values()) <= 100


def test_packing_is_tight():
    sizes = np.sort(np.random.default_rng(0).integers(1, 1500, 4000))[::-1]
    sequence, _ = packing.sum_of_squares(sizes, 2048)
    assert sequence.max() + 1 <= 1.01 * sizes.sum() / 2048
    assert np.bincount(sequence, sizes).max() <= 2048


@pytest.mark.parametrize("heavy", [10, 300_000])
def test_lm_score(corpus, rows, heavy):
    got = hmm.score(corpus, heavy=heavy, rounds=1).collect()
    tokens = [[*WORD.findall(low(r[1])), None] for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0 for r in rows]
    count = Counter(t for x, h in zip(tokens, held, strict=True) if not h for t in x)
    n, v = sum(count.values()), len(count)
    want = sorted((str(r[0]), h, len(x), sum(count[t] > 0 for t in x), n, round(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x), 6)) for r, x, h in zip(rows, tokens, held, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_forward_and_baum_welch():
    rng = np.random.default_rng(2)
    k, c = 3, 5
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k))
    texts = [rng.integers(0, c, n).astype(np.int16) for n in (1, 4, 3, 4)]

    def paths(t):
        for p in itertools.product(range(k), repeat=len(t)):
            x = m.start[p[0]] * m.emit[p[0], t[0]]
            for a, b, o in zip(p, p[1:], t[1:], strict=False):
                x *= m.move[a, b] * m.emit[b, o]
            yield p, x

    like = [sum(x for _, x in paths(t)) for t in texts]
    assert hmm.log10_likelihood(m, texts) == pytest.approx(np.log10(like))
    want = np.zeros(k + k * k + k * c)
    for t, z in zip(texts, like, strict=True):
        for p, x in paths(t):
            want[p[0]] += x / z
            for a, b in itertools.pairwise(p):
                want[k + a * k + b] += x / z
            for s, o in zip(p, t, strict=True):
                want[k + k * k + s * c + o] += x / z
    assert hmm.expected_counts(m, texts) == pytest.approx(want)
    assert sum(hmm.log10_likelihood(hmm.Model.of_counts(want, k), texts)) > sum(np.log10(like)) - 0.5


def test_factorisation_machine(spark, corpus):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["sun", "moon", "star", "sky", "sea"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["buy!!", "NOW", "$$$", "click"]) for _ in range(60))
    docs = spark.createDataFrame([(i, good() if i % 3 else bad()) for i in range(400)] + [(400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_fm.fit(docs, labels, rows=200)
    got = {r.doc_id: r for r in quality_fm.classify(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == int(i % 3 > 0) for i in held) >= 0.97 * len(held)
    assert got[400].score == got[401].score
    assert all(0 <= r.score <= 1 for r in quality_fm.classify(corpus, model).collect())
    assert quality_fm.fit(docs.limit(0), labels).score(np.array([0]), np.array([1.0]), np.array([0, 1])) == pytest.approx([0.5])
    # the machine is the sum over pairs
    f, x = np.array([3, 7, 9]), np.array([0.5, 2.0, 1.0])
    raw = model.raw(f, x, np.array([0, 3]))[0][0]
    pairs = sum(model.v[f[i]] @ model.v[f[j]] * x[i] * x[j] for i, j in itertools.combinations(range(3), 2))
    assert raw == pytest.approx(model.w0 + (model.w[f] * x).sum() + pairs)


def test_empty_tables(nothing, spark):
    assert quality_rules.quality_rules(nothing).count() == 0
    assert decontaminate.decontaminate(nothing, spark.createDataFrame(ITEMS, "item_id string, text string")).count() == 0
    assert secrets.scan(nothing).count() == 0
    assert hmm.score(nothing).count() == 0
