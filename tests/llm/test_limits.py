"""Inputs that once ran into bounds: long types and values, repeated benchmark and labelled rows, many labels, tables that stay behind."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import decontaminate, hmm, jaccard_join, quality_fm, quality_rules, secrets
from leafmill.llm import shared
from leafmill.llm.shared import checkpoint_dir


def literals(text):
    return [text[a:b] for a, k, b in secrets.literal_spans(text, secrets.base_spans(text))]


@pytest.mark.parametrize("size", [90, 120, 10_000])
@pytest.mark.parametrize("form", ["Map<{}>", "Map<String, List<{}>>", "Dict[str, {}]", "Array<Array<Map<a, [b<{}>]>>>"])
def test_types_of_any_length(size, form):
    text = f'let db_password: {form.format("k" * size)} = "hT7kQ2mZx9Lw"'
    assert literals(text) == ["hT7kQ2mZx9Lw"]


def test_brackets_without_end_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        literals("a: b<" * n + "a: b<" + "x" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


@pytest.mark.parametrize("n", [10, 60, 70, 5000])
def test_one_placeholder_rule_at_every_length(n):
    """A joined value is a placeholder or not by the same rule, however long it is."""
    rng = random.Random(n)
    random_part = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNP23456789") for _ in range(n))
    values = {f"<{random_part}>": 0, f"%{random_part}%": 0, f"changeme{random_part}": 0, "x" * n * 2: 0, "." * n * 2: 0, f"xxxx{random_part}xxxx": 1, random_part: 1, "x" * 40 + random_part + "x" * 40: 1, f"<{random_part}": 1}
    for value, looks in values.items():
        cut = rng.randint(1, len(value) - 1)
        joined = secrets.Joined()
        for part in (value[:cut], value[cut:]):
            joined.add(secrets.Joined.of(part))
        assert (joined.score() > 0) == (secrets.literal_score(value) > 0) == bool(looks), value[:50]
        assert joined.score() == pytest.approx(secrets.literal_score(value))


def test_benchmark_rows_that_repeat(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([("q", item)] * 10_000 + [("p", "short one")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {item} it is"), (2, "a short one"), (3, None)], "doc_id long, text string")
    for most in (16 << 20, 50):
        got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate.decontaminate(docs, bench, automaton_bytes=most).collect()}
        assert got == {1: (11, ["q"]), 2: (2, ["p"]), 3: (0, [])}


def test_labelled_rows_that_repeat(spark):
    """A labelled id that stands ten thousand times counts by its distinct texts, and the bound is one of rows."""
    docs = [(i, f"words of text {i} and {i * 7} more") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = spark.createDataFrame(docs, "doc_id long, text string")
    many = spark.createDataFrame(docs + [docs[1]] * 10_000, "doc_id long, text string")
    a, b = quality_fm.fit(once, labels, 30), quality_fm.fit(many, labels, 30)
    assert (a.w == b.w).all() and a.w0 == b.w0
    texts = spark.createDataFrame([(1, f"text number {i}") for i in range(500)], "doc_id long, text string")
    seen = []
    real = quality_fm.FM.fit
    try:
        quality_fm.FM.fit = lambda self, rows, of: seen.append(len(rows)) or self
        quality_fm.fit(texts, labels, 30)
    finally:
        quality_fm.FM.fit = real
    assert seen == [30]


def test_many_labels(spark):
    """5,000 labels, each with too few documents for a reference of its own, and one that has enough."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, say(3), f"l{i}") for i in range(5000)] + [(10_000 + i, say(150), "en") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality_rules.references(docs)
    assert found["labels"] == ["en"] and len(found["words"]) < 2 / quality_rules.SHARE
    assert quality_rules.quality_rules(docs).filter("kept").count() == 12


def test_join_leaves_few_tables(spark, corpus):
    """Tables between steps go once nothing reads them; those that the result reads stay."""
    folder = checkpoint_dir(spark).removeprefix("file://")
    shared.forget_written(spark)
    before = set(os.listdir(folder))
    jaccard_join.jaccard_components(corpus).collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"sketch", "classes", "members", "labels", "edges"}


def test_long_texts_are_trained_on_whole(monkeypatch):
    """Pieces of a long text give the counts of the whole one, moves over their edges included; so does training on it."""
    rng = np.random.default_rng(3)
    m = hmm.Model.first(rng.uniform(1, 9, 12), states=4)
    text = rng.integers(0, 12, 200).astype(np.int16)
    whole = hmm.expected_counts(m, [text])
    for piece in (1, 7, 64, 199, 200, 500):
        assert hmm.long_counts(m, text, piece) == pytest.approx(whole)
    assert whole[4:20].sum() == pytest.approx(199)
    # the step of a task, with a bound that the first text is above
    monkeypatch.setattr(hmm, "TRAIN_TOKENS", 30)
    batch = pa.RecordBatch.from_arrays([pa.array([x.astype("<i2").tobytes() for x in (text, text[:9])])], ["classes"])
    (out,) = hmm._expect(type("Shared", (), {"value": m})())(iter([batch]))
    want = hmm.expected_counts(m, [text]) + hmm.expected_counts(m, [text[:9]])
    assert out.column("x").to_pylist() == pytest.approx(want[want != 0].tolist())


def test_the_model_beats_the_words_alone(spark):
    """On texts that it didn't learn from, the model finds them likelier than their words alone do."""
    rng = random.Random(5)
    kinds = [[f"{c}{i}" for i in range(30)] for c in "abc"]

    def say(n):
        k, out = 0, []
        for _ in range(n):
            k = (k + 1) % 3 if rng.random() < 0.04 else k  # a kind of words lasts
            out.append(rng.choice(kinds[k]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, say(60)) for i in range(300)], "doc_id long, text string").repartition(2)
    held = [r for r in hmm.score(docs, rounds=20).collect() if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)
