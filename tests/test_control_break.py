"""The control break against a loop over symbols, in batches of every size."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.operators import control_break as C
from leafmill.operators import hierarchy as H


def symbols(rng):
    rows, seq = [], 0
    for page in [None, *range(12)]:
        for i in range(rng.choice([0, 1, 2, 40, 90])):
            word = i == 0 and rng.random() < 0.9 or rng.random() < 0.3
            line = word and rng.random() < 0.3
            rows.append((page, seq, line and rng.random() < 0.4 or (None if rng.random() < 0.05 else False), line, word, rng.choice(["a", "b", "é", "xy", "", None, "ß"]), i, i + 1, i + 9, i + 20, rng.choice([0.5, 0.25, None]), rng.choice([10.0, 20.0, None])))
            seq += rng.randint(1, 3)
    return rows


def plain(rows):
    out, at, levels = [], object(), None
    words = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if r[0] != at:
            at, levels = r[0], [-1, -1, -1]
        for i in range(3):
            levels[i] += bool(r[2 + i])
        if r[5]:
            words.setdefault((r[0], levels[2]), []).append((*levels, r))
    for (page, no), held in words.items():
        own = [x[3] for x in held]
        conf, font = [r[10] for r in own if r[10] is not None], [r[11] for r in own if r[11] is not None]
        out.append((page, held[0][0], held[0][1], no, "".join(r[5] for r in own), min(r[6] for r in own), min(r[7] for r in own), max(r[8] for r in own), max(r[9] for r in own), sum(conf) / len(conf) if conf else None, max(font, default=None), len(own), [r[6:10] for r in own]))
    return sorted(out, key=str)


SCHEMA = "page_id long, seq int, par_start boolean, line_start boolean, word_start boolean, text string, x1 int, y1 int, x2 int, y2 int, conf double, row_height double"


def seen(rows):
    return sorted(((*(r[c] for c in (x.split()[0] for x in C.WORDS.split(", "))), [tuple(b[e] for e in C.EDGES) for b in r["char_boxes"]]) for r in rows), key=str)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_batches_of_every_size(size):
    rng = random.Random(size)
    rows = symbols(rng)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = dict(page_id=pa.int64(), seq=pa.int32(), text=pa.string(), conf=pa.float64(), row_height=pa.float64(), **dict.fromkeys(C.FLAGS, pa.bool_()), **dict.fromkeys(C.EDGES, pa.int32()))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in ordered[at : at + size]], types[n]) for i, n in enumerate(names)], names) for at in range(0, len(ordered), size)]
    got = [r for b in C._broken(True)(iter(batches)) for r in b.to_pylist()]
    assert seen(got) == plain(rows)


def test_in_spark_and_no_symbols(spark):
    rows = symbols(random.Random(77))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("block_type", F.lit("TEXT"))
    assert seen(r.asDict(True) for r in H.symbols_to_words(df, boxes=True).collect()) == plain(rows)
    assert H.symbols_to_words(df.limit(0)).collect() == []


def test_one_sort_and_no_exchange_after_dealing_by_page(spark):
    df = spark.createDataFrame(symbols(random.Random(3)), SCHEMA).withColumn("block_type", F.lit("TEXT")).repartition("page_id")
    plan = H.symbols_to_words(df, dealt=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and "Aggregate" not in plan
