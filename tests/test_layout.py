"""Golden values and properties of the layout operators."""

import math

import numpy as np

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.functions import geometry as G
from leafmill.functions import scalars as S
from leafmill.operators import angles as A
from leafmill.operators import blur as B
from leafmill.operators import hierarchy as H
from leafmill.operators import reading_order as R
from leafmill.operators import textlayer as T
from leafmill.sources import hocr, layout, results


def dominant(spark, rows, wrap=360.0, window=5.0):
    df = spark.createDataFrame([(1, float(a), float(w)) for a, w in rows], "page_id long, angle double, weight double")
    got = A.dominant_angle(df, wrap, window).collect()
    return (got[0].angle, got[0].fraction) if got else None


@pytest.mark.parametrize(
    ("rows", "wrap", "angle", "fraction"),
    [
        ([(10, 1)], 360, 10, 1),
        ([(350, 1)], 360, 350, 1),
        ([(360, 1)], 360, 0, 1),
        ([(11, 1), (12, 1), (13, 1), (14, 1)], 360, 12.5, 1),
        ([(358, 1), (359, 1), (0, 1), (1, 1), (2, 1)], 360, 0, 1),
        ([(410, 1)], 100, 10, 1),
        ([(-10, 1)], 360, 350, 1),
        ([(1, 1), (100, 1), (357, 0.5)], 360, -1 / 3, 0.6),
        ([(359.5, 1)], 360, 359.5, 1),
        ([(2, 5), (200, 5)], 360, 2, 0.5),
        ([(16, 1), (17, 1), (18, 1), (19, 1), (20, 1), (25, 10)], 360, 25, 10 / 15),
    ],
)
def test_dominant_angle(spark, rows, wrap, angle, fraction):
    got = dominant(spark, rows, float(wrap))
    assert got == pytest.approx((angle, fraction), abs=1e-6)


def test_dominant_angle_is_half_open_and_turns(spark):
    assert dominant(spark, [(0, 1), (5, 1)])[1] == 0.5
    rows = [(3, 2), (5, 1), (90, 1)]
    assert dominant(spark, rows) == pytest.approx(dominant(spark, [(a + 720, w) for a, w in rows]))
    assert dominant(spark, []) is None
    assert dominant(spark, [(3, 0)]) == (None, None)


def plain_dominant(rows, wrap, window):
    """Windows one by one over sorted angles, with a copy of those below zero."""
    weight = {}
    for a, w in rows:
        weight[a % wrap] = weight.get(a % wrap, 0) + w
    each = sorted([(a, w) for a, w in weight.items()] + [(a - wrap, w) for a, w in weight.items() if a - wrap > -window])
    a, w = np.array([x[0] for x in each]), np.array([x[1] for x in each], float)
    sums, moments = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * a)])
    begin, end = np.searchsorted(a, a - window, "right"), np.arange(1, len(a) + 1)
    density, moment = sums[end] - sums[begin], moments[end] - moments[begin]
    ends = np.flatnonzero(a >= 0)
    best = max(ends, key=lambda i: (density[i], not a[begin[i]] < 0, -a[i]))
    return moment[best] / density[best], density[best] / sum(weight.values())


def test_dominant_angle_of_many_angles(spark):
    """A page of 100,000 distinct angles, half of them within one window, and pages of few; the plan has no frame of ranges."""
    rng = np.random.default_rng(2)
    many = [(float(a), int(w)) for a, w in zip(np.concatenate([rng.uniform(-900, 900, 50_000), rng.normal(359, 0.5, 50_000)]), rng.integers(1, 9, 100_000), strict=True)]
    few = [[(float(a), int(w)) for a, w in zip(rng.integers(-3, 3, n) * rng.choice([1.0, 2.5, 5.0, 90.0]), rng.integers(1, 5, n), strict=True)] for n in rng.integers(1, 12, 150)]
    pages = [many, *few]
    df = spark.createDataFrame([(p, a, float(w)) for p, rows in enumerate(pages) for a, w in rows], "page_id long, angle double, weight double")
    for wrap in (360.0, 90.0):
        found = A.dominant_angle(df, wrap, 5.0)
        got = {r.page_id: (r.angle, r.fraction) for r in found.collect()}
        for p, rows in enumerate(pages):
            assert got[p] == pytest.approx(plain_dominant(rows, wrap, 5.0), abs=1e-6), p
        assert "RangeFrame" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("degrees", "x", "y"), [(0, 0, -20), (-30, 0, -14.226497), (30, 0, -25.773503), (-60, 1.547005, 0), (60, -21.547005, 0)])
def test_moved_baseline(spark, degrees, x, y):
    b = lambda *v: F.struct(*(F.lit(i).alias(n) for i, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)))
    got = spark.range(1).select(G.moved_baseline(F.lit(0.0), F.lit(0.0), F.lit(math.radians(degrees)), b(0, 0, 10, 20), b(10, 10, 30, 40)).alias("m")).first().m
    assert (got.x, got.y) == pytest.approx((x, y), abs=1e-5)


@pytest.mark.parametrize(
    ("title", "want"),
    [("", {}), ("name", {}), ("name;", {}), (";;name;", {}), ("name prop", None), ("name 1", {"name": [1]}), ("name 1.5  2.5", {"name": [1.5, 2.5]}), ("name 1;", {"name": [1]}), ("a 1 2; b 3", {"a": [1, 2], "b": [3]}), ("a 1; a 2", {"a": [2]})],
)
def test_properties(spark, title, want):
    assert spark.range(1).select(S.hocr_properties(F.lit(title)).alias("p")).first().p == want


def test_rotation(spark):
    df = spark.createDataFrame([(1, 92.0, 10.0), (2, 358.0, 10.0), (3, 0.0, 5.0), (3, 45.0, 5.0), (4, 0.0, 1.0)], "page_id long, angle double, weight double")
    got = {r.page_id: round(r.adjust_deg, 6) for r in A.rotation_decision(df).collect()}
    assert got == {1: 92.0, 2: -2.0, 3: 0.0, 4: 0.0}
    got = {r.page_id: round(r.adjust_deg, 6) for r in A.rotation_decision(df, fix_page=False).collect()}
    assert got == {1: 2.0, 2: -2.0, 3: 0.0, 4: 0.0}


DOC = """
<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">
<html xmlns="http://www.w3.org/1999/xhtml"><head><title></title></head><body>
<div class="ocr_page" title="ppageno 0"><div class="ocr_carea"><p class="ocr_par" title="bbox 22 4 634 28">
<span class="ocr_line" title="bbox 22 4 634 28; baseline 0 -5; x_size 20">{words}</span></p></div></div></body></html>"""


def word(box, conf, text):
    chars = "".join(f'<span class="ocrx_cinfo" title="x_bboxes {i} 0 {i + 1} 9">{c}</span>' for i, c in enumerate(text))
    return f'<span class="ocrx_word" title="bbox {box}; x_wconf {conf}">{chars}</span>'


def test_hocr_document(spark):
    text = DOC.format(words=word("22 4 30 24", 85, "A") + word("40 4 90 23", 91, "words") + word("99 4 140 28", 92, "four") + word("150 4 160 28", 92, ""))
    rows = hocr.words(hocr.parsed(spark.createDataFrame([(1, text)], "doc int, content string"))).orderBy("word_no").collect()
    assert [(r.content, r.confidence, r.font_size, r.baseline.y, r.baseline.angle, r.error) for r in rows] == [("A", 0.85, 20, -9, 0, None), ("words", 0.91, 20, -10, 0, None), ("four", 0.92, 20, -5, 0, None)]


def test_hocr_errors(spark):
    good = DOC.format(words=word("22 4 30 24", 85, "A"))
    bad = {"malformed": good.replace("</body>", ""), "no body": "<html><head></head></html>", "word": good.replace("bbox 22 4 30 24", "bbox 22 4 30"), "line": good.replace("baseline 0 -5", "baseline x -5")}
    p = hocr.parsed(spark.createDataFrame(list(bad.items()), "doc string, content string"))
    found = {r.doc: r.error for r in p.collect() if r.error} | {r.doc: r.error for r in hocr.words(p).collect()}
    assert found == {k: k for k in bad}


def test_hocr_round_trip_and_clean_up(spark):
    docs = spark.createDataFrame([(5, "Two words\nand <more> & more\n\nlast"), (8, "x"), (9, None), (10, "")], "doc_id long, text string")
    words = layout.structured(layout.words(docs))
    back = hocr.words(hocr.parsed(hocr.documents(H.nest(words))))
    assert sorted(r.content for r in back.collect()) == sorted(r.content for r in words.collect())
    assert all(r.error is None for r in back.collect())
    pages = H.nest(words)
    all_ = {(r.page_id, r.line_no, r.word_no) for r in H.flat_words(pages).collect()}
    for least in (0.0, 0.3, 0.9, 2.0):
        kept = H.flat_words(H.clean_nested(pages, least))
        got = {(r.page_id, r.line_no, r.word_no) for r in kept.collect()}
        assert got <= all_
        assert got == {(r.page_id, r.line_no, r.word_no) for r in H.confident(words, least).collect()}
        assert got == {(r.page_id, r.line_no, r.word_no) for r in H.flat_words(H.clean_nested(H.clean_nested(pages, least), least)).collect()}


def test_symbols(spark):
    rows = [(1, 1, "TEXT", True, True, True, "a"), (1, 2, "TEXT", False, False, False, "b"), (1, 3, "TEXT", False, False, True, "c"), (1, 4, "NOISE", False, True, True, "z"), (1, 5, "TEXT", False, True, True, ""), (1, 6, "TEXT", False, False, False, "d")]
    df = spark.createDataFrame([(*r, 0, 0, 1, 1, 0.5, 20.0) for r in rows], "page_id long, seq int, block_type string, par_start boolean, line_start boolean, word_start boolean, text string, x1 int, y1 int, x2 int, y2 int, conf double, row_height double")
    got = H.symbols_to_words(df).orderBy("line_no", "word_no").collect()
    assert [(r.line_no, r.content) for r in got] == [(0, "ab"), (0, "c"), (1, "d")]


def test_sobel_and_quantile(spark):
    import numpy as np

    v = np.arange(12).reshape(3, 4) ** 2 % 50
    px = spark.createDataFrame([(1, y, x, int(v[y, x])) for y in range(3) for x in range(4)], "page_id long, y int, x int, v int")
    p = np.pad(v, 1, mode="reflect")
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    want = np.array([[0.5 * (p[y : y + 3, x : x + 3] * (kx + kx.T)).sum() for x in range(4)] for y in range(3)])
    got = np.zeros((3, 4))
    for r in B.gradients(px).collect():
        got[r.y, r.x] = r.g
    assert np.allclose(got, want)
    h = spark.createDataFrame([(1, 0, 3, 2), (1, 0, 7, 2)], "page_id int, cell int, bucket int, n int")
    at = lambda q: B.quantile_index(h, ["page_id", "cell"], q).first()["at"]
    assert [at(0.0), at(0.5), at(0.51), at(1.0)] == [0, 3, 7, 7]
    with pytest.raises(ValueError, match="within"):
        at(1.5)


def test_reading_order_is_a_permutation_and_sorts_columns(spark):
    lines = [(1, 0, i, x, 100 + 40 * row, x + 100, 120 + 40 * row, 0.0, -5.0, 20.0) for i, (row, x) in enumerate([(0, 200), (0, 0), (1, 200), (1, 0), (2, 0), (2, 200)])]
    df = spark.createDataFrame(lines, "page_id long, par_no int, line_at int, x1 int, y1 int, x2 int, y2 int, angle double, base_y double, font double")
    got = R.sorted_lines(df).orderBy("place").collect()
    assert [r.line_at for r in got] == [1, 0, 3, 2, 4, 5]
    docs = spark.createDataFrame([(i, "\n".join("some words stand in this line and then a few more of them" for _ in range(9))) for i in range(8)], "doc_id long, text string")
    frag = layout.fragments(layout.words(docs))
    places = R.sorted_lines(frag).groupBy("page_id", "par_no").agg(F.array_sort(F.collect_list("place")).alias("p"), F.count("*").alias("n")).collect()
    assert all(r.p == list(range(r.n)) for r in places)


def test_glyphs_of_unequal_widths(spark):
    edges = {"Wil": [30, 52, 57, 63], "mm": [70, 91, 108]}
    char = lambda a, b, c: f'<span class="ocrx_cinfo" title="x_bboxes {a} 10 {b} 30">{c}</span>'
    spans = "".join(f'<span class="ocrx_word" title="bbox {e[0]} 10 {e[-1]} 30; x_wconf 90">' + "".join(char(a + (i > 0), b, c) for i, (a, b, c) in enumerate(zip(e, e[1:], w, strict=False))) + "</span>" for w, e in edges.items())
    text = f'<html><body><div class="ocr_page"><div class="ocr_carea"><p class="ocr_par"><span class="ocr_line" title="bbox 30 10 108 30; baseline 0 -4; x_size 20">{spans}</span></p></div></div></body></html>'
    words = hocr.words(hocr.parsed(spark.createDataFrame([(1, text)], "page_id int, content string")), "page_id")
    flat = words.select("page_id", "par_no", "line_no", "word_no", "box.*", F.degrees("baseline.angle").alias("angle_deg"), F.col("baseline.angle").alias("angle"), F.col("baseline.y").alias("word_y"), "font_size", "content", "char_boxes", F.size("char_boxes").alias("n_chars"))
    level = T.leveled_lines(layout.with_lines(flat)).cache()
    starts = {w: [e[0], *(x + 1 for x in e[1:-1]), e[-1]] for w, e in edges.items()}
    want = {w: [b - a for a, b in zip(x, x[1:], strict=False)] for w, x in starts.items()}
    got = [(r.word_no, r.char_no, r.text, r.advance) for r in T.char_advances(level).collect()]
    assert sorted(got) == [(n, i, w[i], x) for n, w in enumerate(edges) for i, x in enumerate(want[w])]
    pens = {(r.word_no, r.char_no): r.x for r in T.glyph_pens(level).collect()}
    assert pens == {(n, i): x for n, w in enumerate(edges) for i, x in enumerate(starts[w][:-1])}
    font = level.first().font
    rows = T.text_layer(level, 500.0).collect()
    assert {(r.word_no, r.char_no): r.stretch for r in rows if r.text != " "} == pytest.approx({(n, i): 100 * x / (font / 2) for n, w in enumerate(edges) for i, x in enumerate(want[w])}, abs=1e-5)
    assert [(r.word_no, r.char_no, r.stretch) for r in rows if r.text == " "] == [(0, 3, 20.0), (1, 2, 20.0)]
    assert {(r.a, r.b, r.c, r.d, r.line_x, r.line_y) for r in rows} == {(1.0, 0.0, 0.0, 1.0, 30.0, 500.0 - 25)}
    odd = T.text_layer(level.filter("word_no = 0").withColumn("char_boxes", F.slice("char_boxes", 1, 2)).withColumn("n_chars", F.lit(2))).collect()
    whole = 100 * (63 - 30) / 3 / (font / 2)  # by code points, not by boxes
    assert [(r.char_no, r.text, r.stretch) for r in odd] == [(-1, "Wil", pytest.approx(whole, abs=1e-5)), (-2, " ", pytest.approx(whole * 0.2, abs=1e-5))]


def test_hocr_paragraphs_sizes_and_strict_mode(spark):
    good = DOC.format(words=word("22 4 30 24", 85, "A"))
    docs = {"own": good.replace("bbox 22 4 634 28", "bbox 1 2 700 90", 1), "none": good.replace(' title="bbox 22 4 634 28"', "", 1), "empty": DOC.format(words=word("22 4 30 24", 85, ""))}
    got = hocr.paragraphs(hocr.parsed(spark.createDataFrame(list(docs.items()), "doc string, content string"))).collect()
    assert {r.doc: tuple(r.box) for r in got} == {"own": (1, 2, 700, 90), "none": (22, 4, 634, 28)}
    sizes = {"missing": good.replace("; x_size 20", ""), "two": good.replace("x_size 20", "x_size 20 3"), "word": good.replace("x_size 20", "x_size big")}
    words = hocr.words(hocr.parsed(spark.createDataFrame(list(sizes.items()), "doc string, content string")))
    assert {r.doc: r.error for r in words.collect()} == dict.fromkeys(sizes, "line")
    fine = hocr.words(hocr.parsed(spark.createDataFrame([("d", good)], "doc string, content string")))
    assert hocr.strict(fine).count() == 1
    with pytest.raises(Exception, match="bad line in document"):
        hocr.strict(words).collect()


def test_symbols_to_pages(spark):
    rows = [(1, 1, True, True, True, "a", 10, 20, 18, 40), (1, 2, False, False, False, "b", 18, 22, 25, 41), (1, 3, False, False, True, "c", 40, 25, 48, 44), (1, 4, True, True, True, "d", 10, 60, 18, 80)]
    schema = "page_id long, seq int, par_start boolean, line_start boolean, word_start boolean, text string, x1 int, y1 int, x2 int, y2 int"
    df = spark.createDataFrame(rows, schema).withColumns({"block_type": F.lit("TEXT"), "conf": F.lit(0.5), "row_height": F.lit(20.0)})
    page = H.symbols_to_pages(df).first()
    assert [tuple(p.box) for p in page.paragraphs] == [(10, 20, 48, 44), (10, 60, 18, 80)]
    line = page.paragraphs[0].lines[0]
    assert [(w.content, tuple(w.box), w.baseline.y, [tuple(b) for b in w.char_boxes]) for w in line["words"]] == [("ab", (10, 20, 25, 41), 3.0, [(10, 20, 18, 40), (18, 22, 25, 41)]), ("c", (40, 25, 48, 44), 0.0, [(40, 25, 48, 44)])]
    sloped = df.withColumns({"base_x1": F.lit(10), "base_y1": F.lit(38), "base_x2": F.lit(48), "base_y2": F.lit(42), "orientation": F.lit("UP")})
    line = H.symbols_to_pages(sloped.filter("seq < 4")).first().paragraphs[0].lines[0]
    slope = 4 / 38
    assert (line.baseline.x, line.baseline.y, line.baseline.angle) == pytest.approx((0, -6, np.arctan(slope)))
    assert [w.baseline.y for w in line["words"]] == pytest.approx([38 - 41, 38 - slope * 30 - 44])


def test_manifest_forms(spark):
    pages = spark.createDataFrame([(i * 40_000_000, i != 1, i != 2) for i in range(5)], "page_id long, has_image boolean, has_result boolean")
    got = T.export_manifest(pages).orderBy("page_id").collect()
    assert [(r.file, r.error) for r in got] == [("scan-1.png", None), ("scan-2.png", "no image"), ("scan-3.png", "no result"), ("scan-4.png", None)]
    assert [r.error for r in T.export_manifest(pages, mode="RAW").orderBy("page_id").collect()] == [None, "no image", None, None]
    assert [(r.file, r.file_page) for r in T.export_manifest(pages, form="pdf").orderBy("page_id").collect()] == [("scan.pdf", i) for i in (1, 2, 3, 4)]


def test_quantiles_of_arrays_and_blur_of_other_coefficients(spark):
    rng = np.random.default_rng(3)
    px = spark.createDataFrame([(1, y, x, int(v)) for y in range(20) for x in range(64) for v in [rng.integers(0, 255)]], "page_id long, y int, x int, v int")
    cells = layout.cells(px)
    hist = B.histogram(B.inside(cells, px), ["page_id", "cell"], "v")
    arrays = hist.groupBy("page_id", "cell").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("h"))
    for q in (0.05, 0.5, 0.95, 1.0):
        want = {r.cell: r["at"] for r in B.quantile_index(hist, ["page_id", "cell"], q).collect()}
        assert {r.cell: r["at"] for r in arrays.select("cell", B.quantile_of(F.col("h"), q).alias("at")).collect()} == want
    measured = B.measures(cells, px).cache()
    for coef in (0.01, 0.5):
        assert {(r.cell, r.blurred) for r in B.flagged(measured, coef).collect()} == {(r.cell, r.blurred) for r in B.blurred(cells, px, coef).collect()}


def test_rounding_is_that_of_decimals(spark):
    """Doubles rounded in double arithmetic, but for the few that are as near a half as to need decimals."""
    g = np.random.default_rng(5)
    halves = (np.arange(-4000, 4000) + 0.5) / 10.0 ** g.integers(0, 8, 8000)
    each = [halves, np.nextafter(halves, 9), np.nextafter(halves, -9), g.normal(0, 1, 4000) * 10.0 ** g.integers(-12, 18, 4000), g.integers(-(10**6), 10**6, 4000) / 7.0, [0.0, -0.0, -1e-9, 1e300, -1e300, math.inf, -math.inf, math.nan]]
    x = [(float(v),) for v in np.concatenate(each)] + [(None,)]
    rows = spark.createDataFrame(x, "x double")
    for digits in (0, 3, 4, 6):
        bad = rows.select("x", S.rounded(F.col("x"), digits).alias("got"), F.round("x", digits).alias("want")).filter("not got <=> want or string(got) <> string(want)")
        assert bad.collect() == []


@pytest.mark.parametrize("name", ["rotated_pen", "word_pen", "baseline_transfer", "word_baseline_hocr", "scalar_angles", "flat_line_level", "stretch"])
def test_numbers_are_rounded_without_decimals(spark, monkeypatch, name):
    """Each rounding through decimals has its condition, and what is rounded is worked out once."""
    docs = spark.createDataFrame([(3, "one two\nthree")], "doc_id long, text string")
    monkeypatch.setattr(layout, "table", lambda *_: docs)
    last = entry.queries()[name](spark, "")._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert last.count("round(") and last.count("FLOOR(") == 2 * last.count("round(") and "tan(" not in last.lower()


def test_result_tables(spark, tmp_path):
    words = spark.createDataFrame([(5, 1, "a"), (10_007, 1, "b")], "page_id long, word_no int, content string")
    results.write(words, str(tmp_path / "words"))
    assert sorted(p.name for p in (tmp_path / "words").glob("part=*")) == ["part=0", "part=1"]
    assert sorted(r.content for r in results.read(spark, str(tmp_path / "words"), 10_007).collect()) == ["b"]


def test_single_values_and_units(spark):
    row = spark.range(1).select(S.single(F.array(F.lit(2.5))).alias("one"), S.single(F.array(F.lit(1.0), F.lit(2.0))).alias("two"), S.single(F.array().cast("array<double>")).alias("none"), S.mm_to_inch(S.inch_to_mm(F.lit(3.0))).alias("back")).first()
    assert (row.one, row.two, row.none) == (2.5, None, None)
    assert row.back == pytest.approx(3)


def plain_keys(y, font):
    """The key of each good line of a paragraph, by the rule as it is written: loops over a histogram."""
    low, high = min(y), max(y)
    size = font / 10
    if high - low <= 0 or high - low < 5 * size:
        return [(low + high) / 2] * len(y)
    counts = [0] * (int((high - low) / size) + 2)
    for v in y:
        counts[int((v - low) / size)] += 1
    keys = [None] * len(y)
    while sum(counts):
        best, most = 0, 0
        for start in range(len(counts) - 5):
            n = sum(counts[start : start + 5])
            if n > most:
                best, most = start, n
        centre = math.floor(sum(i * counts[i] for i in range(best, best + 5)) / most + 0.5)
        a, b = max(centre - 5, 0), min(centre + 6, len(counts))
        low_y, high_y = low + a * size, low + b * size
        for i, v in enumerate(y):
            if keys[i] is None and low_y <= v <= high_y:
                keys[i] = (low_y + high_y) / 2
        for i in range(a, b):
            counts[i] = 0
    return keys


def plain_places(own):
    """line_at of a paragraph's lines (page, par, line_at, x1, y1, x2, y2, angle, base_y, font) in reading order."""
    own = sorted(own, key=lambda r: r[2])
    mean = sum(r[7] for r in own) / len(own)
    font = sum(r[9] for r in own) / len(own)
    middle = (min(r[3] for r in own) + max(r[5] for r in own)) / 2
    good = [r for r in own if abs(r[7] - mean) < math.radians(2)]
    y = {r[2]: r[6] + r[8] + math.tan(r[7]) * (middle - r[3]) for r in good}
    if len(good) < 3 or font < 10 or (max(y.values()) - min(y.values())) / font > 200:
        return [r[2] for r in own]
    key = dict(zip(y, plain_keys(list(y.values()), font), strict=True))
    return [r[2] for r in sorted(own, key=lambda r: (key.get(r[2], r[6] + r[8]), r[3] if r[2] in key else -math.inf, r[2]))]


def test_reading_order_against_a_plain_version(spark):
    """3,000 paragraphs of skewed lines with strays, some of them small, wide or of one height; heights in halves, so that means and edges of buckets meet."""
    rng = np.random.default_rng(5)
    rows = []
    for page in range(3000):
        n, font = int(rng.integers(1, 26)), float(rng.choice([8, 10, 20, 20, 20, 33]))
        tilt, step = float(rng.choice([0, 0, 0.004, -0.01])), int(rng.choice([0, 1, 3, 11, 40, 900]))
        for i in range(n):
            x, top = int(rng.integers(0, 6)) * 100, 100 + step * int(rng.integers(0, n)) + int(rng.integers(0, 4))
            angle = tilt + (0.2 if rng.random() < 0.06 else 0.0)
            rows.append((page, 0, i, x, top, x + 90, top + 20, angle, -5.0, font))
    df = spark.createDataFrame(rows, "page_id long, par_no int, line_at int, x1 int, y1 int, x2 int, y2 int, angle double, base_y double, font double")
    got = {}
    for r in R.sorted_lines(df.repartition(5)).orderBy("page_id", "place").collect():
        got.setdefault(r.page_id, []).append(r.line_at)
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    assert got == {page: plain_places(own) for page, own in want.items()}


def test_chars_and_boxes_without_arrays_in_rows(spark):
    """flat_chars by ordinals, and boxes made in batches, are those of char_boxes."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one  two\n\n three é four ", None, "", "x \U0001f600y\n" * 30, " a"])], "doc_id long, text string")
    words = layout.lined_words(docs).withColumn("n_chars", F.when(F.col("word_no") == 1, 0).otherwise(F.col("n_chars")))
    arrays, bare = layout.structured(words), layout.structured(words, boxes=False)
    want = sorted(map(str, H.flat_chars(arrays).collect()))
    got = H.flat_chars(bare, layout.box_at)
    assert sorted(map(str, got.collect())) == want and len(want) > 30
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
    made = bare.mapInArrow(lambda batches: (b.select([*H.LEVELS, "char_boxes"]) for b in map(layout.boxed, batches)), arrays.select(*H.LEVELS, "char_boxes").schema)
    assert sorted(map(str, made.collect())) == sorted(map(str, arrays.select(*H.LEVELS, "char_boxes").collect()))
