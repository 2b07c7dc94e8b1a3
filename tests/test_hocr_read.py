"""hOCR documents read by columns give what Spark's parser gives; only odd ones go through it."""

import pyarrow as pa
import pytest

from leafmill.sources import hocr, hocr_read
from leafmill.sources.hocr_text import FOOT, HEAD


def char(text, title="x_bboxes 1 2 3 4"):
    return f'<span class="ocrx_cinfo" title="{title}">{text}</span>'


def word(*chars, title="bbox 1 2 30 40; x_wconf 90.5"):
    return f'<span class="ocrx_word" title="{title}">{"".join(chars)}</span>'


def line(*words, title="bbox 1 2 30 40; baseline 0.1 -5.0; x_size 20.0"):
    return f'<span class="ocr_line" title="{title}">{"".join(words)}</span>\n'


def par(*lines, title=' title="bbox 5 6 7 8"'):
    return f'<p class="ocr_par"{title}>\n{"".join(lines)}</p>\n'


def page(*pars):
    return HEAD + "".join(pars) + FOOT


A = word(char("a"), char("é", "x_bboxes 11 12 13 14"), char("\U0001f600"))
READ = {
    "plain": page(par(line(A, A), line(word(), A)), par(line(A), title="")), "empty": page(), "bare": page(par(line(word()), line())), "areas": page(par(line(A)), '</div><div class="ocr_carea">', par(line(A)), '</div></div><div class="ocr_page"><div class="ocr_carea">', par(line(A))),
    "signs": page(par(line(word(*map(char, ("&amp;", "&lt;", "&gt;", "&quot;", "&apos;", "&amp;lt;", "\t", " ", "\n", "", "\xa0", "\x85", " x ")))))),
    "char": page(par(line(A, word(char("x", "x_box 1 2 3 4"), char("y", "x_bboxes 1 2 3"), char("z", "x_bboxes 1 2 3 99999999999"), char("u", "x_bboxes 1.9 -2.5 3e1 4;q"), char("v", "x_bboxes 0x1 2 3 4"), char("w", ""))))),
    "word": page(par(line(A, word(char("a"), title="bbox 1 2 3; x_wconf 9"), word(char("b"), title="bbox 1 2 3 4; x_wconf")))), "line": page(par(line(A, title="bbox 1 2 3 4; baseline x -5; x_size 20"), line(A, title="bbox 1 2 3 4; x_size 20"), line(A, title="bbox 1 2 3 4; baseline 0 1"))),
    "late": page(par(line(word(char("a"))), line(word(char("b"), title="")))), "unclosed": page(par(line(A))).replace("</body>", ""), "crossed": page(par(line(A))).replace("</p>", "</span>"), "cut": page(par(line(A)))[: len(HEAD) + 40].rpartition("<")[0], "head": HEAD,
}
ODD = {
    "entity": page(par(line(word(char("&nbsp;"))))), "number": page(par(line(word(char("&#65;"))))), "control": page(par(line(word(char("\x0b"))))), "text": page(par(line(A, "text"))), "class": page(par(line(A)).replace("ocr_line", "ocr_header")), "quotes": page(par(line(A))).replace('"ocrx_word"', "'ocrx_word'"),
    "return": page(par(line(word(char("a\rb"))))), "after": page(par(line(A))) + "<b/>", "end": page(par(line(word(char("]]>"))))), "none": None, "nothing": "", "no body": "<html></html>", "twice": page(par(line(word(char("a"), title='bbox 1 2 3 4" id="x')))), "broken": page(par(line(A)))[:-40],
}


def found(spark, docs):
    p = hocr.parsed(spark.createDataFrame(list(docs.items()), "doc string, content string")).cache()
    by = lambda df: sorted(map(str, df.collect()))
    return {"words": by(hocr.words(p)), "errors": by(hocr.errors(p)), "paragraphs": by(hocr.paragraphs(p)), "documents": by(p.select("doc", "error"))}


def test_columns_are_what_the_parser_reads(spark):
    odd = hocr_read._read(pa.array([*READ.values(), *ODD.values()])).column("odd").to_pylist()
    assert odd == [False] * len(READ) + [True] * len(ODD)
    noted = {k: v.replace("<body>", "<body><!-- so that it is odd -->") for k, v in READ.items()}
    assert all(hocr_read._read(pa.array(list(noted.values()))).column("odd").to_pylist())
    assert found(spark, READ) == found(spark, noted)
    assert {k: e for k, e in (tuple(r) for r in hocr.parsed(spark.createDataFrame(list(ODD.items()), "doc string, content string")).select("doc", "error").collect()) if e} == {k: "malformed" for k in ("entity", "control", "end", "none", "nothing", "broken")} | {"no body": "no body"}


@pytest.mark.parametrize("block", [1, 3000])
def test_documents_are_the_same_in_any_block(monkeypatch, block):
    texts = pa.array([*READ.values(), *ODD.values()] * 2)
    whole = hocr_read._blocks(texts, True)
    monkeypatch.setattr(hocr_read, "BLOCK", block)
    assert hocr_read._blocks(texts, True).to_pylist() == whole.to_pylist()
    assert hocr_read._blocks(texts.slice(5), True).to_pylist() == whole.to_pylist()[5:]


def test_documents_are_read_once_without_sorts(spark):
    docs = spark.createDataFrame(list(READ.items()), "doc string, content string")
    for made in (hocr.words, hocr.errors, hocr.paragraphs):
        plan = made(hocr.parsed(docs))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("+- ArrowEvalPython") == 1 and "Sort" not in plan and plan.count("from_xml") <= 1
