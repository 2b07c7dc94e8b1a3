"""The pipeline's stages against plain versions, each on its own input."""

import itertools
import re
from collections import Counter, defaultdict

from plain import WORD, low

import __spark_entry__ as entry
import corpus_pipeline as P
from leafmill.llm.quality_rules import quality_rules
from leafmill.llm.shared import written

ITEM = "these are the ten words that one benchmark question consists of"


def plain_lines(docs):
    sites, first = defaultdict(set), {}
    for d, t, s in sorted(docs):
        for i, x in enumerate(t.split("\n")):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
                first.setdefault(x.strip(" "), (d, i))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if not (x.strip(" ") and len(sites[x.strip(" ")] - {None}) >= 6 and first[x.strip(" ")] != (d, i))) for d, t, _ in docs}


def plain_kept(docs):
    """Ids that are the smallest of their component."""
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(low(t))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    least = {d: d for d in docs}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(docs), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {d for d in docs if least[d] == d}


def test_stages(spark, unique, tmp_path):
    spark.createDataFrame([("q", ITEM)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    filler = [r.text for r in unique.orderBy("doc_id").collect() if r.doc_id < 120 and len(set((r.text or "").split())) > 70][:2]
    extra = [(9000 + i, f"{chr(32).join(reversed(t.split()))} {ITEM.upper()}, and more", "en", "s1", 1) for i, t in enumerate(filler)]
    extra += [(9100 + i, f"{t} end", "en", "s1", 1) for i, t in enumerate(filler)]
    docs = written(unique.select(*P.COLUMNS).union(spark.createDataFrame(extra, unique.select(*P.COLUMNS).schema)), "start")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "packing"]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), name)
        rows = out.collect()
        if name != "packing":
            assert out.columns == P.COLUMNS
            after = {r.doc_id: r for r in rows}
            assert len(after) == len(rows)
        if name == "quality_rules":
            assert set(after) == {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
            assert all(after[d] == before[d] and len(WORD.findall(after[d].text)) >= 50 for d in after)
        elif name == "line_dedup":
            assert {d: r.text for d, r in after.items()} == plain_lines([(d, r.text, r.source) for d, r in before.items()])
        elif name == "jaccard_join":
            assert set(after) == plain_kept({d: r.text for d, r in before.items()})
            assert len(after) < len(before)
        elif name == "decontaminate":
            words = {d: " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(r.text))) + " " for d, r in before.items()}
            grams = [" " + " ".join(ITEM.split()[i : i + 10]) + " " for i in range(len(ITEM.split()) - 9)]
            assert set(after) == {d for d, t in words.items() if not any(g in t for g in grams)}
            assert len(after) < len(before)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(P.tokenizer_path())
            total = Counter()
            for r in rows:
                total[r.doc_id] += r.length
            assert total == {d: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in before.items()}
            assert max(Counter({s: sum(r.length for r in g) for s, g in itertools.groupby(sorted(rows, key=lambda r: r.sequence_id), key=lambda r: r.sequence_id)}).values()) <= 2048
        docs, before = out, ({} if name == "packing" else after)


def test_one_row_of_each_component(spark, corpus, rows):
    docs = corpus.select(*P.COLUMNS)
    docs = written(docs.union(docs.filter("doc_id is null or doc_id % 2 = 0")).repartition(5), "twice")
    every = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    words = {i: r for i, r in enumerate(every) if WORD.search(r.text or "")}
    kept = plain_kept({i: r.text for i, r in words.items()})
    got = P.near_duplicates(spark, docs, "").collect()
    ids = Counter(r.doc_id for r in got)
    assert ids == Counter(r.doc_id for i, r in enumerate(every) if i in kept or i not in words)
    assert set(got) <= set(every)
    # no two of those left are linked
    left = {i: r.text for i, r in enumerate(got) if WORD.search(r.text or "")}
    assert plain_kept(left) == set(left)


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_on_odd_tables(spark, corpus, tmp_path):
    """Nulls in any column, repeated rows and ids, clashing columns; and no rows at all."""
    spark.createDataFrame([("q", ITEM), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    start = corpus.union(corpus.filter("doc_id is null or doc_id % 2 = 0"))
    for docs in (written(start, "odd"), written(start.limit(0), "none")):
        for name, stage in P.STAGES:
            before = docs.count()
            docs = written(stage(spark, docs, str(tmp_path)), name)
            if name == "packing":
                assert docs.count() >= before
            else:
                assert docs.columns == P.COLUMNS
                assert docs.count() <= before
                assert docs.select(*P.COLUMNS).subtract(start.select(*P.COLUMNS)).isEmpty() or name != "quality_rules"
