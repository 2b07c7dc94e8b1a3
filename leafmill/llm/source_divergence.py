"""Source divergence audit over a cube of (group block, group block, term block).

The groups of a language are its sources. Their term counts are cut into slices, one for each group and block of terms. A cell of the
cube owns two blocks of groups and one block of terms: the slices that it needs are sent to it, it sums the differences of all its
pairs of groups over its own terms alone, and the partial sums of a pair meet along the term axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import forget, written

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Groups and terms on the edges of a cell: a cell's matrices take 2 * GROUP_BLOCK * TERM_BLOCK * 8 bytes.
GROUP_BLOCK, TERM_BLOCK = 64, 1024

# Bytes that are no part of a term, after lower-casing A-Z.
NOT_TERM = np.zeros(256, bool)
NOT_TERM[:0x80] = True
NOT_TERM[ord("a") : ord("z") + 1] = False

_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTIAL = "lang string, a string, b string, part long"


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.cast(pa.string()).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each (lang, source) in a block of texts, with their occurrences and the documents that hold them."""
    for batch in batches:
        lang, langs = _codes(K.column(batch, "lang"))
        source, sources = _codes(K.column(batch, "source"))
        for block in K.blocks(K.column(batch, "text"), lower=True):
            words = K.tokens(block, NOT_TERM)
            if not len(words.start):
                continue
            ends = np.zeros(len(words.start) + 1, np.int64)
            np.cumsum(words.end - words.start, out=ends[1:])
            held = block.data[~NOT_TERM[block.data]]
            terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(held)]).dictionary_encode()
            width = len(terms.dictionary)
            in_doc, n = np.unique(words.row * width + terms.indices.to_numpy(), return_counts=True)
            row, term = in_doc // width, in_doc % width
            group = lang[block.first + row] * len(sources) + source[block.first + row]
            in_group, at = np.unique(group * width + term, return_inverse=True)
            group, term = in_group // width, in_group % width
            take = lambda values, index: pc.cast(values.take(pa.array(index)), pa.string())
            sums = (np.bincount(at, n).astype(np.int64), np.bincount(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([take(langs, group // len(sources)), take(sources, group % len(sources)), take(terms.dictionary, term), *map(pa.array, sums)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``docs`` (lang, source, text, none null): occurrences of each term and documents that hold it. Blocks of texts are counted before the exchange, and tasks combine their blocks."""
    each = docs.select("lang", "source", "text").mapInArrow(K.tidy(_counted), _COUNTS)
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)) by whole numbers; null without terms."""
    wide = lambda x: x.cast("decimal(24,0)")
    above, below = (wide(n) + F.lit(SMOOTHING)) * F.lit(SCALE), wide(total) + F.lit(SMOOTHING) * wide(terms)
    return F.when(terms > 0, 1 + F.call_function("div", above, below)).cast("long")


def _cell(slices: pa.Table) -> pa.Table:
    """The partial sums of a cell: |p - q| over its terms, for each pair of its groups. Slices of the first group block have side 0, of the second side 1; in a cell on the diagonal there is one side."""
    slices = slices.sort_by("source")  # a pair has one order in all cells
    side = slices["side"].to_numpy()
    source = np.array(slices["source"].to_pylist(), object)
    rest = slices["rest"].to_numpy()
    width = int(slices["n_terms"][0].as_py())
    held = slices["held"].combine_chunks()
    flat, at = held.flatten(), np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy())
    p = np.repeat(rest[:, None], width, axis=1)
    p[at, flat.field("id").to_numpy()] = flat.field("p").to_numpy()
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(second) and slices["bi"][0].as_py() == slices["bj"][0].as_py()
    a, b, sums = [], [], []
    for i, x in enumerate(first):
        others = first[i + 1 :] if alone else second
        if len(others):
            a += [source[x]] * len(others)
            b += source[others].tolist()
            sums.append(np.abs(p[others] - p[x]).sum(axis=1))
    lang = slices["lang"][0].as_py()
    return pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(np.concatenate(sums) if sums else np.zeros(0, np.int64), pa.int64())], ["lang", "a", "b", "part"])


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text; other columns are ignored, whatever their names).

    Part ``pair``: for each other source of the language (item) the sum over the language's kept terms (those in ``min_docs`` of its documents or more) of the differences
    between the smoothed shares of both. Part ``term``: the ``top`` terms of the group whose share is above the language's, by the difference. Ranks count from 1
    by value, largest first, then by item in order of bytes. A null lang, source or text counts as empty: the empty name is a language or source like any other,
    an empty text has no terms. Sources without terms are groups too, and a language without kept terms gives pairs of value 0 and no terms. A language with
    one source gives nothing, no rows give none. Repeated rows count as often as they come.

    Cells take ``group_block`` groups a side and about ``term_block`` terms; their number grows with groups^2 * terms as the work does, and a slice is sent to one cell for each block of groups.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = written(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= min_docs).select("lang", "term", "n")
    kept = written(kept, "terms")
    held = written(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"]), "held")
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    blocks = lambda n, per: F.greatest(F.lit(1), F.ceil(n / per)).cast("int")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(size, "lang", "left").na.fill(0)
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(sources, "lang").select("*", blocks(F.col("terms"), term_block).alias("term_blocks"), blocks(F.col("sources"), group_block).alias("group_blocks"))
    groups = groups.withColumn("bg", F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int"))
    groups = written(groups, "groups")
    forget(counts)

    # term blocks: a term's number within its block is its place in the cell's matrices
    named = kept.join(size.select("lang", "terms"), "lang").withColumn("bt", F.pmod(F.xxhash64("term"), blocks(F.col("terms"), term_block)).cast("int"))
    block = W.partitionBy("lang", "bt")
    placed = named.select("lang", "term", "bt", (F.row_number().over(block.orderBy("term")) - 1).alias("id"))
    in_block = placed.groupBy("lang", "bt").agg(F.count("*").cast("int").alias("n_terms"))
    own = groups.select("lang", "source", "total", "terms", "lang_total")
    shares = held.join(own, ["lang", "source"]).select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))

    # slices: one for each group and term block, also where the group has none of its terms
    packed = shares.join(placed, ["lang", "term"]).groupBy("lang", "source", "bt").agg(F.collect_list(F.struct("id", "p")).alias("held"))
    every = groups.filter("sources > 1").select("lang", "source", "bg", "group_blocks", F.coalesce(_share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0)).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("bt"))
    empty = F.array().cast("array<struct<id:int,p:bigint>>")
    slices = every.join(packed, ["lang", "source", "bt"], "left").join(in_block, ["lang", "bt"], "left").withColumns({"held": F.coalesce("held", empty), "n_terms": F.coalesce("n_terms", F.lit(0))})
    sent = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    low, high = F.least("bg", "other").alias("bi"), F.greatest("bg", "other").alias("bj")
    cells = sent.select("lang", "source", "rest", "bt", "held", "n_terms", low, high, (F.col("bg") > F.col("other")).cast("int").alias("side"))
    partial = cells.groupBy("lang", "bi", "bj", "bt").applyInArrow(_cell, _PARTIAL)
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("pair"), "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = both.select("lang", "pair.source", F.lit("pair").alias("part"), "pair.item", "value").select("*", rank)

    above = shares.join(named.select("lang", "term", F.col("n").alias("lang_n")), ["lang", "term"]).join(own.select("lang", "source", "terms", "lang_total"), ["lang", "source"])
    above = above.withColumn("value", F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).filter("value > 0")
    tops = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").select("*", rank).filter(F.col("rank") <= top)
    return pairs.unionByName(tops)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _share_sql(n: str, total: str, terms: str) -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({n} + {SMOOTHING})) // ({total} + {SMOOTHING} * {terms}))"


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
each AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM each GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
grp AS (SELECT lang, source, coalesce(s.v, 0) AS v, coalesce(s.n, 0) AS lang_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN size s USING (lang)),
has AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS n FROM has GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS own, {_share_sql("coalesce(h.n, 0)", "coalesce(t.n, 0)", "g.v")} AS p, {_share_sql("k.n", "g.lang_n", "g.v")} AS q
  FROM grp g JOIN kept k USING (lang) LEFT JOIN has h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE own > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP}
"""
