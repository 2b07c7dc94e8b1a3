"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash is built and merged by aggregation. Lines whose estimate is far
above the threshold are boilerplate, those far below aren't, and the lines near it get an exact distinct count.
A boilerplate line goes everywhere but at its first place (smallest doc_id, then earliest line), so one copy stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 6
#: Sketches have 2**LG_K registers; an estimate is off by more than BAND of itself in fewer than one line in 10,000 (4 standard errors of 1.04 / sqrt(2**LG_K)), and at few sites sketches are exact, as they are at the default MIN_SITES; with a threshold of hundreds, that share of lines outside the band is decided by its estimate.
LG_K = 10
BAND = 4 * 1.04 / 2 ** (LG_K / 2)
#: Lines are broadcast up to so many (some 50 bytes each); beyond that they are joined by shuffle, where AQE splits a line that stands everywhere.
BROADCAST_LINES = 500_000


def _lines(docs: DataFrame) -> DataFrame:
    """The lines that aren't blank: doc, text_hash, site, line_no, and a hash of the line without outer spaces."""
    line = F.trim("line")
    each = docs.select("doc", "text_hash", "site", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return each.filter(line != "").select("doc", "text_hash", "site", "line_no", F.xxhash64(line).alias("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Lines (as hashes) that stand on ``min_sites`` sites or more, with the place that stays (kept: doc, text_hash, line_no); null sites count as none. Written.

    One aggregation, combined before its shuffle, gives sketch and first place of each line, so a line that stands everywhere is a row of each task."""
    each = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(F.struct("doc", "text_hash", "line_no")).alias("kept"))
    maybe = written(each.filter(F.col("sites") >= min_sites * (1 - BAND) - 1), "lines")
    sure = F.col("sites") > min_sites * (1 + BAND) + 1
    near = maybe.filter(~sure).select("line")
    # lines far above the threshold take no part here: few near ones are looked up where lines are read; else sites are made distinct before lines meet
    if near.count() <= broadcast_lines:
        pairs = lines.select("line", "site").join(F.broadcast(near), "line").distinct()
    else:
        pairs = lines.select("line", "site").distinct().join(near, "line")
    exact = pairs.groupBy("line").agg(F.count("site").alias("n")).filter(F.col("n") >= min_sites).select("line")
    return written(maybe.filter(sure).select("line", "kept").union(maybe.join(exact, "line").select("line", "kept")), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` (doc_id, text, source; other columns stay) with n_lines (lines that aren't blank), n_removed and kept_text, the lines that stay joined by newlines.

    Lines are compared without outer spaces. A null or empty text has no lines and an empty kept_text; a null source is no site. Rows with a null doc_id come
    first in the order of places; rows that share a doc_id come in order of a hash of their texts, and fully repeated rows share their places. Columns of
    ``docs`` named like those added are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "kept_text")
    names = docs.columns
    own = docs.select(F.struct(*names).alias("row"), "doc_id", "text", F.col("source").alias("site"))
    own = own.select("row", "site", keyed_columns(own)[0], keyed_columns(own)[1], F.coalesce("text", F.lit("")).alias("text"))
    lines = _lines(own)
    found = boilerplate(lines, min_sites, broadcast_lines)
    hit = lines.select("doc", "text_hash", "line_no", "line").join(F.broadcast(found) if found.count() <= broadcast_lines else found, "line")
    gone = hit.filter(F.struct("doc", "text_hash", "line_no") != F.col("kept"))
    marks = gone.groupBy("doc", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    parts = F.split("text", "\n", -1)
    out = own.join(marks, ["doc", "text_hash"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    return out.select("row.*", F.size(F.filter(parts, lambda x: F.trim(x) != "")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))


def keyed_columns(docs: DataFrame) -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH line AS (
  SELECT doc_id, source, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, source, coalesce(text, '') AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), boiler AS (
  SELECT trim(line) AS line, min((doc_id, line_no)) AS kept FROM line WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.*, coalesce((l.doc_id, l.line_no) <> b.kept, false) AS gone FROM line l LEFT JOIN boiler b ON b.line = trim(l.line)
)
SELECT doc_id, count(*) FILTER (trim(line) <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
