"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

Every stage takes nulls in any column, repeated rows and ids, and tables without rows (which give none); it returns the columns of ``documents`` (packing its own) and leaves others out, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.decontaminate import decontaminate
from leafmill.llm.jaccard_join import representatives
from leafmill.llm.line_dedup import remove_boilerplate
from leafmill.llm.packing import pack, token_pieces, tokenizer_path
from leafmill.llm.quality_rules import quality_rules
from leafmill.llm.shared import checkpoint_dir, written
from leafmill.llm.superkmers import row_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text goes, as do all texts under 50 words; repeated rows stay or go together; a null lang is judged by the pooled references."""
    return quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many sites share but for the first place of each. A null text stays null, a null source is no site, and fully repeated rows share their places. n_chars follows the text where lines went."""
    found = remove_boilerplate(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    return found.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: of the smallest id (nulls last), then the smallest text hash, and one of rows equal in both; documents without words stay."""
    docs = docs.select(*COLUMNS)
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0d]"), F.lit(False))
    keys = ["doc", "text_hash"]
    keyed = docs.filter(words).withColumns({"doc": row_key("doc_id"), "text_hash": F.xxhash64("text")})
    first = keyed.join(representatives(docs), keys, "left_semi").dropDuplicates(keys)
    return first.select(*COLUMNS).unionByName(docs.filter(~words))


def benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. A null text holds none; repeated rows stay or go together; with no benchmark all stay."""
    found = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("n_hit = 0").select(*COLUMNS)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 tokens. A null text is the end id alone; repeated rows are packed as often as they come."""
    checkpoint_dir(spark)
    return pack(token_pieces(docs, tokenizer_path()))


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontaminate", benchmark), ("packing", packing)]

#: Reference histograms and token ids aren't expressible in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result but the last is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
