"""A small corpus with copies, near copies, shared passages and lines, junk, secrets and odd rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from plain import SCHEMA, make_rows  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def corpus(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.limit(0)


@pytest.fixture(scope="session")
def ordered(spark, corpus):
    """Distinct (id, hash, text) in the order of places."""
    from leafmill.llm import superkmers as S

    return sorted({(r.doc, r.text_hash % 2**32, r.text) for r in S.keyed(corpus).withColumn("text_hash", S.half("text_hash")).collect()})


@pytest.fixture
def unique(corpus):
    """Rows with an id of their own."""
    return corpus.filter("doc_id is not null").dropDuplicates(["doc_id"])
