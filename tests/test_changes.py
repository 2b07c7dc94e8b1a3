"""Versions of words meet in the exchange of their texts."""

import pytest

from leafmill.operators import hierarchy as H
from leafmill.operators import versions as V
from leafmill.sources import layout as L


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one  two\n\n three é four ", "", " \n x <&> &amp;", "a b c\n" * 9, None, "\n\n", "tab\tbed é  "]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_versions_meet_in_one_exchange(spark, docs):
    words = L.structured(L.lined_words(docs))
    found = V.changes(words, L.edited(words))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL")  # that of the texts alone
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found) == rows(V.word_changes(H.nest(words), H.nest(L.edited(words))))
    twice = words.unionByName(words)  # copies count
    assert {r.status for r in V.changes(twice, words).collect()} == {"gone"} and V.changes(twice, words).count() == words.count()
