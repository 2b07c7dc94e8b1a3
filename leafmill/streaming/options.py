"""Streams of option submissions: what each one starts, by the options that its page last accepted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmill.operators.incremental import CHEAP, OTHER, STARTED, SUBMISSION

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Days after its last accepted submission that a page's options are forgotten; the next submission is then its first.
DAYS = 30

_LAST = ", ".join(f"{c} {'boolean' if c.startswith(('fix', 'keep')) else 'double'}" for c in OTHER + CHEAP)


def use_rocksdb(spark: SparkSession) -> None:
    """Processors with state of their own need this state store. A run that ends when nothing is left to read (availableNow) needs empty micro-batches off: by processing time there is always one more."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def _plain(x):
    """A value as Python has it; null for missing ones."""
    return None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x


class Submissions(StatefulProcessor):
    """Holds each page's last accepted options and the number of its last job, for ``ttl_ms`` after they were accepted."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"{_LAST}, job_id int", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        options, job = (tuple(known[:-1]), known[-1]) if known else (None, 0)
        out, before = [], (options, job)
        names = ["version", "has_image", *OTHER, *CHEAP]
        for version, has_image, *new in pd.concat(list(rows)).sort_values("version", kind="stable")[names].itertuples(index=False, name=None):
            new = tuple(map(_plain, new))
            if new == options:
                continue
            if not _plain(has_image):
                out.append((key[0], version, None, None, "no image"))
                continue
            full = options is None or new[: len(OTHER)] != options[: len(OTHER)]
            options, job = new, job + 1
            out.append((key[0], version, job, "FULL" if full else "ONLY_PARAGRAPHS", None))
        if (options, job) != before:
            self.last.update((*options, job))
        yield pd.DataFrame(out, columns=["page_id", "version", "job_id", "mode", "error"]).astype({"job_id": "Int32"})

    def close(self) -> None:
        pass


def started(submissions: DataFrame, days: float = DAYS) -> DataFrame:
    """A stream of submissions (SUBMISSION) -> the jobs that they start (STARTED), as ``incremental.started`` gives them for a table, however the stream is cut into micro-batches.

    A page's submissions must arrive in order of version; those of one micro-batch are sorted. State is one row for each page and goes ``days`` after the last accepted
    submission (processing time)."""
    use_rocksdb(submissions.sparkSession)
    rows = submissions.select(*(x.split()[0] for x in SUBMISSION.split(", ")))
    return rows.groupBy("page_id").transformWithStateInPandas(Submissions(int(days * 86_400_000)), STARTED, "Append", "ProcessingTime")
