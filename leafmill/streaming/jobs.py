"""Streams of recognition jobs: the latest submission wins; and the stateless pipeline over arriving hOCR files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.sources import hocr

JOBS = "page_id long, seq long, ts timestamp, kind string, job_id int"


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else 0
    out = []
    rows = pd.concat(list(frames)).sort_values("seq")
    for seq, kind, job in rows[["seq", "kind", "job_id"]].itertuples(index=False):
        if kind == "submit":
            last = max(last, int(job))
        elif job == last:
            out.append((key[0], seq, job))
    state.update((last,))
    state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + DAYS * 24 * 3600 * 1000)
    yield pd.DataFrame(out, columns=["page_id", "seq", "job_id"])


#: A page's state goes once the jobs' time (ts) is so many days past its last job; jobs may come an hour late for that.
DAYS, LATE = 30, "1 hour"


def published(jobs: DataFrame) -> DataFrame:
    """A stream of jobs (JOBS) -> completions that were current when they came. The state of a page is one number; the rows of a micro-batch are handled in order of seq.

    Between micro-batches the order is the source's, so a page's jobs must arrive in order, as they do from a log partitioned by page or from files in order of their times: a
    completion that comes before the submission that overtakes it was current when it came."""
    return jobs.withWatermark("ts", LATE).groupBy("page_id").applyInPandasWithState(_latest, "page_id long, seq long, job_id int", "last int", "append", GroupStateTimeout.EventTimeTimeout)


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the words of hOCR files as they arrive under ``path``."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    docs = files.select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("content"))
    return hocr.words(hocr.parsed(docs))


def finished_scans(scans: DataFrame) -> DataFrame:
    """Scans (page_id, scan_type, ...) that go to recognition: normal ones, not previews."""
    return scans.filter("scan_type = 'NORMAL'")


def recognised(scans: DataFrame) -> DataFrame:
    """A stream (or table) of finished scans with their hOCR document (page_id, scan_type, content) -> words of the normal ones, as they come; no state."""
    return hocr.words(hocr.parsed(finished_scans(scans)), "page_id")
