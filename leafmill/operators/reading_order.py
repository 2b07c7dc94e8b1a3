"""Reading order: lines of a paragraph clustered by where their baselines meet its middle."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Largest angle from the mean (degrees), least lines and font, largest spread in fonts, buckets of a font and of a window.
ANGLE, LEAST_LINES, LEAST_FONT, MOST_FONTS, PER_FONT, WINDOW = 2.0, 3, 10.0, 200.0, 10, 5


def _peel(y: np.ndarray, font: float) -> np.ndarray:
    """The cluster key of each line of a paragraph: the densest window of buckets is taken again and again, with the lines around it."""
    size = font / PER_FONT
    spread = y.max() - y.min()
    key = np.full(len(y), np.nan)
    if spread <= 0 or spread < size * WINDOW:
        key[:] = (y.max() + y.min()) / 2
        return key
    at = np.minimum(((y - y.min()) / size).astype(int), int(spread / size))
    counts = np.bincount(at)
    while np.isnan(key).any():
        sums = np.convolve(counts, np.ones(WINDOW, int), "valid") if len(counts) >= WINDOW else np.array([counts.sum()])
        first = int(sums.argmax())
        held = np.arange(first, min(first + WINDOW, len(counts)))
        weight = counts[held].sum()
        if not weight:  # lines on the rounding of a range's edge
            key[np.isnan(key)] = y[np.isnan(key)]
            break
        centre = int(np.floor((held * counts[held]).sum() / weight + 0.5))  # halves go away from zero
        low, high = max(centre - WINDOW, 0), min(centre + WINDOW + 1, len(counts) + 1)  # the last bucket ends a bucket beyond the topmost line's
        low_y, high_y = y.min() + low * size, y.min() + high * size
        take = np.isnan(key) & (y >= low_y) & (y <= high_y)
        key[take] = (low_y + high_y) / 2
        counts[low:high] = 0
    return key


def _peel_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paragraphs in a row, each whole: one that a batch cuts waits for the next batch."""
    rest = None
    for frame in itertools.chain(frames, [None]):
        if frame is None:
            whole, rest = rest, None
        else:
            both = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = (both["page_id"] == both["page_id"].iloc[-1]) & (both["par_no"] == both["par_no"].iloc[-1]) if len(both) else []
            cut = int((~last).sum()) if len(both) else 0  # sorted, so the last paragraph is the tail
            whole, rest = both.iloc[:cut], both.iloc[cut:]
        if whole is None or not len(whole):
            continue
        page, par, at, x, y, font, use, good = (whole[c].to_numpy() for c in ("page_id", "par_no", "line_at", "x1", "y", "font", "use", "good"))
        heads = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (par[1:] != par[:-1])]))
        place = np.empty(len(y), np.int64)
        for a, b in zip(heads, np.append(heads[1:], len(y)), strict=True):
            if not use[a]:
                place[a:b] = np.arange(b - a)
                continue
            key, fine = y[a:b].copy(), good[a:b]
            key[fine] = _peel(key[fine], float(font[a]))
            place[a + np.lexsort((at[a:b], np.where(fine, x[a:b], -np.inf), key))] = np.arange(b - a)
        yield pd.DataFrame({"page_id": page, "par_no": par, "line_at": at, "place": place})


def sorted_lines(lines: DataFrame) -> DataFrame:
    """Lines (page_id, par_no, line_at, x1.., angle, base_y, font) with place, their order in the paragraph.

    Lines off the paragraph's mean angle go by their own height; paragraphs with fewer than three good lines, small fonts or a wide spread stay as they are. Lines pass through Python
    batch by batch where the windows left them, a paragraph's together, and bring their place along: no exchange or join comes after. Ties keep the given order.
    """
    par = W.partitionBy("page_id", "par_no")
    middle = (F.min("x1").over(par) + F.max("x2").over(par)) / 2
    each = lines.withColumn("good", F.abs(F.col("angle") - F.avg("angle").over(par)) < F.radians(F.lit(ANGLE))).withColumn("middle", middle)
    each = each.withColumn("y", F.col("y2") + F.col("base_y") + F.when(F.col("good"), F.tan("angle") * (F.col("middle") - F.col("x1"))).otherwise(0.0))
    good = F.when(F.col("good"), F.col("y"))
    each = each.withColumns({"n_good": F.count(good).over(par), "spread": F.max(good).over(par) - F.min(good).over(par), "mean_font": F.avg("font").over(par)})
    use = (F.col("n_good") >= LEAST_LINES) & (F.col("mean_font") >= LEAST_FONT) & (F.col("spread") / F.col("mean_font") <= MOST_FONTS)
    each = each.select("page_id", "par_no", F.col("line_at").cast("int").alias("line_at"), F.col("x1").cast("double").alias("x1"), "y", F.col("mean_font").alias("font"), F.coalesce(use, F.lit(False)).alias("use"), F.coalesce("good", F.lit(False)).alias("good"))
    return each.sortWithinPartitions("page_id", "par_no", "line_at").mapInPandas(_peel_all, "page_id long, par_no int, line_at int, place int")
