"""Blur measures of words over sparse images against a plain version, and the plan that leaves other pixels out."""

import numpy as np
import pytest

from leafmill.operators import blur as B

CELL = "page_id long, cell int, n_chars int, box struct<x1:int,y1:int,x2:int,y2:int>"
WIDTH, HEIGHT = 37, 23
BOXES = [
    (0, 0, 9, 6), (WIDTH - 8, 0, WIDTH, 5), (0, HEIGHT - 4, 7, HEIGHT), (WIDTH - 5, HEIGHT - 6, WIDTH, HEIGHT),  # corners
    (12, 0, 20, 4), (10, HEIGHT - 3, 25, HEIGHT), (0, 9, 5, 14), (WIDTH - 3, 8, WIDTH, 15),  # borders
    (14, 8, 24, 14), (16, 10, 30, 16), (14, 8, 24, 14), (20, 12, 21, 13), (5, 5, 5, 9), (3, 9, 8, 9), (-4, -3, 3, 3), (33, 20, 60, 50),  # inside, over each other, twice, one pixel, empty, beyond the image
]


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(12)
    return [rng.integers(0, 260, (HEIGHT, WIDTH)), np.full((HEIGHT, WIDTH), 90), rng.integers(0, 3, (HEIGHT, WIDTH)) * 100]


def plain(v, box, n_chars):
    p = np.pad(v, 1, mode="reflect")
    kernel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    g = np.array([[0.5 * (p[y : y + 3, x : x + 3] * (kernel + kernel.T)).sum() for x in range(WIDTH)] for y in range(HEIGHT)])
    x1, y1, x2, y2 = box
    a, b = (z[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)].ravel() for z in (v, g))

    def quantile(values, q):
        return sorted(values)[int(np.ceil(q * len(values) - 1e-9)) - 1] if len(values) else 0

    buckets = [int(x) for x in a if 0 <= x < 255]
    contrast = quantile(buckets, 0.95) - quantile(buckets, 0.05)
    width = max(x2 - x1, y2 - y1) // n_chars or None
    steep = [int(np.floor(x)) for x in b if 0 <= x < 255 and width and np.floor(x) >= contrast // width]
    return width, contrast, quantile(steep, 0.85)


def test_measures_on_all_borders(spark, image):
    px = spark.createDataFrame([(p, y, x, int(v[y, x])) for p, v in enumerate(image) for y in range(HEIGHT) for x in range(WIDTH)], "page_id long, y int, x int, v int")
    cells = spark.createDataFrame([(p, i, 1 + i % 3, b) for p in range(4) for i, b in enumerate(BOXES)], CELL)  # page 3 has no image
    got = {(r.page_id, r.cell): (r.char_width, r.contrast, r.sharpness) for r in B.measures(cells, px.repartition(7)).collect()}
    for p in range(4):
        for i, b in enumerate(BOXES):
            width, contrast, sharp = plain(image[p], b, 1 + i % 3) if p < 3 else (max(b[2] - b[0], b[3] - b[1]) // (1 + i % 3) or None, 0, 0)
            assert got[p, i] == (width, contrast, sharp), (p, i)


def test_other_pixels_leave_below_the_windows(spark):
    px = spark.range(200_000).selectExpr("id div 10000 as page_id", "int(id % 10000 div 100) as y", "int(id % 100) as x", "int(id * 7 % 250) as v")
    cells = spark.createDataFrame([(p, 0, 1, (40, 40, 50, 44)) for p in range(20)], CELL)
    patch = B.patches(cells, px)
    assert patch.count() == 20 * 12 * 6
    plan = B.measures(cells, px)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    join = min(i for i, x in enumerate(lines) if "Join Inner" in x)
    assert max(i for i, x in enumerate(lines) if "Window" in x) < join  # the plan is read from the top
    assert not any("Window" in x for x in lines[join:])
