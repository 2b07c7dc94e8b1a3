"""Baselines and text-layer geometry, as columns. Angles are radians, clockwise from the x axis; a baseline is relative to the lower left of its box."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least angle of a sloped line, font for missing sizes, width of a glyph to its height, share of a space.
FLAT_ANGLE, DEFAULT_FONT, GLYPH_RATIO, SPACE_SHARE = 0.005, 10.0, 2.0, 0.2


def word_baseline_y(word: Column, line: Column, line_y: Column, angle: Column) -> Column:
    """The y of a word's baseline from its line's, as hOCR measures it."""
    return (word.y2 - line.y2) + line_y + F.tan(angle) * (word.x1 - line.x1)


def moved_baseline(x: Column, y: Column, angle: Column, source: Column, target: Column) -> Column:
    """A baseline of one box relative to another: steep ones are met at y = 0, others at x = 0."""
    dx, dy = source.x1 + x - target.x1, source.y2 + y - target.y2
    steep = F.abs(angle) > math.pi / 4
    return F.struct(F.when(steep, dx + dy / F.tan(angle)).otherwise(0.0).alias("x"), F.when(steep, 0.0).otherwise(dy + dx * F.tan(angle)).alias("y"), angle.alias("angle"))


def baseline_from_points(b: Column, x1: Column, y1: Column, x2: Column, y2: Column, orientation: Column) -> Column:
    """A baseline through two points of a page, turned so that it fits the page's orientation (UP, RIGHT, DOWN, LEFT); all 0 for an unknown one."""
    slope = F.atan((y2 - y1) / (x2 - x1))
    half = F.lit(math.pi)
    low = F.when(orientation == "RIGHT", 0.0).when(orientation == "DOWN", math.pi / 2).when(orientation == "LEFT", math.pi).otherwise(-math.pi / 2)
    turned = F.when(slope < low, slope + half).otherwise(slope)
    turned = F.when(turned < low, turned + half).otherwise(turned)
    angle = F.when(x1 == x2, F.when(y1 > y2, -math.pi / 2).otherwise(math.pi / 2)).otherwise(turned)
    known = orientation.isin("UP", "RIGHT", "DOWN", "LEFT")
    return F.struct(F.when(known, x1 - b.x1).otherwise(0).cast("double").alias("x"), F.when(known, y1 - b.y2).otherwise(0).cast("double").alias("y"), F.when(known, angle).otherwise(0.0).alias("angle"))


def levelled(angle: Column, width: Column) -> Column:
    """Nearly flat lines become flat: angle, growth of the font, and how much lower the text stands."""
    flat = F.abs(angle) < FLAT_ANGLE
    offset = F.when(flat, F.sin(angle) * width / 2).otherwise(0.0)
    return F.struct(F.when(flat, 0.0).otherwise(angle).alias("angle"), F.abs(offset).alias("grow"), F.greatest(offset, F.lit(0.0)).alias("lower"))


def font(size: Column, grow: Column) -> Column:
    return F.when(size > 1, size).otherwise(DEFAULT_FONT) + grow


def stretch(advance: Column, size: Column) -> Column:
    """Horizontal stretch in percent that gives a glyph its advance."""
    return 100 * advance / (size / GLYPH_RATIO)
