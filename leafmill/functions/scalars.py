"""Scalar functions on columns: angles, boxes, option values and hOCR properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MM_PER_INCH = 25.4


def near_zero_mod(x: Column, y) -> Column:
    """x modulo y in [-y/2, y/2]."""
    y = F.lit(float(y))
    r = x % y
    return F.when(r > y / 2, r - y).when(r < -y / 2, r + y).otherwise(r)


def positive_mod(x: Column, y) -> Column:
    """x modulo y in [0, y)."""
    y = F.lit(float(y))
    r = x % y
    return F.when(r < 0, r + y).otherwise(r)


def rounded(x: Column, digits: int) -> Column:
    """What ``F.round`` gives for doubles, halves away from zero, in double arithmetic wherever that is exact: decimals, and so a text of each number, are gone through only for numbers so near a half that double
    arithmetic may be off, for those of more than 12 digits with the ones kept, infinities, NaN and null."""
    unit = 10.0**digits
    scaled = x * unit
    near = F.abs(scaled - F.floor(scaled) - 0.5)
    return F.when((F.abs(scaled) < 1e12) & (near > 0.001), F.floor(scaled + 0.5) / unit).otherwise(F.round(x, digits))


def prec6(x: Column) -> Column:
    """Six decimals, and no negative zero."""
    return rounded(x, 6) + F.lit(0.0)


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.col(c).cast("int").alias(n) if isinstance(c, str) else c.cast("int").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def width(b: Column) -> Column:
    return b.x2 - b.x1


def height(b: Column) -> Column:
    return b.y2 - b.y1


def almost_equal(a: Column, b: Column, most) -> Column:
    """All four edges within ``most``, inclusive."""
    near = [F.abs(a[e] - b[e]) <= most for e in ("x1", "y1", "x2", "y2")]
    return near[0] & near[1] & near[2] & near[3]


def box_text(b: Column) -> Column:
    return F.concat_ws(" ", b.x1, b.y1, b.x2, b.y2)


def inch_to_mm(x: Column) -> Column:
    return x * MM_PER_INCH


def mm_to_inch(x: Column) -> Column:
    return x / MM_PER_INCH


def has_flag(x: Column, flag: int) -> Column:
    return x.bitwiseAND(F.lit(flag)) != 0


def single(values: Column) -> Column:
    """The only element of an array, else null."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def bound(x: Column, use) -> Column:
    """``use(x)`` with x evaluated once, however often ``use`` names it."""
    return F.transform(F.array(x), use)[0]


def hocr_properties(title: Column) -> Column:
    """The properties of a title, name to numbers: entries are parted by ';', names and numbers by spaces; entries without numbers are left out and
    the last of a name counts. Null if a value isn't a number."""

    def entry(e):
        return bound(F.split(F.trim(e), " +"), lambda p: F.struct(p[0].alias("name"), F.transform(F.slice(p, F.lit(2), F.size(p)), lambda v: v.try_cast("double")).alias("numbers")))

    def chosen(pairs):
        bad = F.exists(pairs, lambda p: F.exists(p.numbers, lambda v: v.isNull()))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"]))
        return F.when(~bad, F.map_from_entries(last))

    # entries without numbers go before names are compared
    return bound(F.filter(F.transform(F.split(title, ";"), entry), lambda p: F.size(p.numbers) > 0), chosen)


def numbers(properties: Column, name: str, count: int) -> Column:
    """The numbers of a property if it has so many, else null."""
    x = F.try_element_at(properties, F.lit(name))
    return F.when(F.size(x) == count, x)


def box_of(values: Column) -> Column:
    """Four numbers as a box, truncated; null from null."""
    return F.when(values.isNotNull(), F.struct(*(values[i].cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2")))))
