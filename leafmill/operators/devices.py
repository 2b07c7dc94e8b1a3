"""Settings tables of a scanner fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions.scalars import has_flag

SOFT_SELECT, INACTIVE = 1, 2
EDGES = {"tl_x": "tl-x", "tl_y": "tl-y", "br_x": "br-x", "br_y": "br-y"}


def grouped(options: DataFrame) -> DataFrame:
    """Options with the group before them; those before any group go to an unnamed one, groups without options vanish."""
    order = W.partitionBy("device_id").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    name = F.last(F.when(F.col("type") == "GROUP", F.col("name")), ignorenulls=True).over(order)
    return options.withColumn("group_name", F.coalesce(name, F.lit(""))).filter("type <> 'GROUP'").select("device_id", "group_name", "idx", "name")


def first_by_name(options: DataFrame) -> DataFrame:
    """The first option of each name, groups apart."""
    return options.filter("type <> 'GROUP'").groupBy("device_id", "name").agg(F.min("idx").alias("idx"))


def settable(options: DataFrame) -> DataFrame:
    return options.filter((F.col("type") != "BUTTON") & (F.col("type") != "GROUP") & ~has_flag(F.col("cap"), INACTIVE) & has_flag(F.col("cap"), SOFT_SELECT))


def _edges(options: DataFrame, value: dict[str, str]) -> DataFrame:
    at = {k: F.max(F.when((F.col("name") == n) & (F.col("type") == "FIXED"), F.col(value[k]))).alias(k) for k, n in EDGES.items()}
    return options.groupBy("device_id").agg(*at.values())


def _area(edges: DataFrame) -> DataFrame:
    return edges.select("device_id", *(F.when(F.col("tl_x").isNotNull() & F.col("tl_y").isNotNull() & F.col("br_x").isNotNull() & F.col("br_y").isNotNull(), x).alias(n) for n, x in (("x", F.col("tl_x")), ("y", F.col("tl_y")), ("w", F.col("br_x") - F.col("tl_x")), ("h", F.col("br_y") - F.col("tl_y")))))


def current_area(options: DataFrame) -> DataFrame:
    """The scan area in force; null unless all four edges are single numbers."""
    return _area(_edges(options, dict.fromkeys(EDGES, "value")))


def largest_area(options: DataFrame) -> DataFrame:
    """The largest scan area that the ranges allow, turned round where a side is negative."""
    a = _area(_edges(options, {"tl_x": "range_min", "tl_y": "range_min", "br_x": "range_max", "br_y": "range_max"}))
    return a.select("device_id", *(x.alias(n) for n, x in (("x", F.when(F.col("w") < 0, F.col("x") + F.col("w")).otherwise(F.col("x"))), ("y", F.when(F.col("h") < 0, F.col("y") + F.col("h")).otherwise(F.col("y"))), ("w", F.abs("w")), ("h", F.abs("h")))))


def uses_full_area(options: DataFrame, most: float = 0.1) -> DataFrame:
    a, b = current_area(options), largest_area(options).withColumnsRenamed({c: f"m{c}" for c in "xywh"})
    near = lambda p, q: F.abs(p - q) <= most
    both = a.join(b, "device_id")
    full = near(F.col("x"), F.col("mx")) & near(F.col("y"), F.col("my")) & near(F.col("x") + F.col("w"), F.col("mx") + F.col("mw")) & near(F.col("y") + F.col("h"), F.col("my") + F.col("mh"))
    return both.select("device_id", F.coalesce(full, F.lit(False)).alias("full_area"))


def least_resolution(constraints: DataFrame) -> DataFrame:
    """The least resolution that a constraint allows: of lists the smallest, of ranges the lower end; null without one."""
    return constraints.select("device_id", F.coalesce(F.array_min("floats"), F.array_min("ints").cast("double"), F.col("float_range.from"), F.col("int_range.from").cast("double")).alias("min_resolution"))


def valid_values(constraints: DataFrame) -> DataFrame:
    """Whether the value fits its constraint: a range's ends count, a list must hold it."""
    v = F.col("value")
    ok = F.coalesce(F.array_contains("floats", v), F.exists("ints", lambda x: x == v), v.between(F.col("float_range.from"), F.col("float_range.to")), v.between(F.col("int_range.from"), F.col("int_range.to")))
    return constraints.select("device_id", ok.alias("valid"))


def changed_settings(options: DataFrame, desired: DataFrame) -> DataFrame:
    """Desired values (device_id, name, desired) of settable options that differ from those in force; a name stands for its first option."""
    first = first_by_name(options).join(settable(options).drop("name"), ["device_id", "idx"])
    return first.join(desired, ["device_id", "name"]).filter(~F.col("desired").eqNullSafe(F.col("value"))).select("device_id", "idx", "name", "value", "desired")


def unknown_settings(options: DataFrame, desired: DataFrame) -> DataFrame:
    """Desired values for names that a device doesn't have."""
    return desired.join(options.select("device_id", "name"), ["device_id", "name"], "left_anti").select("device_id", "name")


def missing_devices(wanted: DataFrame, devices: DataFrame) -> DataFrame:
    """Wanted names (name) that no device has."""
    return wanted.join(devices, "name", "left_anti").select("name")
