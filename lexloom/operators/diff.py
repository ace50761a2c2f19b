"""Differences between two copies of data, cell by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_cells(df: DataFrame, key: str, fields: list[str], sign: int) -> DataFrame:
    """key - field - value rows of `df`, and one row with the field "" for the key itself.

    Rows with a null key are left out; a null value stays a row with a null value.
    """
    cells = F.array(
        F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields],
    )
    return (
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), F.explode(cells).alias("c"))
        .select("key", "c.field", "c.value", F.lit(sign).alias("sign"))
    )


def cell_diff(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: list[str],
    only_left: str = "only_left",
    only_right: str = "only_right",
    extra_cells: DataFrame | None = None,
) -> DataFrame:
    """Keys on one side only, and the fields whose values differ: (key, difference).

    Both sides become key-field-value rows with the signs +1 and -1; equal cells are
    combined before the shuffle, a cell that has both signs cancels, and what is left
    names the differences. Repeated rows of a side are one cell, so deliveries in
    double change nothing. If a side holds several values of one field for a key, the
    field differs unless both sides hold the same set. Null equals null only. Rows with
    a null key don't count; two empty sides give no rows. `extra_cells` adds
    (key, field, value, sign) rows computed elsewhere. A key's hot rows are combined
    map-side, and only cells that don't cancel meet again by key.
    """
    cells = unpivot_cells(left, key, fields, 1).unionByName(unpivot_cells(right, key, fields, -1))
    if extra_cells is not None:
        cells = cells.unionByName(extra_cells)
    open_cells = (
        cells.groupBy("key", "field", "value")
        .agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
        .filter("hi = lo")
    )
    per_key = open_cells.groupBy("key").agg(
        F.max(F.when(F.col("field") == "", F.col("hi"))).alias("side"),
        F.collect_set(F.when(F.col("field") != "", F.col("field"))).alias("fields"),
    )
    named = F.when(F.col("side").isNull(), F.col("fields")).otherwise(
        F.array(F.when(F.col("side") > 0, F.lit(only_left)).otherwise(F.lit(only_right)))
    )
    return per_key.select(F.col("key").alias(key), F.explode(named).alias("difference"))


def keyed_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): `removed`, `added` or `changed`, for rows that a unique key pairs."""
    a = left.select(F.col(key), F.struct(*columns).alias("__a"))
    b = right.select(F.col(key), F.struct(*columns).alias("__b"))
    both = a.join(b, key, "full")
    change = F.when(F.col("__b").isNull(), "removed").when(F.col("__a").isNull(), "added").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def positional_diff(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], value: str) -> DataFrame:
    """(pos, left_value, right_value) where the rows at a position differ; the shorter side has nulls at the end.

    Positions come from a running count over range-partitioned rows, not from one sorted task.
    """
    from .ordered import running_sum

    a = running_sum(left, [], left_order, F.lit(1), "pos").select("pos", F.col(value).alias("left_value"), F.lit(True).alias("__l"))
    b = running_sum(right, [], right_order, F.lit(1), "pos").select("pos", F.col(value).alias("right_value"), F.lit(True).alias("__r"))
    j = a.join(b, "pos", "full")
    return j.filter(F.col("__l").isNull() | F.col("__r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).select("pos", "left_value", "right_value")


def two_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): `only_left`, `only_right` or `shared` for the distinct non-null keys of two tables."""
    signs = left.select(F.col(key), F.lit(1).alias("s")).unionByName(right.select(F.col(key), F.lit(2).alias("s"))).filter(F.col(key).isNotNull())
    g = signs.groupBy(key).agg(F.bit_or("s").alias("s"))
    return g.select(key, F.when(F.col("s") == 1, "only_left").when(F.col("s") == 2, "only_right").otherwise("shared").alias("side"))


def set_status(generated, other, supported=None):
    """Status of a set of forms against another: unsupported, exact, exact_case, subset or mismatch."""
    g, o = F.array_sort(F.array_distinct(generated)), F.array_sort(F.array_distinct(other))
    low = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda x: F.lower(x))))
    status = (
        F.when(g == o, "exact").when(low(g) == low(o), "exact_case")
        .when(F.size(F.array_except(g, o)) == 0, "subset").otherwise("mismatch")
    )
    return status if supported is None else F.when(~supported, "unsupported").otherwise(status)


def change_status(old, new):
    """How a set changed: unchanged, more, fewer or changed."""
    lost, won = F.size(F.array_except(old, new)), F.size(F.array_except(new, old))
    return F.when((lost == 0) & (won == 0), "unchanged").when(lost == 0, "more").when(won == 0, "fewer").otherwise("changed")
