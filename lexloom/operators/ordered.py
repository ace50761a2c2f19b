"""Order-dependent operators that split hot keys: previous rows, running sums, runs, islands.

Rows are range-partitioned by key and order, so that a key with many rows spreads over
several partitions. Within a partition windows do the work; what crosses a border comes
from a table of two rows a partition at most, which is what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with its range partition in `__part`, fixed by writing it."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ordered")


def _window(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy("__part", *keys).orderBy(*order)


def _edges(parts: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """For each partition its first and last key with aggregates over their rows: at most two rows a partition."""
    by_key = parts.groupBy("__part", *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    if not keys:
        return by_key
    k = F.struct(*keys)
    ends = parts.groupBy("__part").agg(F.min(k).alias("__lo"), F.max(k).alias("__hi"))
    return by_key.join(F.broadcast(ends), "__part").filter(k.eqNullSafe(F.col("__lo")) | k.eqNullSafe(F.col("__hi"))).drop("__lo", "__hi")


def _by_part(parts: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Join what the borders carry, null keys included."""
    b = edges.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in edges.columns if c.startswith("__c_")])
    on = parts["__part"] == b["__p"]
    for k in keys:
        on = on & parts[k].eqNullSafe(b[f"__k_{k}"])
    return parts.join(F.broadcast(b), on, "left").drop("__p", *[f"__k_{k}" for k in keys])


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Each row with the `columns` of the row before it of the same keys (null for the first).

    `order` must be unique within a key for a defined result. Null keys are a key of their own.
    """
    parts = _parts(df, keys, order)
    edges = _edges(parts, keys, __last=F.max_by(F.struct(*columns), F.struct(*order)))
    before = Window.partitionBy(*keys).orderBy("__part") if keys else Window.partitionBy(F.lit(0)).orderBy("__part")
    carried = edges.withColumn("__c_last", F.lag("__last").over(before))
    out = _by_part(parts, carried, keys).withColumn("__row", F.coalesce(F.lag(F.struct(*columns)).over(_window(keys, order)), F.when(F.row_number().over(_window(keys, order)) == 1, F.col("__c_last"))))
    return out.select(*df.columns, *[F.col("__row")[c].alias(prefix + c) for c in columns])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Each row with the sum of `value` over it and the rows before it of the same keys."""
    parts = _parts(df.withColumn("__v", value), keys, order)
    edges = _edges(parts, keys, __sum=F.sum("__v"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("__c_sum", F.sum("__sum").over(before))
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    out = _by_part(parts, carried, keys).withColumn(name, F.sum("__v").over(w) + F.coalesce("__c_sum", F.lit(0)))
    return out.select(*df.columns, name)


def nearest_anchor(df: DataFrame, keys: list[str], order: list[str], anchor: Column, name: str) -> DataFrame:
    """Each row with the last non-null `anchor` before it of its keys, else the first after it, else null."""
    parts = _parts(df.withColumn("__a", anchor), keys, order)
    o = F.struct(*order)
    edges = _edges(parts, keys, __last=F.max_by("__a", F.when(F.col("__a").isNotNull(), o)), __first=F.min_by("__a", F.when(F.col("__a").isNotNull(), o)))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__part")
    carried = edges.withColumn("__c_back", F.last("__last", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "__c_ahead", F.first("__first", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    )
    r = _window(keys, order)
    back = F.coalesce(F.last("__a", True).over(r.rowsBetween(Window.unboundedPreceding, -1)), F.col("__c_back"))
    ahead = F.coalesce(F.first("__a", True).over(r.rowsBetween(1, Window.unboundedFollowing)), F.col("__c_ahead"))
    return _by_part(parts, carried, keys).withColumn(name, F.coalesce(back, ahead)).select(*df.columns, name)


def delta_counts(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(delta, n): how often each difference from the row before occurs."""
    d = with_previous(df, keys, order, [value])
    return d.filter(F.col(f"prev_{value}").isNotNull()).groupBy((F.col(value) - F.col(f"prev_{value}")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


def islands(df: DataFrame, keys: list[str], order: list[str], apart: Column, name: str = "island") -> DataFrame:
    """Rows numbered by island: a new one begins where `apart` holds, given the columns prev_<order[0]>."""
    d = with_previous(df, keys, order, [order[0]])
    starts = (F.col(f"prev_{order[0]}").isNull() | F.coalesce(apart, F.lit(True))).cast("int")
    return running_sum(d, keys, order, starts, name).drop(f"prev_{order[0]}")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """Rows numbered by run of equal values (null equals null)."""
    d = with_previous(df.withColumn("__here", F.lit(1)), keys, order, [value, "__here"])
    starts = (F.col("prev___here").isNull() | ~F.col(value).eqNullSafe(F.col(f"prev_{value}"))).cast("int")
    return running_sum(d, keys, order, starts, name).drop(f"prev_{value}", "prev___here", "__here")


def transitions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(from_value, to_value, n): how often a value follows another."""
    d = with_previous(df.withColumn("__here", F.lit(1)), keys, order, [value, "__here"]).filter("prev___here is not null")
    return d.groupBy(F.col(f"prev_{value}").alias("from_value"), F.col(value).alias("to_value")).agg(F.count(F.lit(1)).alias("n"))


def contained_in(df: DataFrame, key: str, low: str, high: str, id_col: str) -> DataFrame:
    """The ids of intervals that lie within another interval of their key (the smaller id wins among equal ones).

    Sorted by low end and falling high end, an interval lies within another one if the largest
    high end before it reaches it: a running maximum, without comparing pairs.
    """
    d = df.select(key, low, high, id_col).filter(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("__h", -F.col(high))
    parts = _parts(d, [key], [low, "__h", id_col])
    edges = _edges(parts, [key], __top=F.max(high))
    w = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("__c_top", F.max("__top").over(w))
    r = _window([key], [low, "__h", id_col]).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max(high).over(r), F.col("__c_top"))
    return _by_part(parts, carried, [key]).withColumn("__reach", reach).filter(F.col("__reach") >= F.col(high)).select(key, id_col)
