"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it has more than 1 / HEAVY_SHARE of the rows, so there are
#: fewer than HEAVY_SHARE heavy keys: the proven bound of what is broadcast.
HEAVY_SHARE = 2000
#: Below this many rows a key never counts as heavy.
HEAVY_LEAST = 20_000


def heavy_keys(counts: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """The keys of `counts` holding more than 1 / HEAVY_SHARE of all rows (fewer than HEAVY_SHARE)."""
    total = counts.agg(F.sum(count).alias("__total"))
    return (
        counts.filter(F.col(count) > HEAVY_LEAST)
        .join(F.broadcast(total), F.col(count) * HEAVY_SHARE > F.col("__total"))
        .select(*keys)
    )


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner"
) -> DataFrame:
    """Join `left` to `right` (unique on `keys`), the heavy keys by broadcast, the rest by shuffle.

    `heavy` must have fewer than HEAVY_SHARE rows (see heavy_keys). Rows with a null
    key take the light path, where an inner join drops and a left join keeps them.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    mark = F.broadcast(heavy.select(*keys, F.lit(True).alias("__heavy")))
    tagged = left.join(mark, keys, "left")
    right_heavy = right.join(F.broadcast(heavy.select(*keys)), keys, "left_semi")
    hot = tagged.filter("__heavy").drop("__heavy").join(F.broadcast(right_heavy), keys, how)
    cold = tagged.filter("__heavy is null").drop("__heavy").join(right, keys, how)
    return hot.unionByName(cold)

