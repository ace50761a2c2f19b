"""Grouping operators: first-seen representatives, samples, cross-tabs, votes, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 64


def group_first_union(df: DataFrame, keys: list[str], order: str, first: list[str], sets: list[str]) -> DataFrame:
    """One row a key: the `first` columns of its earliest row, the `sets` columns as sorted distinct arrays, and n.

    Earliest is by `order`, so the result doesn't depend on how rows arrive. Sets are combined
    map-side; they hold distinct values only. Nulls are left out of sets.
    """
    return df.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c in first], *[F.array_sort(F.collect_set(c)).alias(c) for c in sets], F.count(F.lit(1)).alias("n")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key, by aggregation rather than by sorting groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each key.

    Rows are ranked in BLOCKS blocks of a key first, so a key with many rows is no single task:
    the second ranking sees at most n * BLOCKS rows of it.
    """
    blocked = df.withColumn("__block", F.pmod(F.xxhash64(*df.columns), F.lit(BLOCKS)))
    some = blocked.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(*order))).filter(F.col("__r") <= n)
    out = some.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= n)
    return out.select(*df.columns, F.col("__r").cast("bigint").alias("rank"))


def stratified_sample(df: DataFrame, stratum: str, id_col: str, n: int, seed: int = 1) -> DataFrame:
    """A reproducible sample of `n` rows of each stratum."""
    return top_per_key(df, [stratum], [F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)], n).drop("rank")


def listed_strata(df: DataFrame, stratum: str, listed: list[str], order: str, n: int) -> DataFrame:
    """The first `n` rows of each listed stratum, with the stratum's place in the list."""
    spark = df.sparkSession
    names = spark.createDataFrame([(s, i) for i, s in enumerate(listed)], f"`{stratum}` string, place int")
    return top_per_key(df.join(F.broadcast(names), stratum), [stratum, "place"], [F.col(order)], n)


def crosstab_with_totals(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both keys, by each, and in all; totals have null keys and their level."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def coverage(df: DataFrame, keys: list[str], covered: Column) -> DataFrame:
    """Rows, covered rows and their share in per cent (0 without rows)."""
    n, c = F.count(F.lit(1)), F.sum(covered.cast("int"))
    return df.groupBy(*keys).agg(n.alias("total"), c.alias("covered"), F.round(F.lit(100.0) * c / F.greatest(n, F.lit(1)), 2).alias("percent"))


def cardinality(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key with its number of distinct values, as none, unique or multiple."""
    g = df.groupBy(key).agg(F.count_distinct(value).alias("k"))
    return g.withColumn("kind", F.when(F.col("k") == 0, "none").when(F.col("k") == 1, "unique").otherwise("multiple"))


def set_agreement(df: DataFrame, key: str, member: str, value: str) -> DataFrame:
    """Whether all members of a key have the same set of values: (key, members, agree)."""
    sets = df.groupBy(key, member).agg(F.array_sort(F.collect_set(value)).alias("s"))
    return sets.groupBy(key).agg(F.count(F.lit(1)).alias("members"), (F.count_distinct("s") <= 1).alias("agree"))


def weighted_vote(df: DataFrame, key: str, choice: str, weight: Column) -> DataFrame:
    """The choice with the largest summed weight of each key, the smaller choice on ties, and the number of tied ones."""
    sums = df.filter(F.col(choice).isNotNull()).groupBy(key, choice).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(key).agg(F.max("w").alias("w"))
    tied = sums.join(best, [key, "w"])
    return tied.groupBy(key, "w").agg(F.min(choice).alias(choice), F.count(F.lit(1)).alias("tied"))


def signature_groups(df: DataFrame, member: str, value: str) -> DataFrame:
    """Members grouped by their set of values: (signature, members), the signature joined by |."""
    sets = df.filter(F.col(value).isNotNull()).groupBy(member).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias("signature"))
    return sets.groupBy("signature").agg(F.count(F.lit(1)).alias("members"))


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of a table that doesn't depend on row order: the rows, and sums of two row hashes."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    h = F.md5(text)
    part = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).cast("string").alias("sum_a"), F.sum(part(9)).cast("string").alias("sum_b"))


def median_step(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The median distance between consecutive values of each key."""
    from .ordered import with_previous

    d = with_previous(df, keys, order, [value]).filter(F.col(f"prev_{value}").isNotNull())
    return d.groupBy(*keys).agg(F.median(F.col(value) - F.col(f"prev_{value}")).alias("step"))
