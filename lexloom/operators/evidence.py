"""Evidence of other records: ladders of unique keys, heads of compounds, presence, reasons of misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .notation import common_prefix

#: Endings that an inflected form can have, and how alike a spelling must be to count as another of one word.
INFLECTION_ENDINGS = ("a", "ade", "an", "ar", "are", "as", "ast", "at", "de", "e", "en", "er", "et", "n", "na", "or", "r", "s", "t", "te")
SPELLING_SHARE, SHARED_LETTERS = 0.45, 3


def unique_ladder(left: DataFrame, right: DataFrame, id_col: str, value: str, levels: list[tuple[str, Column, Column, bool]]) -> DataFrame:
    """(id, level, value, matches): each left row by the first level that decides.

    A level is (name, left key, right key, unique). Where `unique` is set it decides only if one
    value has the key; else several make the row ambiguous there (value null). Right keys are
    reduced to one row each before they meet, so no key is expanded into pairs. Null keys match
    nothing; rows that no level decides aren't given.
    """
    out = None
    for place, (name, lk, rk, unique) in enumerate(levels):
        keys = right.select(rk.alias("__k"), F.col(value).alias("__v")).filter("__k is not null").groupBy("__k").agg(F.count_distinct("__v").alias("matches"), F.min("__v").alias("__v"))
        keys = keys.filter("matches = 1") if unique else keys
        hit = left.select(id_col, lk.alias("__k")).filter("__k is not null").join(keys, "__k")
        hit = hit.select(id_col, F.struct(F.lit(place).alias("place"), F.lit(name).alias("level"), F.when(F.col("matches") == 1, F.col("__v")).alias("value"), "matches").alias("m"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy(id_col).agg(F.min("m").alias("m")).select(id_col, "m.level", "m.value", "m.matches")


def head_outcomes(parts: DataFrame, id_col: str, head: str, cls: str, lemmas: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, outcome, candidates): what the head of a compound is in a lexicon of (key, entry_id, cls).

    Lemmas are looked at first, forms only if no lemma is the head; entries of the same class
    are preferred. Outcomes: unique or multiple, of the same class or mismatched, or none.
    Index keys are reduced to counts by class before they meet.
    """
    def counted(index: DataFrame) -> DataFrame:
        return index.filter("key <> ''").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("cls", F.lit("")), "n"))).alias("by_class")) if "n" in index.columns else counted(
            index.groupBy("key", "cls").agg(F.count_distinct("entry_id").alias("n"))
        )

    asked = parts.select(id_col, F.col(head).alias("key"), F.coalesce(F.upper(cls), F.lit("")).alias("__cls"))
    hit = asked.join(counted(lemmas).withColumnRenamed("by_class", "__l"), "key", "left").join(counted(forms).withColumnRenamed("by_class", "__f"), "key", "left")
    found = F.coalesce("__l", "__f")
    same = F.when(F.col("__cls") != "", F.try_element_at(found, F.col("__cls")))
    total = F.aggregate(F.map_values(found), F.lit(0).cast("bigint"), lambda a, n: a + n)
    n = F.coalesce(same, total, F.lit(0).cast("bigint"))
    kind = F.when(n == 0, "none").when(n == 1, "unique").otherwise("multiple")
    return hit.select(id_col, F.when(n == 0, "none").otherwise(F.concat(kind, F.when(same.isNotNull(), "_same_class").otherwise("_class_mismatch"))).alias("outcome"), n.alias("candidates"))


def presence(cases: DataFrame, keys: list[str], occurrence: str, index: DataFrame, form: str) -> DataFrame:
    """Each distinct case of `keys` with its occurrences (sorted, joined) and the number of entries of `index` (form, entry_id) that have its form."""
    once = cases.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_set(occurrence)), lambda x: x.cast("string")), ",").alias("occurrences"))
    there = index.groupBy("form").agg(F.count_distinct("entry_id").alias("entries")).withColumnRenamed("form", form)
    return once.join(there, form, "left").withColumn("entries", F.coalesce("entries", F.lit(0)).cast("bigint"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal strings, less by each edit: the share of the longer string that edits leave."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def miss_reason(form: Column, target: Column) -> Column:
    """Why a form isn't among those of its target: another spelling, an inflection, or not known, by the first rule that holds.

    Another spelling looks like an infinitive, as its target does, and is alike to it by
    SPELLING_SHARE; an inflection shares SHARED_LETTERS from the beginning and has a known ending.
    """
    infinitive = (F.length(form) >= 3) & form.rlike("(a|as)$")
    base = target.rlike("(a|as|e|i|ä)$") | (F.length(target) <= 3)
    ending = F.regexp_extract(form, "(" + "|".join(sorted(INFLECTION_ENDINGS, key=len, reverse=True)) + ")$", 1) != ""
    return (
        F.when(infinitive & base & (likeness(form, target) >= SPELLING_SHARE), "other_spelling")
        .when((common_prefix(form, target) >= SHARED_LETTERS) & ending, "inflection").otherwise("unknown")
    )


def numbered_siblings(df: DataFrame, id_col: str, identity: list[str], number: str) -> DataFrame:
    """(id, numbered): whether a record of the same identity has a homonym number other than 0; rows with a null in the identity have no siblings."""
    known = F.max((F.coalesce(F.trim(number), F.lit("0")) != "0").cast("int"))
    by = df.groupBy(*identity).agg(known.alias("__k"))
    return df.select(id_col, *identity).join(by, identity, "left").select(id_col, F.coalesce(F.col("__k") == 1, F.lit(False)).alias("numbered"))


def place_among(rows: DataFrame, thresholds: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """`rows` with the number of `thresholds` of their keys that aren't above `value` (a bisection), by one ordered pass over both.

    Both have the keys and the column `value`; equal values count. Groups of keys spread over partitions.
    """
    from .ordered import running_sum

    own = rows.select(*keys, value, F.struct(*rows.columns).alias("__row"), F.lit(0).alias("__t"), F.xxhash64(*rows.columns).alias("__h"))
    marks = thresholds.select(*keys, value).withColumns({"__row": F.lit(None).cast(own.schema["__row"].dataType), "__t": F.lit(1), "__h": F.monotonically_increasing_id()})
    both = own.unionByName(marks).withColumn("__o", -F.col("__t"))
    counted = running_sum(both, keys, [value, "__o", "__h"], F.col("__t").cast("bigint"), name)
    return counted.filter("__t = 0").select("__row.*", name)
