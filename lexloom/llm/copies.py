"""Duplicates hidden by formatting: one record for each set of copies, with their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, lookup_join
from ..session import cut

#: What counts as formatting between letters and digits.
WHITE_SPACE = " \t\n\r\x0b\x0c"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~·“”„»«’‘–—…"
FIELD_SEPARATORS = ";,|/&\n\t"
#: Characters that lower-casing would turn into other letters; they stay apart.
SINGLES = "\u212b\u212a\u2126"
APART = "\ue000\ue001\ue002"


def plain_text(c: Column) -> Column:
    """A text without letter case, white space and punctuation; null stays null."""
    folded = F.translate(F.lower(F.translate(c, SINGLES, APART)), "ς", "σ")
    return F.translate(folded, WHITE_SPACE + PUNCTUATION, "")


def plain_fields(c: Column) -> Column:
    """Name-value fields in one order, each as plain_text; empty fields count as absent."""
    parts = F.split(c, "[" + FIELD_SEPARATORS.replace("\n", "\\n").replace("\t", "\\t") + "]+")
    return F.concat_ws(";", F.array_sort(F.filter(F.transform(parts, plain_text), lambda x: x != "")))


def canonical_record(exact: list[str], loose: list[str], fields: list[str]) -> Column:
    """The canonical string of a record: each part with its length, a null as its own mark."""
    parts = [F.col(c).cast("string") for c in exact]
    parts += [plain_text(F.col(c)) for c in loose]
    # without the outer test, concat_ws would make an empty string of a null
    parts += [F.when(F.col(c).isNotNull(), plain_fields(F.col(c))) for c in fields]
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def _hashed(df: DataFrame, id_col: str, canon: Column) -> DataFrame:
    text = df.select(F.col(id_col).alias("id"), canon.alias("canon"))
    return text.select(
        "id", "canon", F.xxhash64("canon").alias("h1"), F.xxhash64(F.lit("second"), "canon").alias("h2"),
        # one number, so that counting stays in a hash table
        (F.shiftleft(F.length("canon").cast("bigint"), 32).bitwiseOR(F.crc32(F.col("canon").cast("binary")))).alias("check"),
    )


def _groups(df: DataFrame, id_col: str, canon: Column) -> DataFrame:
    """Every 128-bit hash with the number of its records, the smallest id and the collision check."""
    return (
        _hashed(df, id_col, canon)
        .groupBy("h1", "h2")
        .agg(
            F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"),
            F.min("check").alias("lo"), F.max("check").alias("hi"),
        )
        .select("h1", "h2", "keep_id", "n", (F.col("lo") != F.col("hi")).alias("clash"))
    )


def copy_pairs(df: DataFrame, id_col: str, exact: list[str], loose: list[str], fields: list[str]) -> DataFrame:
    """(keep_id, copy_id) for every record but the first of each set of equal records.

    Records are equal if the `exact` columns are equal as stored, the `loose` ones but for
    white space, letter case and punctuation, and the `fields` ones also but for the order of
    their fields; null equals null only. keep_id is the smallest id. Canonical strings are
    hashed to 128 bits and counted with map-side combining; a hash whose records differ in
    length or checksum is resolved by the strings themselves. Sets that hold a large share of
    all rows are joined by broadcast (their number is bounded). Rows whose id is null take no
    part. Empty tables give no rows.
    """
    canon = canonical_record(exact, loose, fields)
    df = df.filter(F.col(id_col).isNotNull())
    sets = cut(_groups(df, id_col, canon).filter("n > 1"), "copies")
    rows = _hashed(df, id_col, canon)
    clear = _members(rows.select("id", "h1", "h2"), sets.filter("not clash"), ["h1", "h2"])
    clashes = sets.filter("clash")
    if clashes.isEmpty():
        return clear
    doubtful = rows.join(clashes.select("h1", "h2"), ["h1", "h2"], "left_semi").select("id", "canon")
    exact_sets = doubtful.groupBy("canon").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return clear.unionByName(_members(doubtful, exact_sets, ["canon"]))


def _members(rows: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    heavy = heavy_keys(sets, keys)
    return (
        lookup_join(rows, sets.select(*keys, "keep_id"), keys, heavy)
        .filter("id != keep_id")
        .select("keep_id", F.col("id").alias("copy_id"))
    )


def collapsed(df: DataFrame, id_col: str, exact: list[str], loose: list[str], fields: list[str]) -> DataFrame:
    """One row (keep_id, copies) for each set of equal records (see copy_pairs), singles included.

    Sets are told apart by 128 bits of hash, the length and a checksum: records of one hash
    that differ in length or checksum are counted apart.
    """
    canon = canonical_record(exact, loose, fields)
    df = df.filter(F.col(id_col).isNotNull())
    all_sets = (
        _hashed(df, id_col, canon)
        .groupBy("h1", "h2", "check")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    )
    return all_sets.select("keep_id", "copies")
