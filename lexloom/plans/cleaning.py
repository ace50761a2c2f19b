"""Queries of the general data-cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import cell_diff
from ..operators.packed import unpack_values
from ..operators.skew import heavy_keys, lookup_join
from ..tables import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys on one side only and fields that differ between the two copies of the keyed forms."""
    generated = table(spark, sf, "generated_word_forms").select("form_key", "written_form", "msd")
    saldo = table(spark, sf, "saldo_word_forms").filter("form_key is not null")
    lexemes = table(spark, sf, "lexeme_slots").select("lexeme_id", F.col("lemma").alias("listed"))
    heavy = heavy_keys(saldo.groupBy("lexeme_id").agg(F.count(F.lit(1)).alias("n")).filter("lexeme_id is not null"), ["lexeme_id"])
    named = lookup_join(saldo.select("form_key", "lexeme_id", "lemma"), lexemes, ["lexeme_id"], heavy, "left")
    # both lemmas stand in one row here: only cells that don't cancel go on
    lemma_cells = named.filter(~F.col("lemma").eqNullSafe(F.col("listed"))).select(
        F.col("form_key").alias("key"), F.lit("lemma").alias("field"),
        F.explode(F.array(F.struct(F.col("listed").alias("value"), F.lit(1).alias("sign")), F.struct(F.col("lemma").alias("value"), F.lit(-1).alias("sign")))).alias("c"),
    ).select("key", "field", "c.value", "c.sign")
    return cell_diff(
        generated, saldo, "form_key", ["written_form", "msd"], "only_generated", "only_saldo", extra_cells=lemma_cells
    )


P3_SQL = """
WITH g AS (SELECT DISTINCT form_key, written_form, msd FROM generated_word_forms WHERE form_key IS NOT NULL),
s AS (SELECT DISTINCT s.form_key, s.written_form, s.msd, s.lemma, l.lemma AS listed
      FROM saldo_word_forms s LEFT JOIN lexeme_slots l ON l.lexeme_id = s.lexeme_id WHERE s.form_key IS NOT NULL),
j AS (SELECT coalesce(g.form_key, s.form_key) AS form_key, g.form_key IS NULL AS no_g, s.form_key IS NULL AS no_s,
        g.written_form IS DISTINCT FROM s.written_form AS w, g.msd IS DISTINCT FROM s.msd AS m,
        s.lemma IS DISTINCT FROM s.listed AS l
      FROM g FULL JOIN s ON g.form_key = s.form_key)
SELECT form_key, 'only_generated' AS difference FROM j WHERE no_s
UNION ALL SELECT form_key, 'only_saldo' FROM j WHERE no_g
UNION ALL SELECT form_key, 'written_form' FROM j WHERE NOT no_g AND NOT no_s AND w
UNION ALL SELECT form_key, 'msd' FROM j WHERE NOT no_g AND NOT no_s AND m
UNION ALL SELECT form_key, 'lemma' FROM j WHERE NOT no_g AND NOT no_s AND l"""


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each value of each notation that holds at least two."""
    return unpack_values(table(spark, sf, "lexeme_slots"), "lexeme_id", "notation", least=2)


QUERIES = {"p3_found": p3_found, "p6_found": p6_found}
SQL = {"p3_found": P3_SQL}
