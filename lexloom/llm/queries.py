"""Queries of the operators for training text, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..tables import table
from . import bpe, canonical, copies, matching, packing, residue, scans, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "generated_word_forms")
        .select(F.lit("generated_word_forms").alias("origin"), "row_id", "written_form")
        .unionByName(
            table(spark, sf, "slot_forms").select(
                F.lit("slot_forms").alias("origin"), F.col("slot_form_id").alias("row_id"), "written_form"
            )
        )
    )


@_query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Forms that aren't in the plain spelling they show."""
    plain = _forms(spark, sf).withColumn("plain", canonical.canonical("written_form"))
    return plain.filter(F.col("plain") != F.col("written_form")).select("origin", "row_id")


@_query
def p2_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Every form in its consistent spelling."""
    return _forms(spark, sf).select("origin", "row_id", canonical.canonical("written_form").alias("written_form"))


_P4 = {"exact": ["lexeme_id", "msd"], "loose": ["written_form", "kind"], "fields": ["features"]}


@_query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of a record in other formatting, each with the record that is kept."""
    return copies.copy_pairs(table(spark, sf, "generated_word_forms"), "row_id", **_P4)


@_query
def p4_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each set of copies, with their number."""
    return copies.collapsed(table(spark, sf, "generated_word_forms"), "row_id", **_P4)


def _sql_text(c: str) -> str:
    strip = (copies.WHITE_SPACE + copies.PUNCTUATION).replace("'", "''")
    return f"translate(translate(lower(translate({c}, '{copies.SINGLES}', '{copies.APART}')), 'ς', 'σ'), '{strip}', '')"


_SQL_CANON = f"""
SELECT row_id, lexeme_id, msd, {_sql_text('written_form')} AS w, {_sql_text('kind')} AS k,
  CASE WHEN features IS NULL THEN NULL ELSE coalesce(array_to_string(list_sort(list_filter(list_transform(
    string_split_regex(features, '[;,|/&\\n\\t]+'), lambda x: {_sql_text('x')}), lambda y: y <> '')), ';'), '') END AS f
FROM generated_word_forms WHERE row_id IS NOT NULL"""
SQL["p4_found"] = f"""
WITH c AS ({_SQL_CANON}),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY lexeme_id, msd, w, k, f) AS keep_id FROM c)
SELECT keep_id, row_id AS copy_id FROM g WHERE keep_id <> row_id"""
SQL["p4_collapsed"] = f"""
WITH c AS ({_SQL_CANON})
SELECT min(row_id) AS keep_id, count(*) AS copies FROM c GROUP BY lexeme_id, msd, w, k, f"""


@_query
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return table(spark, sf, "documents").select("doc_id", bpe.token_ids(spark, "text").alias("ids"))


@_query
def p9_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in a container, for each capacity of pack_limits."""
    limits = {r.limit_id: r.capacity for r in table(spark, sf, "pack_limits").collect()}
    sized = table(spark, sf, "documents").select("doc_id", bpe.token_count(spark, "text").alias("tokens"))
    packed = packing.pack_each(sized, "doc_id", "tokens", limits)
    return packed.select("limit_id", "capacity", F.col("container").alias("container_id"), F.col("id").alias("doc_id"), "part", "start", "size")


def _noise(spark: SparkSession, sf: str):
    return scans.find_noise(
        table(spark, sf, "runeberg_pages").select(F.col("page_id").alias("row_id"), F.col("page").alias("page_no"), "text"),
        table(spark, sf, "ocr_words"),
        table(spark, sf, "print_vocab"),
        table(spark, sf, "lexeme_slots").select(F.col("lemma").alias("word")),
    )


@_query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Furniture, broken words and misread words of the pages and their second readings."""
    _, items, corrections, _ = _noise(spark, sf)
    return scans.noise_rows(items, corrections)


@_query
def p1_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as the running text of its articles."""
    _, items, corrections, _ = _noise(spark, sf)
    pages = table(spark, sf, "runeberg_pages").select(F.col("page_id").alias("row_id"), "text")
    return scans.repaired_pages(pages, "runeberg_pages", items, corrections).withColumnRenamed("row_id", "page_id")


def _truncated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf, "runeberg_pages").select(F.col("page_id").alias("row_id"), F.col("page").alias("page_no"), "text", "source")
    model = scans.fit_lines(cut(scans.page_lines(pages, "runeberg_pages"), "lines"), scans.fixed_words(table(spark, sf, "print_vocab")))
    origin = lambda name: F.lit(name).alias("origin")
    articles = table(spark, sf, "match_candidates").select(origin("match_candidates"), F.col("candidate_id").alias("row_id"), F.col("article_text").alias("text"), F.col("article_text").alias("tail"))
    tails = truncation.page_tails(pages, model).select(origin("runeberg_pages"), "row_id", "text", "tail").unionByName(articles)
    tails = cut(tails, "tails")
    # a reference names the first word of a headword of several
    headwords = table(spark, sf, "lexeme_slots").select(F.explode(F.array("lemma", F.split("lemma", " ")[0])).alias("headword"))
    found = truncation.find_truncated(tails, headwords, truncation.abbreviations(tails, "text"), pages)
    sources = pages.select(origin("runeberg_pages"), "row_id", "source", "text").unionByName(
        table(spark, sf, "match_candidates").select(origin("match_candidates"), F.col("candidate_id").alias("row_id"), "source", F.col("article_text").alias("text"))
    )
    return found, sources


@_query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and articles whose text stops before its end."""
    return _truncated(spark, sf)[0].select("origin", "row_id")


@_query
def p5_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows, each with the rule that found it."""
    return _truncated(spark, sf)[0].select("origin", "row_id", "rule")


@_query
def p5_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts its texts."""
    found, sources = _truncated(spark, sf)
    marked = sources.filter("text is not null").join(found.select("origin", "row_id", F.lit(1).alias("is_cut")), ["origin", "row_id"], "left")
    return marked.groupBy("origin", "source").agg(
        F.count(F.lit(1)).alias("texts"), F.count("is_cut").alias("cut_texts"), F.round(F.count("is_cut") / F.count(F.lit(1)), 4).alias("share")
    )


@_query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with residue in the place of content."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    model = residue.fit_residue(documents, "text")
    return documents.filter(residue.has_residue(documents, "text", model)).select("doc_id")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_entities(table(spark, sf, "lexeme_slots"), table(spark, sf, "slot_forms"), table(spark, sf, "saldo_analyses"))


@_query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the other lexicon and the lexemes they describe."""
    return _matches(spark, sf).select("lexeme_id", "entry_id")


@_query
def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs, each with its confidence."""
    return _matches(spark, sf)
