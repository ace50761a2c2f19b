"""Articles, headings and references from raw lexical rows, without losing a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold


def is_reference(ordkl: str = "ordkl"):
    """Rows whose word class begins with the mark of a reference."""
    return fold(F.trim(F.coalesce(F.col(ordkl), F.lit("")))).startswith("(hv)")


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _heading():
    return F.coalesce(*[F.nullif(_text(c), F.lit("")) for c in ("ord", "stycke", "normaliserat_ord")], F.lit(""))


def materialize(records: DataFrame) -> dict[str, DataFrame]:
    """The relations articles, headings, references and unresolved of rows with a row_idx.

    Rows group by (source id, subnr). A homonym number 0 is no homonym but an alternate heading
    of the only other homonym of its group; with none or several others it stays unresolved.
    Article attributes are those of its earliest row. Nulls count as empty.
    """
    key = ["source_id", "subnr"]
    rows = records.select(
        F.coalesce(F.nullif(_text("urspr_lopnr"), F.lit("")), _text("subnr")).alias("source_id"), F.coalesce(F.nullif(_text("subnr"), F.lit("")), _text("urspr_lopnr")).alias("subnr"),
        _text("homonr").alias("homonr"), _heading().alias("heading"), _text("normaliserat_ord").alias("lemma"), _text("upos").alias("upos"), _text("ordkl").alias("ordkl"),
        _text("text").alias("notation"), _text("source").alias("source"), _text("stycke").alias("stycke"), F.col("row_idx"), is_reference().alias("is_reference"),
    )
    lexical, refs = rows.filter(~F.col("is_reference")), rows.filter("is_reference")
    numbered = F.when(~F.col("homonr").isin("", "0"), F.col("homonr"))
    # only the count and the smallest number are needed, so no set of a large group is built
    anchors = lexical.groupBy(*key).agg(F.min(numbered).alias("lo"), F.max(numbered).alias("hi"))
    anchor = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    tied = lexical.join(anchors, key).withColumn("number", F.coalesce(numbered, F.when(F.col("homonr") == "0", anchor), anchor, F.lit("")))
    ident = F.when(F.col("number") != "", F.concat_ws(":", "source_id", "subnr", "number")).otherwise(F.lit(""))
    headings = tied.select(
        ident.alias("article_id"), "heading", F.when(numbered.isNotNull(), "primary").otherwise("alternate").alias("heading_type"), "lemma", F.col("number").alias("homonym_number"),
        F.col("homonr").alias("source_homonym_number"), *key, "stycke", "upos", "ordkl", "notation", "source", F.col("row_idx").alias("source_row_index"),
    )
    attributes = ["source_id", "subnr", "lemma", "homonym_number", "upos", "ordkl", "notation", "source"]
    first = F.struct(F.col("heading_type") == "alternate", F.col("source_row_index"))
    articles = headings.filter("article_id <> ''").groupBy("article_id").agg(
        F.min_by(F.struct(*attributes), first).alias("a"), F.count(F.lit(1)).cast("int").alias("source_row_count")
    ).select("article_id", "a.*", "source_row_count")
    low = fold(F.col("ordkl")), fold(F.col("notation"))
    inflected = F.reduce(F.array(*[x.contains(m) for x in low for m in ("komp.", "superl.")]), F.lit(False), lambda a, b: a | b)
    references = refs.select(
        F.concat_ws(":", "source_id", "subnr", "homonr", "heading").alias("reference_id"), *key, F.col("homonr").alias("source_homonym_number"), F.col("heading").alias("source_heading"),
        F.col("lemma").alias("target_lemma"), F.when(inflected, "inflection_reference").when(F.col("ordkl").contains("<i>"), "morphology_annotated_reference").otherwise("plain_reference").alias("reference_type"),
        "ordkl", "notation", "source", F.col("row_idx").alias("source_row_index"),
    )
    unresolved = headings.filter("article_id = ''").select(*key, "lemma", "source_row_index")
    return {"articles": articles, "headings": headings, "references": references, "unresolved": unresolved}


def integrity(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(problem, key) of keys without a counterpart: `dangling` children, `childless` parents."""
    a = children.select(F.col(child_key).alias("key")).distinct()
    b = parents.select(F.col(parent_key).alias("key")).distinct()
    dangling = a.join(b, "key", "left_anti").select(F.lit("dangling").alias("problem"), "key")
    return dangling.unionByName(b.join(a, "key", "left_anti").select(F.lit("childless").alias("problem"), "key"))
