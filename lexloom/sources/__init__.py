"""Readers of lexical sources, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _l = T.StringType(), T.LongType()
RECORD = T.StructType(
    [T.StructField(n, _s) for n in ("normaliserat_ord", "homonr", "ordkl", "stycke")]
    + [T.StructField(n, _l) for n in ("sidnr1", "sidnr2", "urspr_lopnr", "subnr")]
    + [T.StructField(n, _s) for n in ("text", "source", "upos", "ord")]
)
_FEAT = "ARRAY<STRUCT<_att: STRING, _val: STRING>>"
LMF = f"_id STRING, Lemma STRUCT<FormRepresentation: ARRAY<STRUCT<feat: {_FEAT}>>>, WordForm ARRAY<STRUCT<feat: {_FEAT}>>, feat {_FEAT}"
TSV = "level STRING, page_num INT, block_num INT, par_num INT, line_num INT, word_num INT, left INT, top INT, width INT, height INT, conf DOUBLE, text STRING"
GLYPH = "label STRING, role STRING, style STRING, pixels_relative_to_baseline ARRAY<ARRAY<INT>>, sources ARRAY<STRUCT<page: INT, `column`: INT, baseline: INT, source: STRING>>, reviewed BOOLEAN, model_id STRING"
#: Marks of forms that never stand alone.
NOT_STANDALONE = ("c", "ci", "cm", "sms")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the non-blank lines of text files with their numbers, counted in file order.

    Numbers come from per-partition counts and offsets, so a large file is read in parallel.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__i"), "value")
    return number_rows(raw, ["file"], ["block", "__i"], "line_no").filter(F.trim("value") != "").select("file", "line_no", "value")


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    from ..operators.ordered import running_sum

    return running_sum(df, keys, order, F.lit(1), name)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """JSON Lines with a `row_idx` in file order from 0; a line that isn't an object stops the read, with its number."""
    lines = numbered_lines(spark, path)
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    bad = ~F.trim("value").rlike(r"^\{.*\}$")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("file"), F.lit(":"), F.col("line_no").cast("string")))).otherwise(F.col("line_no") - 1)
    return parsed.select("r.*", checked.cast("bigint").alias("row_idx"))


def _feature(feats, name: str):
    return F.get(F.filter(feats, lambda f: f["_att"] == name), F.lit(0))["_val"]


def read_lmf(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, upos, lemmas, word_forms) of an LMF lexicon; namespaces don't matter."""
    x = spark.read.format("xml").option("rowTag", "LexicalEntry").option("ignoreNamespace", "true").schema(LMF).load(path)
    return flatten_lmf(x)


def flatten_lmf(x: DataFrame) -> DataFrame:
    """The flat form of parsed entries: written lemmas, forms with their marks, trailing hyphens left out."""
    lemmas = F.array_distinct(F.array_compact(F.transform("Lemma.FormRepresentation", lambda r: _feature(r["feat"], "writtenForm"))))
    forms = F.transform("WordForm", lambda w: F.struct(_feature(w["feat"], "writtenForm").alias("form"), _feature(w["feat"], "msd").alias("msd")))
    forms = F.filter(F.coalesce(forms, F.array().cast("array<struct<form:string,msd:string>>")), lambda f: f["form"].isNotNull())
    return x.select(
        F.col("_id").alias("entry_id"), F.regexp_extract(F.coalesce("_id", F.lit("")), r"\.\.([a-z]+)(?:\.|$)", 1).alias("upos"),
        F.coalesce(lemmas, F.array().cast("array<string>")).alias("lemmas"), forms.alias("word_forms"),
    )


def standalone(word_forms):
    """The forms of an entry that can stand alone."""
    return F.filter(word_forms, lambda f: ~F.lower(f["msd"]).isin(*NOT_STANDALONE) & ~f["form"].endswith("-"))


def read_tsv_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of an OCR table: rows of level 5 with text."""
    return ocr_words(spark.read.csv(path, sep="\t", header=True, quote="", schema=TSV))


def ocr_words(df: DataFrame) -> DataFrame:
    return df.filter((F.col("level") == "5") & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """Glyph models, one JSON document a file, in nested directories."""
    return spark.read.schema(GLYPH).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).filter("label is not null")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def strip_html(c):
    """Text of a page of HTML: scripts and tags out, common entities back, white space collapsed."""
    x = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def with_next(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the `columns` of the row after it, as next_<column>."""
    from ..operators.ordered import with_previous

    turned = df.select("*", *[(-F.col(o)).alias(f"__o_{o}") for o in order])
    return with_previous(turned, keys, [f"__o_{o}" for o in order], columns, "next_").drop(*[f"__o_{o}" for o in order])


def profile(df: DataFrame) -> DataFrame:
    """(field, type, rows, nulls, blanks, distinct, least, most): what each column holds, in one pass."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = c.cast("string")
        out.append(F.struct(
            F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"),
            F.count_if(F.trim(t) == "").alias("blanks"), F.approx_count_distinct(t).alias("distinct"), F.min(t).alias("least"), F.max(t).alias("most"),
        ))
    return df.agg(*[s.alias(f"c{i}") for i, s in enumerate(out)]).select(F.explode(F.array(*[f"c{i}" for i in range(len(out))])).alias("r")).select("r.*")
