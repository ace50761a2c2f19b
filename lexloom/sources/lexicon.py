"""Further readers: LMF in its older reading, labels of forms, tables with a header, single records, files fetched whole."""

from __future__ import annotations

import hashlib
import os
import shutil
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LMF, _feature


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The parsed LexicalEntry elements of an LMF lexicon; namespaces don't matter."""
    return spark.read.format("xml").option("rowTag", "LexicalEntry").option("ignoreNamespace", "true").schema(LMF).load(path)


def all_written_forms(entries: DataFrame) -> DataFrame:
    """(entry_id, lemma, forms): every written form of an entry, of lemmas and word forms alike, sorted and once each.

    The lemma is the first written form of the lemma element, else the smallest form of all.
    """
    none = F.array().cast("array<string>")
    own = F.array_compact(F.transform("Lemma.FormRepresentation", lambda r: _feature(r["feat"], "writtenForm")))
    others = F.array_compact(F.transform("WordForm", lambda w: _feature(w["feat"], "writtenForm")))
    forms = F.array_sort(F.array_distinct(F.concat(F.coalesce(own, none), F.coalesce(others, none))))
    d = entries.select(F.col("_id").alias("entry_id"), F.coalesce(own, none).alias("own"), forms.alias("forms"))
    return d.select("entry_id", F.coalesce(F.get("own", F.lit(0)), F.array_min("forms")).alias("lemma"), "forms")


def form_labels(entries: DataFrame) -> DataFrame:
    """(form, labels): every folded form with the grammatical labels that entries give it, sorted."""
    w = entries.select(F.explode("WordForm").alias("w")).select(F.lower(_feature(F.col("w.feat"), "writtenForm")).alias("form"), _feature(F.col("w.feat"), "msd").alias("msd"))
    return w.filter("form is not null").groupBy("form").agg(F.array_sort(F.collect_set("msd")).alias("labels"))


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A delimited table with a header and an explicit schema; quotes are letters like any other. Fields that don't fit are null."""
    return spark.read.csv(path, sep=sep, header=True, quote="", schema=schema)


def one_record(df: DataFrame, key: str, value: object, order: str) -> DataFrame:
    """The first record, by `order`, whose key has the value; no row if there is none."""
    return df.filter(F.col(key) == F.lit(value)).orderBy(order).limit(1)


def fetch(url: str, target: str, overwrite: bool = False) -> str:
    """Copy a file from an address to a place of the driver, whole or not at all; its SHA-256.

    An existing file is kept unless `overwrite`. What has come so far has another name until it is complete.
    """
    if os.path.exists(target) and not overwrite:
        raise FileExistsError(target)
    digest = hashlib.sha256()
    part = target + ".part"
    try:
        with urllib.request.urlopen(url) as source, open(part, "wb") as out:
            while block := source.read(1 << 20):
                digest.update(block)
                out.write(block)
        shutil.move(part, target)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return digest.hexdigest()
