"""Writers: JSON Lines, sorted lists, tables of text, summaries, guarded writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import content_digest


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, fields in the order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sorted_list(df: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column as lines in order, in as many ordered files as the data needs."""
    lines = df.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
    lines.repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """A delimited table; arrays are joined by |."""
    cols = [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if dict(df.dtypes)[c].startswith("array") else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def summary(df: DataFrame, counts: dict[str, object] | None = None) -> str:
    """A JSON summary with a digest of the content that doesn't depend on row order."""
    r = content_digest(df, sorted(df.columns)).first()
    return json.dumps({"rows": r.n, "digest": f"{r.sum_a}-{r.sum_b}", **(counts or {})}, sort_keys=True)


def write_if_equal(df: DataFrame, other: DataFrame, path: str) -> bool:
    """Publish `df` only if it holds the same rows as `other`, however often each occurs."""
    if not (df.exceptAll(other).isEmpty() and other.exceptAll(df).isEmpty()):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def append_with_ids(df: DataFrame, existing: DataFrame, id_col: str, order: str) -> DataFrame:
    """New rows numbered on from the largest id that exists."""
    from . import number_rows

    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    return number_rows(df, [], [order], id_col).join(F.broadcast(top)).withColumn(id_col, F.col(id_col) + F.col("__top")).drop("__top")


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table beside the one at `path`, then put it in its place: readers see the old one or the new one, never a part.

    What `df` reads may be the old table itself.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = f"{path}.__new", f"{path}.__old"
    df.write.mode("overwrite").parquet(new)
    of = jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(of(old), True)
    if fs.exists(of(path)):
        fs.rename(of(path), of(old))
    if not fs.rename(of(new), of(path)):
        fs.rename(of(old), of(path))
        raise OSError(f"{path} wasn't replaced")
    fs.delete(of(old), True)


def content_sha(df: DataFrame) -> str:
    """A SHA-256 of a table's content that depends neither on the order of rows nor on their partitions.

    Rows are hashed where they are; the hashes are added up in 64 bytes of four sums, and those are hashed.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = df.select(*[F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(4)])
    sums = parts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)])
    return sums.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in sums.columns]), 256)).first()[0]


def sample_page(df: DataFrame, group: str, label: str, order: str, least: int = 5, title: str = "Sample") -> str:
    """An HTML page with the first `least` rows of every group, each with a choice of right and wrong, for people to judge.

    Only the sample comes to the driver; its size is the number of groups times `least`.
    """
    from html import escape

    from ..operators.grouping import top_per_key

    rows = top_per_key(df.select(*dict.fromkeys((group, label, order))), [group], [F.col(order)], least).orderBy(group, "rank").collect()
    parts, last = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"], object()
    for k, r in enumerate(rows):
        if r[group] != last:
            last = r[group]
            parts.append(f"<h2>{escape(str(last))}</h2>")
        choice = "".join(f'<label><input type=radio name=r{k} value={v}>{v}</label>' for v in ("right", "wrong"))
        parts.append(f"<p>{escape(str(r[label]))} {choice}</p>")
    return "\n".join(parts)
