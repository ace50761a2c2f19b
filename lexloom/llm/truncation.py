"""Text cut off by field limits or in transfer.

Values are sorted by range and compared with the next ones: a value that is a strict prefix
of any longer one is a prefix of the next distinct one, so one pass over sorted partitions
(and what is open at each border) finds them all, whatever prefix many values share. Headwords
of references go through the same pass: one is cut if it's a strict prefix of a longer headword
and none itself. Texts also meet what other pages print: the hash of a fixed-length prefix is
looked up among those that begin at every line, and the longer copy is compared in full. Where
no longer copy exists the end itself decides: a complete text ends with a sentence or a
reference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .scans import REFERENCE_MARKS, LineModel, _flags, broken_token

#: What a cut may leave behind its place.
CUT_MARKS = r"(\s|…|\.\.\.|\[…\]|\[\.\.\.\])+$"
#: A dotted word is an abbreviation if it's as frequent as this share of all words, dotted this often.
ABBREVIATION_SHARE, DOTTED_SHARE = 2e-4, 0.9
#: Lengths of the prefixes by which texts are looked up in others: each text by the longest it has.
PREFIX_TIERS = (256, 128, 64, 32)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (text, asked, whole): the asked ones that a later whole value begins with, the first whole value, and the asked ones still open."""
    import pyspark

    part = pyspark.TaskContext.get().partitionId()
    open_: list[str] = []  # each a prefix of the next
    first = True
    rows = lambda out: pa.RecordBatch.from_arrays(
        [pa.array([part] * len(out), pa.int32()), pa.array([k for k, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], names=["part", "kind", "text"]
    )
    for batch in batches:
        out = []
        for text, asked, whole in zip(*(c.to_pylist() for c in batch.columns)):
            while open_ and not text.startswith(open_[-1]):
                open_.pop()
            if whole:
                out += [("prefix", t) for t in open_]
                open_ = []
                if first:
                    out.append(("first", text))
                    first = False
            if asked:
                open_.append(text)
        yield rows(out)
    yield rows([("open", t) for t in open_])


def strict_prefixes(values: DataFrame, column: str, others: DataFrame | None = None) -> DataFrame:
    """The distinct values (text) that are strict prefixes of other values of the column, or of `others`.

    Nulls and empty values aren't considered. Of each sorted partition only its first whole
    value and the values still open at its end, each a prefix of the next, come to the driver.
    """
    texts = values.select(F.col(column).alias("text"), F.lit(True).alias("asked"), F.lit(others is None).alias("whole"))
    if others is not None:
        texts = texts.unionByName(others.select(F.col(column).alias("text"), F.lit(False).alias("asked"), F.lit(True).alias("whole")))
    texts = texts.filter("text <> ''").groupBy("text").agg(F.max("asked").alias("asked"), F.max("whole").alias("whole"))
    ordered = texts.repartitionByRange("text").sortWithinPartitions("text")
    found = cut(ordered.mapInArrow(_neighbours, "part int, kind string, text string"), "prefixes")
    firsts = {r.part: r.text for r in found.filter("kind = 'first'").collect()}
    more = []
    for r in found.filter("kind = 'open'").collect():
        later = [p for p in firsts if p > r.part]
        if later and firsts[min(later)].startswith(r.text):
            more.append((r.text,))
    hits = found.filter("kind = 'prefix'").select("text")
    return hits.unionByName(values.sparkSession.createDataFrame(more, "text string")) if more else hits


def longer_copies(values: DataFrame, pages: DataFrame) -> DataFrame:
    """The distinct values (text) that a text of `pages` (text) goes on from, beginning at one of its lines: looked up by the hash of a fixed-length prefix, compared in full.

    Lines of a page are read as one text; values shorter than the shortest prefix aren't
    looked up. Equal values and equal pages are looked up once.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    asked = values.select("text").filter("text <> ''").distinct().withColumn("flat", flat("text"))
    n = F.length("flat")
    own = " ".join(f"when length(flat) >= {t} then xxhash64({t}, left(flat, {t}))" for t in PREFIX_TIERS)
    asked = asked.filter(n >= PREFIX_TIERS[-1]).withColumn("key", F.expr(f"case {own} end"))
    each = pages.filter("text <> ''").groupBy(F.unhex(F.md5("text")).alias("page")).agg(F.first("text").alias("text"))
    lines = each.select("page", F.expr("filter(transform(split(text, '\n'), x -> trim(regexp_replace(x, '\\\\s+', ' '))), x -> x <> '')").alias("lines"))
    # a prefix of the longest kind needs no more lines than it has characters
    start = F.expr(f"array_join(slice(lines, at + 1, {PREFIX_TIERS[0]}), ' ')")
    starts = lines.select("page", "lines", F.posexplode("lines").alias("at", "line")).select("page", "at", start.alias("rest"))
    keys = F.array(*[F.when(F.length("rest") > t, F.expr(f"xxhash64({t}, left(rest, {t}))")) for t in PREFIX_TIERS])
    offered = starts.select("page", "at", F.explode(F.array_compact(keys)).alias("key"))
    # keys meet without their texts; only what met is compared in full
    met = offered.join(asked.select("key").distinct(), "key", "left_semi").join(lines, "page")
    whole = met.select("key", F.expr("array_join(slice(lines, at + 1, size(lines)), ' ')").alias("rest"))
    return whole.join(asked, "key").filter(F.col("rest").startswith(F.col("flat")) & (F.length("rest") > n)).select("text").distinct()


def abbreviations(texts: DataFrame, column: str) -> frozenset[str]:
    """Words that always carry a full stop: fewer than 1 / ABBREVIATION_SHARE, from counts over all texts."""
    words = texts.select(F.explode(F.split(column, r"\s+")).alias("w")).filter("w <> ''")
    bare = F.lower(F.regexp_replace("w", r"[,;:\)\]]*$|\.[,;:\)\]]*$", ""))
    counts = words.groupBy(bare.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w").rlike(r"\.$").cast("int")).alias("dotted"))
    total = counts.agg(F.sum("n").alias("total"))
    few = counts.join(F.broadcast(total), (F.col("n") > F.col("total") * ABBREVIATION_SHARE) & (F.col("dotted") > F.col("n") * DOTTED_SHARE))
    return frozenset(r.w for r in few.select("w").collect())


_REFERENCE = re.compile(r"(?:^|\s)(?:" + "|".join(map(re.escape, REFERENCE_MARKS)) + r")\s+(\S+(?: (?:\S{1,4}))?)$")


def text_end(tail: str, short: frozenset[str]) -> tuple[bool | None, str | None]:
    """(complete, None) from a text's end, or (None, headword) if it hangs on a reference."""
    if re.search(r"(…|\.\.\.|\[…\]|\[\.\.\.\])\s*$", tail):
        return False, None
    end = tail.rstrip()
    if re.search(r"\.[\)\]»”\"]*$", end):
        word = re.sub(r"\.[\)\]»”\"]*$", "", end).split()[-1:] or [""]
        return word[0].lstrip("([").lower() not in short, None
    m = _REFERENCE.search(end)
    return (None, m.group(1)) if m else (False, None)


def page_tail(lines: list[str], model: LineModel, page_no: int | None) -> str:
    """The running text of a page, furniture aside, broken words joined."""
    n = len(lines)
    p = model.furniture_odds([(x, page_no) for x in lines])
    window = [(x, i, n - 1 - i) for i, x in enumerate(lines)]
    running = [x for x, f in zip(lines, _flags(window, [p[x, page_no] for x in lines])) if not f]
    out: list[str] = []
    for x in running:
        if out and broken_token(out[-1]):
            out[-1] = out[-1].rstrip()[:-1] + x.strip()
        else:
            out.append(x if x is running[-1] else x.strip())
    return " ".join(out)


def page_tails(pages: DataFrame, model: LineModel) -> DataFrame:
    """(row_id, text, tail) of page texts (row_id, page_no, text); tail is null with the text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def tails(batches):
        for batch in batches:
            out = []
            for page_no, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = [x for x in (text or "").split("\n") if x.strip()]
                out.append(page_tail(lines, shared.value, page_no) if lines else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string())], names=["row_id", "text", "tail"])

    return pages.select("row_id", "page_no", "text").mapInArrow(tails, "row_id bigint, text string, tail string")


def _ends(tails: DataFrame, short: frozenset[str]) -> DataFrame:
    @F.arrow_udf("struct<complete: boolean, headword: string>")
    def judge(tail: pa.Array) -> pa.Array:
        out = [text_end(t, short) if t and t.strip() else (True, None) for t in tail.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([c for c, _ in out], pa.bool_()), pa.array([h for _, h in out], pa.string())], names=["complete", "headword"])

    return tails.withColumn("end", judge("tail")).select("*", "end.complete", "end.headword").drop("end")


def cut_headwords(asked: DataFrame, headwords: DataFrame) -> DataFrame:
    """The headwords asked for that are no headword but a strict prefix of one: (headword).

    Single characters that are no headword count as cut.
    """
    asked = asked.select("headword").filter("headword <> ''").distinct()
    known = headwords.select("headword").filter("headword <> ''").distinct()
    open_ = asked.join(known, "headword", "left_anti")
    longer = strict_prefixes(open_, "headword", known).withColumnRenamed("text", "headword")
    return longer.unionByName(open_.filter(F.length("headword") < 2)).distinct()


def find_truncated(tails: DataFrame, headwords: DataFrame, short: frozenset[str], pages: DataFrame | None = None) -> DataFrame:
    """The rows of (origin, row_id, text, tail, ...) whose text is cut off, each with the `rule` that found it.

    `longer_copy`: a strict prefix of a longer text, or of what a text of `pages` (text) prints
    from one of its lines on, that doesn't end a sentence. `reference`: ends with a reference to
    a cut headword. `open_end`: the tail ends neither a sentence nor a reference. Null, empty
    and blank texts are no cases; repeated rows are judged each; whole texts are compared.
    """
    judged = _ends(tails, short).withColumn("bare", F.regexp_replace("text", CUT_MARKS, "")).withColumn("bare_key", F.unhex(F.md5("bare")))
    judged = cut(judged, "ends")
    cut_words = cut_headwords(judged.select("headword"), headwords).select("headword", F.lit(True).alias("cut_word"))
    longer = strict_prefixes(judged, "bare")
    if pages is not None:
        longer = longer.unionByName(longer_copies(judged.select(F.col("bare").alias("text")), pages)).distinct()
    longer = longer.select(F.unhex(F.md5("text")).alias("bare_key"), F.lit(True).alias("has_longer"))
    out = judged.join(cut_words, "headword", "left").join(longer, "bare_key", "left")
    whole = F.coalesce("complete", F.lit(True))
    ended = F.col("bare").rlike(r"\.[\)\]»”\"]*$") & whole
    rule = F.when(F.coalesce("has_longer", F.lit(False)) & ~ended, "longer_copy").when(F.coalesce("cut_word", F.lit(False)), "reference").when(~whole, "open_end")
    return out.withColumn("rule", rule).filter("rule is not null").select(*tails.columns, "rule")
