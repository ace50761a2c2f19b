"""Text expressions: folding, cleaning, reasons, keys. All JVM-side but for NFC and case folding."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Null spellings; accents and their base letters; soft marks inside headwords.
NULL_TEXTS = ("", "(null)", "null")
ACCENTED = "àáâãåäçèéêëìíîïñòóôõöøùúûüýÿšž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyysz"
SOFT_MARKS = "­·|"
DASHES = "‐‑‒–—−"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Case folding by built-ins: lower case, and ß as ss."""
    return F.replace(F.lower(_c(c)), F.lit("ß"), F.lit("ss"))


def casefold(c: Column | str) -> Column:
    """Full case folding, Arrow batch by batch."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([v if v is None else v.casefold() for v in values.to_pylist()], pa.string())

    return run(_c(c))


def nfc(c: Column | str) -> Column:
    """Composed form; texts without marks or compatibility letters pass unchanged, without Python."""
    text = _c(c)

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([v if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())

    # a conditional would still run the function over all rows, so rows are emptied first
    needs = text.rlike(r"[\x{0300}-\x{036F}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}]")
    return F.when(needs, run(F.when(needs, text))).otherwise(text)


def is_null_text(c: Column | str) -> Column:
    """Absent: null, empty, or a spelling of null."""
    return F.coalesce(F.trim(_c(c)), F.lit("")).isin(*NULL_TEXTS)


def clean_surface(c: Column | str) -> Column:
    """A printed word without raised numbers, tags and soft marks, white space collapsed."""
    x = F.regexp_replace(_c(c), r"<sup>.*?</sup>|<[^>]*>", "")
    x = F.translate(x, SOFT_MARKS, "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def surface_lemma(printed: Column | str, normal: Column | str) -> Column:
    """The cleaned printed word, or the cleaned normalised one where that is empty."""
    return F.coalesce(F.nullif(clean_surface(printed), F.lit("")), clean_surface(normal))


def comparison_key(c: Column | str) -> Column:
    """A cleaned word with one kind of dash, folded."""
    return fold(F.translate(clean_surface(c), DASHES, "-" * len(DASHES)))


def is_letters(c: Column | str) -> Column:
    return _c(c).rlike(r"^\p{L}+\z")


def rejection_reason(c: Column | str) -> Column:
    """Why a word can't be used, the first reason that holds; null for usable words."""
    w = _c(c)
    return (
        F.when(w.isNull() | (w == ""), "EMPTY")
        .when(F.length(w) == 1, "ONE_CHARACTER")
        .when(is_letters(w), F.lit(None).cast("string"))
        .when(w.rlike(r"[\p{Nd}²³¹⁰-⁹₀-₉]"), "CONTAINS_DIGIT")
        .when(w.rlike("[-‐‑‒–—−]"), "CONTAINS_HYPHEN")
        .when(w.rlike("['’]"), "CONTAINS_APOSTROPHE")
        .otherwise("CONTAINS_OTHER_NONLETTER")
    )


def strip_separators(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"[\s\-·|/']", "")


def strip_accents(c: Column | str) -> Column:
    return F.translate(_c(c), ACCENTED + ACCENTED.upper(), PLAIN + PLAIN.upper())


def loose_key(c: Column | str) -> Column:
    return F.regexp_replace(strip_accents(fold(c)), "[^a-z0-9]", "")


def deletion_keys(c: Column | str) -> Column:
    """The strings that leaving out one character gives, without repeats."""
    w = _c(c)
    n = F.length(w)
    keys = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    return F.when(n > 1, F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def words(c: Column | str, pattern: str = r"\p{L}+") -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(_c(c), F.lit(f"({pattern})"), F.lit(1))


def relative_form(base: Column | str, form: Column | str) -> Column:
    """`+suffix` where the form begins with its base, `=form` elsewhere."""
    b, f = _c(base), _c(form)
    return F.when(f.startswith(b), F.concat(F.lit("+"), F.expr(f"substr({_sql(form)}, length({_sql(base)}) + 1)"))).otherwise(F.concat(F.lit("="), f))


def _sql(c: Column | str) -> str:
    if not isinstance(c, str):
        raise TypeError("give column names")
    return f"`{c}`"


def genitive(c: Column | str) -> Column:
    """A genitive: an s is added unless the word ends in s, x or z."""
    w = _c(c)
    return F.when(w.rlike("(?i)[sxz]$"), w).otherwise(F.concat(w, F.lit("s")))


def join_parts(prefix: Column | str, head: Column | str) -> Column:
    """A compound of two parts; of three equal consonants at the joint one is left out."""
    p, h = _c(prefix), _c(head)
    first = F.substring(h, 1, 1)
    triple = first.rlike("[^aeiouyåäö]") & F.right(p, F.lit(2)).eqNullSafe(F.concat(first, first))
    return F.when(triple, F.concat(F.substring(p, F.lit(1), F.length(p) - 1), h)).otherwise(F.concat(p, h))


def mentions(text: Column | str, form: Column | str) -> Column:
    """Whether a text has a form as a whole word, whatever its case."""
    return F.rlike(F.lower(_c(text)), F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(_c(form)), F.lit(r"\E(?!\w)")))
