"""Column functions of dictionary records: word classes, keys, notation shapes, flags. All JVM-side but for composed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DASHES, SOFT_MARKS, _c, comparison_key, fold, is_letters, is_null_text, nfc

# ---- fixed values -------------------------------------------------------------------
#: The tokens of a word-class head that name each class.
CLASS_TOKENS = {
    "NOUN": ("subst.", "substantiv", "s."),
    "VERB": ("verb", "v.", "rxv", "ptv"),
    "ADJ": ("adj.", "adjektiv"),
    "ADV": ("adv.",),
    "PRON": ("pron.",),
    "NUM": ("räkn.", "räkneord"),
    "DET": (),
    "PART": ("infinitivmärke",),
    "PROPN": ("namn",),
    "INTJ": ("interj.",),
    "ADP": ("prep.",),
    "CCONJ": ("konj.", "samordnande"),
    "SCONJ": ("subj.", "underordnande"),
}
#: Pairs of tokens that name a class, and words that do within others.
CLASS_PAIRS = {"DET": (("best.", "artikel"), ("obest.", "artikel"))}
CLASS_WORDS = {"ADV": "adverbiellt"}
#: Parts of a head that decide its one class, in order of precedence.
CLASS_PARTS = [
    ("PROPN", ("namn",)), ("INTJ", ("interj",)), ("ADP", ("prep",)), ("CCONJ", ("konj", "samordnande")), ("SCONJ", ("subj", "underordnande")),
    ("PRON", ("pron",)), ("NUM", ("räkn", "räkneord")), ("ADV", ("adv",)), ("ADJ", ("adj", "adjektiv")), ("VERB", ("rxv", "ptv", "verb")), ("NOUN", ("subst", "substantiv")),
]
#: Marks that readings give for half and full boundaries of a word.
HALF_BOUNDARIES, FULL_BOUNDARIES, OTHER_BOUNDARIES = "¦ˈˌ•", "‖", "|·"
AFFIX_NOTES = ("slutled", "i sms. ", "i sms ")
# -------------------------------------------------------------------------------------


def class_head(c: Column | str) -> Column:
    """The head of a word-class field: what stands before any tag, in small letters; empty for null."""
    return fold(F.trim(F.split(F.coalesce(_c(c), F.lit("")), "<")[0]))


def classes_of_head(head: Column) -> Column:
    """Every class that a head names, in the order of CLASS_TOKENS; empty if none.

    Names count as whole tokens, so `adverbiellt` is no verb.
    """
    tokens = F.split(F.trim(head), r"\s+")
    follows = F.transform(tokens, lambda t, i: F.concat(t, F.lit(" "), F.coalesce(F.get(tokens, i + 1), F.lit(""))))
    names = []
    for cls, marks in CLASS_TOKENS.items():
        hit = F.arrays_overlap(tokens, F.array(*map(F.lit, marks))) if marks else F.lit(False)
        for pair in CLASS_PAIRS.get(cls, ()):
            hit = hit | F.array_contains(follows, " ".join(pair))
        if cls in CLASS_WORDS:
            hit = hit | head.rlike(rf"(?U)\b{CLASS_WORDS[cls]}\b")
        names.append(F.when(hit, cls))
    return F.array_compact(F.array(*names))


def classes_of_record(ordkl: Column | str, upos: Column | str) -> Column:
    """The classes of a record: those its head names, else its class code; empty without either."""
    named = classes_of_head(class_head(ordkl))
    code = F.upper(F.trim(F.coalesce(_c(upos), F.lit(""))))
    return F.when(F.size(named) > 0, named).when(code != "", F.array(code)).otherwise(F.array().cast("array<string>"))


def one_class(ordkl: Column | str, upos: Column | str) -> Column:
    """One class for a record: the first of CLASS_PARTS that its head contains, an abbreviation at its beginning, else its code."""
    head = class_head(ordkl)
    out = None
    for cls, parts in CLASS_PARTS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | head.contains(p)
        out = F.when(hit, cls) if out is None else out.when(hit, cls)
    return out.when(head.rlike(r"^s\.(\s|$)"), "NOUN").when(head.rlike(r"^v\.(\s|$)"), "VERB").otherwise(F.upper(F.trim(F.coalesce(_c(upos), F.lit("")))))


def is_affix(ordkl: Column | str, lemma: Column | str) -> Column:
    """Whether an entry is a part of words: a hyphen at an end, or a note in the class field."""
    head = F.concat(fold(F.trim(F.coalesce(_c(ordkl), F.lit("")))), F.lit(" "))
    noted = F.lit(False)
    for note in AFFIX_NOTES:
        noted = noted | head.contains(note)
    w = F.coalesce(_c(lemma), F.lit(""))
    return w.startswith("-") | w.endswith("-") | noted


def game_word(c: Column | str) -> Column:
    """A word composed and in small letters, if it is of two letters or more; else null."""
    w = fold(nfc(F.regexp_replace(_c(c), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")))
    return F.when(is_letters(w) & (F.length(w) > 1), w)


def normal_pattern(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """A notation without bracketed notes, white space collapsed and none before `;` and `,`; null texts as null. `aliases` rename whole patterns."""
    x = F.regexp_replace(_c(c), r"\[[^\]]*\]", " ")
    x = F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"\s+([;,])", "$1")
    for old, new in (aliases or {}).items():
        x = F.when(x == old, new).otherwise(x)
    return F.when(~is_null_text(c) & (x != ""), x)


def reading_key(c: Column | str) -> Column:
    """A text as it is compared with readings: one dash, no brackets, no boundary marks, small letters."""
    x = F.translate(_c(c), DASHES, "-" * len(DASHES))
    x = F.translate(F.regexp_replace(x, r"\[[^\]]*\]", " "), HALF_BOUNDARIES + FULL_BOUNDARIES + OTHER_BOUNDARIES, "")
    return F.trim(F.regexp_replace(fold(x), r"\s+", " "))


def structure_key(c: Column | str) -> Column:
    """The same with half boundaries as `·` and full ones as `|`."""
    x = F.translate(_c(c), DASHES, "-" * len(DASHES))
    x = F.translate(F.regexp_replace(x, r"\[[^\]]*\]", " "), HALF_BOUNDARIES + FULL_BOUNDARIES, "·" * len(HALF_BOUNDARIES) + "|")
    return F.trim(F.regexp_replace(fold(x), r"\s+", " "))


def emittable(c: Column | str) -> Column:
    """Whether a form may be given out: not empty, without blanks and hyphens at its ends; false for null."""
    w = F.trim(_c(c))
    return F.coalesce((w != "") & ~w.rlike(r"\s") & ~w.startswith("-") & ~w.endswith("-"), F.lit(False))


def simple_relative(c: Column | str) -> Column:
    """Whether a notation only adds to or replaces the end of one base, and adds at least once."""
    text = F.trim(F.coalesce(_c(c), F.lit("")))
    tokens = F.filter(F.split(F.translate(text, ";,", "  "), r"\s+"), lambda t: t != "")
    plain = ~is_null_text(text) & ~text.contains("_") & ~F.lower(text).contains("el.") & ~text.contains("[")
    relative = F.forall(tokens, lambda t: t.rlike(r"^(\+|[+-]\p{L}+|pl\.|best\.|sg\.)$"))
    return plain & relative & F.exists(tokens, lambda t: t.startswith("+"))


def part_of_words(form: Column | str, lemma: Column | str) -> Column:
    """Whether the words of a form stand side by side within a lemma of several words."""
    f, w = (F.filter(F.split(fold(F.trim(F.coalesce(_c(c), F.lit("")))), r"\s+"), lambda t: t != "") for c in (form, lemma))
    k = F.size(f)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
    return (F.size(w) > 1) & (k > 0) & (F.size(w) >= k) & F.exists(starts, lambda i: F.slice(w, i, k) == f)


def context_of_form(form: Column | str, lemma: Column | str) -> Column:
    """Why a form is known from its context only: empty, of several words, part of a lemma of several words; else `standalone`."""
    f = F.trim(F.coalesce(_c(form), F.lit("")))
    return F.when(f == "", "empty").when(f.rlike(r"\s"), "several_words").when(part_of_words(form, lemma), "part_of_lemma").otherwise("standalone")


def flags(*named: tuple[str, Column]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in named]))


def audit_flags(lemma: Column | str, upos: Column | str, longest: Column) -> Column:
    """What makes a record worth a look: its class X, capitals, hyphens or blanks in its lemma, a form of more than 45 characters."""
    w = F.coalesce(_c(lemma), F.lit(""))
    return flags(
        ("class_x", F.trim(F.coalesce(_c(upos), F.lit(""))) == "X"), ("capital", w.rlike(r"\p{Lu}")), ("hyphen", w.contains("-")), ("several_words", w.contains(" ")),
        ("long_form", F.coalesce(longest > 45, F.lit(False))),
    )


def verified_split(stycke: Column | str, lemma: Column | str) -> Column:
    """(prefix, head) of a marked headword at its last bar, if both parts give the lemma; else null."""
    s = _c(stycke)
    prefix, head = (F.translate(F.regexp_extract(s, r"^(.*)\|([^|]*)$", k), SOFT_MARKS, "") for k in (1, 2))
    fits = s.contains("|") & (prefix != "") & (head != "") & (comparison_key(F.concat(prefix, head)) == comparison_key(lemma))
    return F.when(fits, F.struct(prefix.alias("prefix"), head.alias("head")))


def restored_bar(form: Column | str, stycke: Column | str) -> Column:
    """A form with the bar of its marked headword put in again, where it begins with the part before the bar; else unchanged."""
    f, s = _c(form), _c(stycke)
    prefix = F.translate(F.regexp_extract(s, r"^(.*)\|", 1), SOFT_MARKS, "")
    starts = s.contains("|") & (prefix != "") & f.startswith(prefix) & (F.length(f) > F.length(prefix)) & ~f.contains("|")
    return F.when(starts, F.concat(prefix, F.lit("|"), F.substring(f, F.length(prefix) + 1, F.length(f)))).otherwise(f)


def description_parts(c: Column | str) -> Column:
    """(grammar, paradigm) of a form's description: its words, and those that are numbers of a paradigm such as `1:2-3`."""
    words = F.filter(F.split(F.trim(F.coalesce(_c(c), F.lit(""))), r"\s+"), lambda w: w != "")
    number = lambda w: w.rlike(r"^[1-9][0-9]*:[1-9][0-9]*-[1-9][0-9]*$")
    return F.struct(F.filter(words, lambda w: ~number(w)).alias("grammar"), F.filter(words, number).alias("paradigm"))


def known_error(keys: dict[str, str], lemma: Column | str, notation: Column | str, mark: str = "<k>") -> Column:
    """Whether a record has a signature known to be wrong: a listed lemma with its listed notation and the mark in it."""
    hit = F.lit(False)
    for w, text in keys.items():
        hit = hit | ((_c(lemma) == w) & (_c(notation) == text) & _c(notation).contains(mark))
    return F.coalesce(hit, F.lit(False))


def printed_variant(printed: Column | str, lemma: Column | str, notation: Column | str) -> Column:
    """The base that a notation is applied to: the printed word where it differs from the lemma but for boundary marks and the notation only changes one base; else the lemma."""
    p = F.nullif(F.trim(F.translate(_c(printed), SOFT_MARKS, "")), F.lit(""))
    return F.when(p.isNotNull() & (fold(p) != fold(_c(lemma))) & simple_relative(notation), p).otherwise(_c(lemma))
