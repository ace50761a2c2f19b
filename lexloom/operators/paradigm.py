"""Completion of interpreted paradigms: rules over the slots of a lexeme, evidence of its family, forms another source attests.

Slots are rows (id, slot, written_form). Rules read the slots of a lexeme together, so each
operator gathers them once by id, with the combining of collect_set before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------
#: Slots that the whole paradigm of a regular verb adds: slot, letters left out of the lemma, ending.
REGULAR_CORE = [("pres", 0, "r"), ("imper", 0, "")]
REGULAR_FULL = [
    ("inf_passive", 0, "s"), ("pres_passive", 0, "s"), ("pret_passive", 0, "des"), ("sup_passive", 1, "ats"), ("part_pres", 1, "ande"),
    ("part_perf_u", 1, "ad"), ("part_perf_n", 1, "at"), ("part_perf_pl", 0, "de"),
]
STEM_KEEPING = [("pres", 1, "er"), ("imper", 1, "")]
#: The notation that licenses the whole paradigm.
REGULAR_NOTATION = "+de +t"
ACTIVE_NAMES = {"inf": "inf_active", "pres": "pres_active", "pret": "pret_active", "sup": "sup_active"}
PARTICIPLE_SLOTS = ("part_perf_u", "part_perf_n", "part_perf_pl")
# -------------------------------------------------------------------------------------


def _gathered(forms: DataFrame, lexemes: DataFrame, id_col: str, slots: list[str]) -> DataFrame:
    """`lexemes` (id, lemma, ...) with an array of distinct forms for each of `slots`, empty where there are none."""
    by = forms.filter(F.col("slot").isin(*slots)).groupBy(id_col).agg(*[F.collect_set(F.when(F.col("slot") == s, F.col("written_form"))).alias(f"__{s}") for s in slots])
    none = F.array().cast("array<string>")
    return lexemes.join(by, id_col, "left").select(*lexemes.columns, *[F.coalesce(f"__{s}", none).alias(f"__{s}") for s in slots])


def _built(lemma: Column, parts: list[tuple[str, int, str]], rule: str) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("slot"), F.concat(F.substring(lemma, F.lit(1), F.length(lemma) - cut), F.lit(end)).alias("written_form"), F.lit(rule).alias("rule")) for s, cut, end in parts])


def expand_verbs(forms: DataFrame, lexemes: DataFrame, id_col: str, lemma: str, notation: str) -> DataFrame:
    """(id, slot, written_form, rule): forms that the slots of verbs license beyond those they have.

    A lemma in -a with a preterite in -ade and a supine in -at is regular: it gets a present and
    an imperative, and the whole paradigm where its notation is just REGULAR_NOTATION. A lemma
    in -a with one preterite, its stem and -de or -te, and one supine, its stem and -t, gets a
    present in -er and the stem as imperative, unless it has one of them. Null lemmas get none.
    """
    g = _gathered(forms, lexemes.select(id_col, F.col(lemma).alias("__lemma"), F.col(notation).alias("__notation")), id_col, ["pres", "pret", "sup", "imper"])
    w = F.col("__lemma")
    stem = F.substring(w, F.lit(1), F.length(w) - 1)
    regular = F.array_contains("__pret", F.concat(w, F.lit("de"))) & F.array_contains("__sup", F.concat(stem, F.lit("at")))
    keeps = (
        (F.size("__pres") == 0) & (F.size("__imper") == 0) & (F.size("__pret") == 1) & (F.size("__sup") == 1)
        & F.get("__pret", F.lit(0)).isin(F.concat(stem, F.lit("de")), F.concat(stem, F.lit("te"))) & (F.get("__sup", F.lit(0)) == F.concat(stem, F.lit("t")))
    )
    whole = F.trim("__notation") == REGULAR_NOTATION
    added = F.when(regular & whole, F.concat(_built(w, REGULAR_CORE, "regular"), _built(w, REGULAR_FULL, "regular"))).when(regular, _built(w, REGULAR_CORE, "regular")).when(keeps, _built(w, STEM_KEEPING, "stem_keeping"))
    new = g.filter(w.endswith("a")).select(id_col, F.explode(added).alias("x")).select(id_col, "x.*")
    return new.join(forms.select(id_col, "slot", "written_form"), [id_col, "slot", "written_form"], "left_anti")


def expand_adjectives(forms: DataFrame, id_col: str) -> DataFrame:
    """(id, slot, written_form): forms that the slots of adjectives license beyond those they have.

    A superlative in -ast has a definite in -aste; another in -st has one in -a and a masculine
    one in -e. An adjective with a neuter has a masculine in -e for each plural in -a.
    """
    f = F.col("written_form")
    ast, st = f.endswith("ast"), f.endswith("st")
    one = lambda slot, form: F.struct(F.lit(slot).alias("slot"), form.alias("written_form"))
    top = F.when(ast, F.array(one("superl_def", F.concat(f, F.lit("e"))))).when(st, F.array(one("superl_def", F.concat(f, F.lit("a"))), one("superl_masc", F.concat(f, F.lit("e")))))
    masculine = F.array(one("masc", F.concat(F.substring(f, F.lit(1), F.length(f) - 1), F.lit("e"))))
    neuter = forms.filter((F.col("slot") == "pos_n") & f.isNotNull()).select(id_col).distinct()
    plural = forms.filter((F.col("slot") == "pos_pl") & f.endswith("a")).join(neuter, id_col, "left_semi").select(id_col, F.explode(masculine).alias("x"))
    new = forms.filter(F.col("slot") == "superl").select(id_col, F.explode(top).alias("x")).unionByName(plural).select(id_col, "x.*").distinct()
    return new.join(forms.select(id_col, "slot", "written_form"), [id_col, "slot", "written_form"], "left_anti")


def active_names(forms: DataFrame, id_col: str) -> DataFrame:
    """(id, slot, written_form, source) of the active verb slots under their precise names."""
    precise = F.create_map(*[F.lit(x) for kv in ACTIVE_NAMES.items() for x in kv])[F.col("slot")]
    return forms.filter(precise.isNotNull() & F.col("written_form").isNotNull()).select(id_col, precise.alias("slot"), "written_form", F.concat(F.lit("active:"), "slot").alias("source")).distinct()


def participle_tokens(notation: Column) -> Column:
    """The three participle forms of a verb's notation: the third group between commas, ended by a comma before `pres.`; else null."""
    before = F.rtrim(F.regexp_extract(notation, r"^(.*?)\bpres\.", 1))
    groups = F.filter(F.transform(F.split(before, ","), lambda g: F.trim(F.regexp_replace(g, r"^[ ;:]+|[ ;:]+$", ""))), lambda g: g != "")
    tokens = F.split(F.get(groups, F.lit(2)), r"\s+")
    plain = F.forall(tokens, lambda t: t.rlike(r"^[+-]?\p{L}+$"))
    ended = F.rlike(before, F.lit(r",[ ;:]*$"))
    return F.when(notation.rlike(r"\bpres\.") & ended & (F.size(groups) >= 3) & (F.size(tokens) == 3) & plain, tokens)


def family_forms(forms: DataFrame, lexemes: DataFrame, id_col: str, lemma: str, family: str) -> DataFrame:
    """(id, slot, written_form): slots that a lexeme lacks and all of its family form alike.

    What a form adds to its lemma is its ending. A slot of a family (a column of `lexemes`)
    whose members that have it all have the same set of endings lends it to those that lack
    it; where they differ nothing is lent. Forms that don't begin with their lemma, null
    lemmas and null families take no part.
    """
    lex = lexemes.select(id_col, F.col(lemma).alias("__lemma"), F.col(family).alias("__family")).filter("__lemma <> '' and __family is not null")
    endings = forms.select(id_col, "slot", "written_form").join(lex, id_col).filter(F.col("written_form").startswith(F.col("__lemma")))
    endings = endings.select(id_col, "slot", "__family", F.expr("substr(written_form, length(__lemma) + 1)").alias("__end"))
    own = endings.groupBy(id_col, "slot", "__family").agg(F.array_sort(F.collect_set("__end")).alias("__ends"))
    # agreement is told by the least and the greatest set, so no family meets in one task
    agreed = own.groupBy("__family", "slot").agg(F.min("__ends").alias("__ends"), F.max("__ends").alias("__most")).filter("__ends = __most").drop("__most")
    lacking = lex.join(agreed, "__family").join(forms.filter("written_form is not null").select(id_col, "slot").distinct(), [id_col, "slot"], "left_anti")
    return lacking.select(id_col, "slot", F.explode("__ends").alias("__end"), "__lemma").select(id_col, "slot", F.concat("__lemma", "__end").alias("written_form"))


def attested_forms(forms: DataFrame, lexemes: DataFrame, id_col: str, lemma: str, entries: DataFrame) -> DataFrame:
    """(id, written_form, support): forms of entries (entry_id, lemma, form) of a lexeme's lemma that it lacks, with the entries that attest them.

    Empty forms and parts of words (with a hyphen at the end) don't count.
    """
    usable = entries.select("entry_id", F.trim("lemma").alias("__lemma"), F.trim("form").alias("written_form")).filter("written_form <> '' and not endswith(written_form, '-')").distinct()
    support = usable.groupBy("__lemma", "written_form").agg(F.array_join(F.array_sort(F.collect_set("entry_id")), ",").alias("support"))
    asked = lexemes.select(id_col, F.trim(lemma).alias("__lemma"))
    return asked.join(support, "__lemma").select(id_col, "written_form", "support").join(forms.select(id_col, "written_form"), [id_col, "written_form"], "left_anti")
