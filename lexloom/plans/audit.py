"""Queries of word classes, paradigms and evidence over the lexical tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical as L
from .. import sources
from ..operators import evidence, notation, ocr, ordered, paradigm, raster, relational
from ..sources import lexicon
from ..tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _forms(spark, sf) -> DataFrame:
    return table(spark, sf, "slot_forms").filter("written_form is not null").select("lexeme_id", "slot", "written_form").distinct()


def _lexemes(spark, sf) -> DataFrame:
    return table(spark, sf, "lexeme_slots")


_CLS = "CASE upper(upos) WHEN 'NN' THEN 'NOUN' WHEN 'AV' THEN 'ADJ' WHEN 'VB' THEN 'VERB' ELSE upper(upos) END"


def _cls():
    u = F.upper("upos")
    return F.when(u == "NN", "NOUN").when(u == "AV", "ADJ").when(u == "VB", "VERB").otherwise(u)


def _entries(spark, sf) -> DataFrame:
    return table(spark, sf, "saldo_analyses").withColumn("cls", _cls())


def _entry_forms(spark, sf) -> DataFrame:
    e = _entries(spark, sf).select("entry_id", "cls", "lemmas", F.explode("word_forms").alias("f"))
    return e.select("entry_id", "cls", "lemmas", F.col("f.form").alias("form")).filter("form is not null")


# ---- word classes and keys ---------------------------------------------------------------

# the class field of the source: a head, as the class codes of the table stand for it
_HEAD = "CASE WHEN upos = 'X' THEN 'Adv. och adj. <i>+t</i>' WHEN upper(upos) = 'NOUN' THEN 's.' WHEN upper(upos) = 'ADJ' THEN 'adj.' WHEN upper(upos) = 'VERB' THEN 'v. adverbiellt' END"
_HEADS = f"(SELECT *, {_HEAD} AS ordkl, lower(trim(split_part(coalesce({_HEAD}, ''), '<', 1))) AS head FROM lexeme_slots)"
_NAMED = """list_filter([CASE WHEN regexp_matches(head, '(^|\\s)(subst\\.|substantiv|s\\.)(\\s|$)') THEN 'NOUN' END, CASE WHEN regexp_matches(head, '(^|\\s)(verb|v\\.|rxv|ptv)(\\s|$)') THEN 'VERB' END,
 CASE WHEN regexp_matches(head, '(^|\\s)(adj\\.|adjektiv)(\\s|$)') THEN 'ADJ' END, CASE WHEN regexp_matches(head, '(^|\\s)adv\\.(\\s|$)') OR regexp_matches(head, '\\badverbiellt\\b') THEN 'ADV' END], lambda x: x IS NOT NULL)"""


@_query(f"""
WITH c AS (SELECT lexeme_id, notation, CASE WHEN len({_NAMED}) > 0 THEN {_NAMED} WHEN coalesce(trim(upos), '') <> '' THEN [upper(trim(upos))] ELSE [] END AS classes FROM {_HEADS})
SELECT lexeme_id, cls, CASE WHEN cls = 'ADV' AND list_contains(classes, 'ADJ') THEN NULL ELSE notation END AS notation FROM (SELECT lexeme_id, notation, classes, unnest(classes) AS cls FROM c)""")
def class_views(spark, sf):
    """One view of each lexeme for each class that its head names; the adverb of an adjective has no notation."""
    d = _lexemes(spark, sf).withColumn("ordkl", F.expr(_HEAD)).withColumn("classes", L.classes_of_record("ordkl", "upos"))
    bare = (F.col("cls") == "ADV") & F.array_contains("classes", "ADJ")
    return d.select("lexeme_id", "notation", "classes", F.explode("classes").alias("cls")).select("lexeme_id", "cls", F.when(~bare, F.col("notation")).alias("notation"))


@_query(f"""
SELECT cls, count(*) AS n FROM (SELECT CASE WHEN contains(head, 'adv') THEN 'ADV' WHEN contains(head, 'adj') THEN 'ADJ' WHEN contains(head, 'verb') THEN 'VERB' WHEN regexp_matches(head, '^s\\.(\\s|$)') THEN 'NOUN'
 WHEN regexp_matches(head, '^v\\.(\\s|$)') THEN 'VERB' ELSE upper(trim(coalesce(upos, ''))) END AS cls FROM {_HEADS}) GROUP BY 1""")
def one_class_counts(spark, sf):
    """How many lexemes have each class, by the rules in order."""
    return _lexemes(spark, sf).select(L.one_class(F.expr(_HEAD), "upos").alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT row_id, starts_with(written_form, '-') OR ends_with(written_form, '-') AS affix, trim(written_form) <> '' AND NOT regexp_matches(trim(written_form), '[ \\t\\n\\x0B\\f\\r]') AND NOT starts_with(trim(written_form), '-') AND NOT ends_with(trim(written_form), '-') AS emitted FROM generated_word_forms WHERE written_form IS NOT NULL")
def emit_guard(spark, sf):
    """Which generated forms are parts of words, and which may be given out."""
    g = table(spark, sf, "generated_word_forms").filter("written_form is not null")
    return g.select("row_id", L.is_affix(F.lit(None).cast("string"), "written_form").alias("affix"), L.emittable("written_form").alias("emitted"))


_PATTERN = "regexp_replace(trim(regexp_replace(regexp_replace(notation, '\\[[^\\]]*\\]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+([;,])', '\\1', 'g')"


@_query(f"SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN trim(notation) IN ('', '(null)', 'null') THEN NULL WHEN {_PATTERN} = '+en +er' THEN '+en, +er' ELSE nullif({_PATTERN}, '') END AS pattern FROM lexeme_slots) GROUP BY 1")
def pattern_counts(spark, sf):
    """How often each normalised notation occurs."""
    return _lexemes(spark, sf).select(L.normal_pattern("notation", {"+en +er": "+en, +er"}).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT lexeme_id, trim(coalesce(notation, '')) NOT IN ('', '(null)', 'null') AND NOT contains(notation, '_') AND NOT contains(lower(notation), 'el.') AND NOT contains(notation, '[')
 AND len(list_filter(t, lambda x: NOT regexp_matches(x, '^(\\+|[+-]\\p{L}+|pl\\.|best\\.|sg\\.)$'))) = 0 AND len(list_filter(t, lambda x: starts_with(x, '+'))) > 0 AS simple,
 coalesce(length(notation) = 50, FALSE) AS at_limit
FROM (SELECT lexeme_id, notation, list_filter(string_split_regex(translate(trim(coalesce(notation, '')), ';,', '  '), '\\s+'), lambda x: x <> '') AS t FROM lexeme_slots)""")
def notation_shapes(spark, sf):
    """Notations that only change one base, and those as long as the field's limit."""
    at_limit = F.coalesce(F.length("notation") == 50, F.lit(False))
    return _lexemes(spark, sf).select("lexeme_id", L.simple_relative("notation").alias("simple"), at_limit.alias("at_limit"))


@_query("""
WITH p AS (SELECT s.slot_form_id, trim(s.written_form) AS f, string_split_regex(lower(trim(s.written_form)), '\\s+') AS fw, string_split_regex(lower(trim(l.lemma)), '\\s+') AS lw FROM slot_forms s JOIN lexeme_slots l USING (lexeme_id) WHERE s.written_form IS NOT NULL)
SELECT slot_form_id, CASE WHEN f = '' THEN 'empty' WHEN regexp_matches(f, '[ \\t\\n\\x0B\\f\\r]') THEN 'several_words' WHEN len(lw) > 1 AND len(list_filter(range(1, CAST(greatest(len(lw) - len(fw) + 2, 1) AS BIGINT)), lambda i: lw[i:i + len(fw) - 1] = fw)) > 0 THEN 'part_of_lemma' ELSE 'standalone' END AS context FROM p""")
def form_contexts(spark, sf):
    """Whether a form stands alone, or is a part of its lemma of several words."""
    s = table(spark, sf, "slot_forms").filter("written_form is not null").join(_lexemes(spark, sf).select("lexeme_id", "lemma"), "lexeme_id")
    return s.select("slot_form_id", L.context_of_form("written_form", "lemma").alias("context"))


@_query("""
WITH m AS (SELECT lexeme_id, max(length(written_form)) AS longest FROM slot_forms GROUP BY 1)
SELECT lexeme_id, array_to_string(list_filter([CASE WHEN trim(upos) = 'X' THEN 'class_x' END, CASE WHEN regexp_matches(lemma, '\\p{Lu}') THEN 'capital' END, CASE WHEN contains(lemma, '-') THEN 'hyphen' END,
 CASE WHEN contains(lemma, ' ') THEN 'several_words' END, CASE WHEN longest > 45 THEN 'long_form' END], lambda x: x IS NOT NULL), '|') AS flags FROM lexeme_slots LEFT JOIN m USING (lexeme_id)""")
def record_flags(spark, sf):
    """What makes a lexeme worth a look."""
    longest = table(spark, sf, "slot_forms").groupBy("lexeme_id").agg(F.max(F.length("written_form")).alias("longest"))
    d = _lexemes(spark, sf).join(longest, "lexeme_id", "left")
    return d.select("lexeme_id", F.array_join(L.audit_flags("lemma", "upos", F.col("longest")), "|").alias("flags"))


_READ = "regexp_replace(translate(text, '‐‑‒–—−', '------'), '\\[[^\\]]*\\]', ' ', 'g')"


@_query(f"""
SELECT word_id, trim(regexp_replace(replace(lower(translate({_READ}, '¦ˈˌ•‖|·', '')), 'ß', 'ss'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS key,
 trim(regexp_replace(replace(lower(translate({_READ}, '¦ˈˌ•‖', '····|')), 'ß', 'ss'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS structure FROM ocr_words WHERE level = '5'""")
def reading_keys(spark, sf):
    """How words of readings are compared, without and with boundaries."""
    return table(spark, sf, "ocr_words").filter("level = '5'").select("word_id", L.reading_key("text").alias("key"), L.structure_key("text").alias("structure"))


_CLEAN = "trim(regexp_replace(translate({}, '­·|', ''), '\\s+', ' ', 'g'))"


@_query(f"""
WITH s AS (SELECT lexeme_id, lemma, stycke, translate(regexp_extract(stycke, '^(.*)\\|([^|]*)$', 1), '­·|', '') AS p, translate(regexp_extract(stycke, '^(.*)\\|([^|]*)$', 2), '­·|', '') AS h FROM lexeme_slots),
v AS (SELECT *, contains(stycke, '|') AND p <> '' AND h <> '' AND lower({_CLEAN.format("p || h")}) = lower({_CLEAN.format("lemma")}) AS ok FROM s)
SELECT slot_form_id, CASE WHEN ok THEN p END AS prefix, CASE WHEN ok THEN h END AS head,
 CASE WHEN contains(stycke, '|') AND p <> '' AND starts_with(written_form, p) AND length(written_form) > length(p) AND NOT contains(written_form, '|') THEN p || '|' || substr(written_form, length(p) + 1) ELSE written_form END AS barred
FROM v JOIN slot_forms USING (lexeme_id)""")
def marked_parts(spark, sf):
    """The parts of marked lemmas that give the lemma, and forms with the bar put in again."""
    l = _lexemes(spark, sf).select("lexeme_id", "stycke", L.verified_split("stycke", "lemma").alias("parts"))
    s = table(spark, sf, "slot_forms").join(l, "lexeme_id")
    return s.select("slot_form_id", "parts.prefix", "parts.head", L.restored_bar("written_form", "stycke").alias("barred"))


@_query("SELECT word, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(w, '\\p{L}+') AND length(w) > 1 THEN w END AS word FROM (SELECT replace(lower(nfc_normalize(regexp_replace(written_form, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))), 'ß', 'ss') AS w FROM generated_word_forms)) GROUP BY 1")
def game_words(spark, sf):
    """Forms as words of letters, with how often each occurs; null for those that aren't."""
    return table(spark, sf, "generated_word_forms").select(L.game_word("written_form").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# ---- paradigms -----------------------------------------------------------------------------

_SETS = "(SELECT lexeme_id, list(DISTINCT written_form) FILTER (slot = 'pres') AS pres, list(DISTINCT written_form) FILTER (slot = 'pret') AS pret, list(DISTINCT written_form) FILTER (slot = 'sup') AS sup, list(DISTINCT written_form) FILTER (slot = 'imper') AS imper FROM slot_forms WHERE written_form IS NOT NULL GROUP BY 1)"
_STRUCTS = lambda parts, rule: "[" + ", ".join(f"{{'slot': '{s}', 'written_form': substr(lemma, 1, length(lemma) - {k}) || '{e}', 'rule': '{rule}'}}" for s, k, e in parts) + "]"


@_query(f"""
WITH v AS (SELECT lexeme_id, lemma, notation, substr(lemma, 1, length(lemma) - 1) AS stem, coalesce(pres, []) AS pres, coalesce(pret, []) AS pret, coalesce(sup, []) AS sup, coalesce(imper, []) AS imper FROM lexeme_slots LEFT JOIN {_SETS} USING (lexeme_id) WHERE upper(upos) = 'VERB' AND ends_with(lemma, 'a')),
x AS (SELECT lexeme_id, unnest(CASE WHEN list_contains(pret, lemma || 'de') AND list_contains(sup, stem || 'at') THEN CASE WHEN trim(notation) = '{paradigm.REGULAR_NOTATION}' THEN {_STRUCTS(paradigm.REGULAR_CORE + paradigm.REGULAR_FULL, 'regular')} ELSE {_STRUCTS(paradigm.REGULAR_CORE, 'regular')} END
 WHEN len(pres) = 0 AND len(imper) = 0 AND len(pret) = 1 AND len(sup) = 1 AND pret[1] IN (stem || 'de', stem || 'te') AND sup[1] = stem || 't' THEN {_STRUCTS(paradigm.STEM_KEEPING, 'stem_keeping')} END) AS x FROM v)
SELECT lexeme_id, x.slot AS slot, x.written_form AS written_form, x.rule AS rule FROM x WHERE NOT EXISTS (SELECT 1 FROM slot_forms s WHERE s.lexeme_id = x.lexeme_id AND s.slot = x.x.slot AND s.written_form = x.x.written_form)""")
def verb_expansion(spark, sf):
    """Forms that the slots of verbs license beyond those they have."""
    verbs = _lexemes(spark, sf).filter(F.upper("upos") == "VERB")
    return paradigm.expand_verbs(_forms(spark, sf), verbs, "lexeme_id", "lemma", "notation")


@_query("""
WITH f AS (SELECT DISTINCT lexeme_id, slot, written_form FROM slot_forms WHERE written_form IS NOT NULL),
x AS (SELECT lexeme_id, 'superl_def' AS slot, written_form || 'e' AS w FROM f WHERE slot = 'superl' AND ends_with(written_form, 'ast')
 UNION SELECT lexeme_id, 'superl_def', written_form || 'a' FROM f WHERE slot = 'superl' AND ends_with(written_form, 'st') AND NOT ends_with(written_form, 'ast')
 UNION SELECT lexeme_id, 'superl_masc', written_form || 'e' FROM f WHERE slot = 'superl' AND ends_with(written_form, 'st') AND NOT ends_with(written_form, 'ast')
 UNION SELECT lexeme_id, 'masc', substr(written_form, 1, length(written_form) - 1) || 'e' FROM f WHERE slot = 'pos_pl' AND ends_with(written_form, 'a') AND lexeme_id IN (SELECT lexeme_id FROM f WHERE slot = 'pos_n'))
SELECT lexeme_id, slot, w AS written_form FROM x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lexeme_id = x.lexeme_id AND f.slot = x.slot AND f.written_form = x.w)""")
def adjective_expansion(spark, sf):
    """Forms that the slots of adjectives license beyond those they have."""
    return paradigm.expand_adjectives(_forms(spark, sf), "lexeme_id")


@_query("SELECT DISTINCT lexeme_id, slot || '_active' AS slot, written_form, 'active:' || slot AS source FROM slot_forms WHERE slot IN ('inf', 'pres', 'pret', 'sup') AND written_form IS NOT NULL")
def active_slot_names(spark, sf):
    """The active verb slots under their precise names."""
    return paradigm.active_names(_forms(spark, sf), "lexeme_id")


@_query("""
WITH b AS (SELECT lexeme_id, rtrim(regexp_extract(notation, '^(.*?)\\bpres\\.', 1)) AS b FROM lexeme_slots WHERE regexp_matches(notation, '\\bpres\\.')),
g AS (SELECT lexeme_id, b, list_filter(list_transform(string_split(b, ','), lambda x: trim(regexp_replace(x, '^[ ;:]+|[ ;:]+$', '', 'g'))), lambda y: y <> '') AS g FROM b),
t AS (SELECT lexeme_id, b, len(g) AS k, string_split_regex(g[3], '\\s+') AS t FROM g)
SELECT lexeme_id, array_to_string(t, ' ') AS tokens FROM t WHERE regexp_matches(b, ',[ ;:]*$') AND k >= 3 AND len(t) = 3 AND len(list_filter(t, lambda x: NOT regexp_matches(x, '^[+-]?\\p{L}+$'))) = 0""")
def participle_groups(spark, sf):
    """The participle forms that a notation gives in its third group."""
    return _lexemes(spark, sf).select("lexeme_id", F.array_join(paradigm.participle_tokens(F.col("notation")), " ").alias("tokens")).filter("tokens is not null")


@_query("""
WITH f AS (SELECT DISTINCT lexeme_id, slot, written_form FROM slot_forms WHERE written_form IS NOT NULL), l AS (SELECT lexeme_id, lemma, head_id FROM lexeme_slots WHERE lemma <> '' AND head_id IS NOT NULL),
o AS (SELECT lexeme_id, slot, head_id, list_sort(list(DISTINCT substr(written_form, length(lemma) + 1))) AS e FROM f JOIN l USING (lexeme_id) WHERE starts_with(written_form, lemma) GROUP BY 1, 2, 3),
a AS (SELECT head_id, slot, min(e) AS e FROM o GROUP BY 1, 2 HAVING count(DISTINCT e) = 1)
SELECT lexeme_id, slot, lemma || e AS written_form FROM (SELECT lexeme_id, slot, lemma, unnest(e) AS e FROM l JOIN a USING (head_id) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lexeme_id = l.lexeme_id AND f.slot = a.slot))""")
def family_borrowing(spark, sf):
    """Slots that lexemes lack and all of their head's family form alike."""
    return paradigm.family_forms(_forms(spark, sf), _lexemes(spark, sf), "lexeme_id", "lemma", "head_id")


@_query(f"""
WITH e AS (SELECT DISTINCT entry_id, trim(lemma) AS lemma, trim(form) AS form FROM (SELECT entry_id, unnest(lemmas) AS lemma, f FROM (SELECT entry_id, lemmas, unnest(list_transform(word_forms, lambda x: x.form)) AS f FROM saldo_analyses WHERE {_CLS} = 'VERB')) t(entry_id, lemma, form) WHERE trim(form) <> '' AND NOT ends_with(trim(form), '-')),
u AS (SELECT lemma, form, string_agg(DISTINCT entry_id, ',' ORDER BY entry_id) AS support FROM e GROUP BY 1, 2)
SELECT l.lexeme_id, u.form AS written_form, u.support FROM lexeme_slots l JOIN u ON u.lemma = trim(l.lemma) WHERE upper(l.upos) = 'VERB' AND NOT EXISTS (SELECT 1 FROM slot_forms s WHERE s.lexeme_id = l.lexeme_id AND s.written_form = u.form)""")
def attested_verb_forms(spark, sf):
    """Forms of verbs that only the other lexicon attests, with its entries."""
    verbs = _lexemes(spark, sf).filter(F.upper("upos") == "VERB")
    e = _entry_forms(spark, sf).filter("cls = 'VERB'").select("entry_id", F.explode("lemmas").alias("lemma"), "form")
    return paradigm.attested_forms(_forms(spark, sf), verbs, "lexeme_id", "lemma", e)


_TAIL = "list_max(list_transform(range(0, greatest(length(lemma), 1)), lambda i: {'s': len(list_filter(range(1, least(length(lemma) - i, length(tail)) + 1), lambda k: substr(lower(lemma), i + 1, k) = left(lower(tail), k))), 'a': -i}))"


@_query(f"""
WITH d AS (SELECT s.slot_form_id, s.written_form, s.source, l.lemma, CASE WHEN contains(stycke, '|') THEN translate(regexp_extract(stycke, '^(.*)\\|', 1), '|·', '') END AS bar, substr(s.source, 2) AS tail FROM slot_forms s JOIN lexeme_slots l USING (lexeme_id) WHERE s.source <> ''),
b AS (SELECT *, CASE WHEN starts_with(source, '-') THEN {_TAIL} END AS best FROM d),
f AS (SELECT slot_form_id, written_form, CASE WHEN source = '+' THEN lemma WHEN starts_with(source, '+') THEN lemma || regexp_replace(tail, '^-', '') WHEN starts_with(source, '-') THEN CASE WHEN tail = '' THEN source WHEN best.s >= 2 THEN left(lemma, -best.a) || tail WHEN starts_with(lower(lemma), lower(bar)) THEN bar || tail END ELSE source END AS built FROM b)
SELECT slot_form_id, built, coalesce(built = written_form, FALSE) AS same FROM f""")
def token_replay(spark, sf):
    """What the token of each form makes of its lemma, and whether that is the form."""
    s = table(spark, sf, "slot_forms").filter("source <> ''").join(_lexemes(spark, sf).select("lexeme_id", "lemma", "stycke"), "lexeme_id")
    built = notation.replayed_form(F.col("lemma"), F.col("source"), notation.bar_prefix(F.col("stycke")))
    return s.select("slot_form_id", "written_form", built.alias("built")).select("slot_form_id", "built", F.coalesce(F.col("built") == F.col("written_form"), F.lit(False)).alias("same"))


@_query("""
SELECT lexeme_id, regexp_replace(lemma, '^(\\S+)', '\\1s') AS first_word, lemma || 's' AS last_word, CASE WHEN regexp_matches(lemma, '^\\S{2,}a(\\s|$)') THEN regexp_replace(lemma, '^(\\S+)a(\\s.*)?$', '\\1\\2') ELSE lemma END AS imperative
FROM lexeme_slots WHERE regexp_matches(lemma, '^[^\\s].*[^\\s-]$')""")
def carrier_words(spark, sf):
    """Lemmas with an ending at their first and at their last word, and with their first word as an imperative."""
    d = _lexemes(spark, sf).filter(F.col("lemma").rlike(r"^[^\s].*[^\s-]$"))
    s = lambda w: F.concat(w, F.lit("s"))
    w = F.col("lemma")
    return d.select("lexeme_id", notation.on_word(w, "first", s).alias("first_word"), notation.on_word(w, "last", s).alias("last_word"), notation.imperative(w).alias("imperative"))


@_query("""
SELECT array_to_string(list_filter(w, lambda x: NOT regexp_matches(x, '^[1-9][0-9]*:[1-9][0-9]*-[1-9][0-9]*$')), ' ') AS grammar, array_to_string(list_filter(w, lambda x: regexp_matches(x, '^[1-9][0-9]*:[1-9][0-9]*-[1-9][0-9]*$')), ' ') AS paradigm, count(*) AS n
FROM (SELECT list_filter(string_split_regex(trim(coalesce(msd, '')), '\\s+'), lambda x: x <> '') AS w FROM generated_word_forms) GROUP BY 1, 2""")
def description_parts(spark, sf):
    """The grammatical and the paradigm part of descriptions, with their number."""
    p = table(spark, sf, "generated_word_forms").select(L.description_parts("msd").alias("p"))
    return p.groupBy(F.array_join("p.grammar", " ").alias("grammar"), F.array_join("p.paradigm", " ").alias("paradigm")).agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT lexeme_id, CASE WHEN p IS NOT NULL AND lower(p) <> lower(lemma) AND simple THEN p ELSE lemma END AS base FROM (SELECT lexeme_id, lemma, nullif(trim(translate(stycke, '­·|', '')), '') AS p,
 trim(coalesce(notation, '')) NOT IN ('', '(null)', 'null') AND NOT contains(notation, '_') AND NOT contains(lower(notation), 'el.') AND NOT contains(notation, '[') AND len(list_filter(t, lambda x: NOT regexp_matches(x, '^(\\+|[+-]\\p{L}+|pl\\.|best\\.|sg\\.)$'))) = 0 AND len(list_filter(t, lambda x: starts_with(x, '+'))) > 0 AS simple
 FROM (SELECT *, list_filter(string_split_regex(translate(trim(coalesce(notation, '')), ';,', '  '), '\\s+'), lambda x: x <> '') AS t FROM lexeme_slots))""")
def printed_bases(spark, sf):
    """What the notation of each lexeme is applied to: the printed word where it is another, else the lemma."""
    return _lexemes(spark, sf).select("lexeme_id", L.printed_variant("stycke", "lemma", "notation").alias("base"))


# ---- matches and evidence ------------------------------------------------------------------

_E = f"(SELECT entry_id, {_CLS} AS cls, lemmas, word_forms FROM saldo_analyses)"


@_query(f"""
WITH l AS (SELECT lexeme_id, lower(lemma) AS lemma, upper(upos) AS cls FROM lexeme_slots), el AS (SELECT entry_id, cls, lower(lemma) AS lemma FROM (SELECT entry_id, cls, unnest(lemmas) AS lemma FROM {_E}) WHERE lemma IS NOT NULL),
ef AS (SELECT entry_id, cls, lower(form) AS form FROM (SELECT entry_id, cls, unnest(list_transform(word_forms, lambda x: x.form)) AS form FROM {_E}) WHERE form IS NOT NULL),
one AS (SELECT lemma FROM el GROUP BY 1 HAVING count(DISTINCT coalesce(cls, '')) = 1),
k1 AS (SELECT cls, lemma, count(DISTINCT entry_id) AS m, min(entry_id) AS v FROM el WHERE cls IS NOT NULL GROUP BY 1, 2), k2 AS (SELECT lemma, count(DISTINCT entry_id) AS m, min(entry_id) AS v FROM el WHERE cls IS NULL GROUP BY 1 HAVING count(DISTINCT entry_id) = 1),
k3 AS (SELECT lemma, count(DISTINCT entry_id) AS m, min(entry_id) AS v FROM el JOIN one USING (lemma) WHERE cls IS NOT NULL GROUP BY 1), k4 AS (SELECT cls, form, count(DISTINCT entry_id) AS m, min(entry_id) AS v FROM ef WHERE cls IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT entry_id) = 1),
h AS (SELECT lexeme_id, 0 AS p, 'same_class' AS level, v, m FROM l JOIN k1 USING (cls, lemma) UNION ALL SELECT lexeme_id, 1, 'unknown_class', v, m FROM l JOIN k2 USING (lemma)
 UNION ALL SELECT lexeme_id, 2, 'inferred_class', v, m FROM l JOIN k3 USING (lemma) WHERE coalesce(l.cls, 'X') = 'X' UNION ALL SELECT lexeme_id, 3, 'form', v, m FROM l JOIN k4 ON k4.cls = l.cls AND k4.form = l.lemma)
SELECT lexeme_id, level, CASE WHEN m = 1 THEN v END AS value, m AS matches FROM h QUALIFY row_number() OVER (PARTITION BY lexeme_id ORDER BY p) = 1""")
def match_ladder(spark, sf):
    """Lexemes and entries: of the same class, the only one without class, the only class of a lemma, the only one with the form."""
    lex = _lexemes(spark, sf).select("lexeme_id", F.lower("lemma").alias("lemma"), F.upper("upos").alias("cls"))
    lemmas = _entries(spark, sf).select("entry_id", "cls", F.explode(F.transform("lemmas", F.lower)).alias("lemma")).filter("lemma is not null")
    one = lemmas.groupBy("lemma").agg(F.count_distinct(F.coalesce("cls", F.lit(""))).alias("k")).filter("k = 1").select("lemma", F.lit(True).alias("one"))
    none = F.lit(None).cast("string")
    key = F.concat("cls", F.lit("/"), "lemma")
    right = lemmas.join(one, "lemma", "left").select(
        "entry_id", key.alias("k1"), F.when(F.col("cls").isNull(), F.col("lemma")).alias("k2"), F.when(F.col("one") & F.col("cls").isNotNull(), F.col("lemma")).alias("k3"), none.alias("k4")
    )
    forms = _entry_forms(spark, sf).select("entry_id", none.alias("k1"), none.alias("k2"), none.alias("k3"), F.concat("cls", F.lit("/"), F.lower("form")).alias("k4"))
    unclassed = F.when(F.coalesce("cls", F.lit("X")) == "X", F.col("lemma"))
    levels = [("same_class", key, F.col("k1"), False), ("unknown_class", F.col("lemma"), F.col("k2"), True), ("inferred_class", unclassed, F.col("k3"), False), ("form", key, F.col("k4"), True)]
    return evidence.unique_ladder(lex, right.unionByName(forms), "lexeme_id", "entry_id", levels)


@_query(f"""
SELECT form, count(DISTINCT entry_id) AS entries FROM (SELECT entry_id, lower(unnest(lemmas)) AS form FROM {_E} UNION ALL SELECT entry_id, lower(unnest(list_transform(word_forms, lambda x: x.form))) FROM {_E}) WHERE form <> '' AND NOT ends_with(form, '-') GROUP BY 1""")
def form_index(spark, sf):
    """Every lemma and form of the other lexicon with the number of its entries."""
    e = _entries(spark, sf)
    both = e.select("entry_id", F.explode("lemmas").alias("form")).unionByName(_entry_forms(spark, sf).select("entry_id", "form"))
    return both.select("entry_id", F.lower("form").alias("form")).filter("form <> '' and not endswith(form, '-')").groupBy("form").agg(F.count_distinct("entry_id").alias("entries"))


@_query(f"""
WITH v AS (SELECT lexeme_id, provenance, list(DISTINCT written_form) AS f FROM slot_forms WHERE written_form IS NOT NULL GROUP BY 1, 2), e AS (SELECT entry_id, unnest(list_distinct(lemmas)) AS lemma, list_transform(word_forms, lambda x: x.form) AS g FROM {_E}),
m AS (SELECT lexeme_id, provenance, entry_id FROM v JOIN lexeme_slots l USING (lexeme_id) JOIN e ON e.lemma = l.lemma WHERE list_has_all(g, f))
SELECT lexeme_id, entry_id, string_agg(DISTINCT provenance, '|' ORDER BY provenance) AS variants FROM m GROUP BY 1, 2""")
def variant_matches(spark, sf):
    """Entries that have all forms of a variant of a lexeme (its forms of one provenance), with the variants."""
    v = table(spark, sf, "slot_forms").filter("written_form is not null").groupBy("lexeme_id", "provenance").agg(F.collect_set("written_form").alias("f"))
    lex = _lexemes(spark, sf).select("lexeme_id", "lemma")
    e = _entries(spark, sf).select("entry_id", F.explode(F.array_distinct("lemmas")).alias("lemma"), F.array_compact(F.transform("word_forms", lambda x: x["form"])).alias("g"))
    hit = v.join(lex, "lexeme_id").join(e, "lemma").filter(F.size(F.array_except("f", "g")) == 0)
    return hit.groupBy("lexeme_id", "entry_id").agg(F.array_join(F.array_sort(F.collect_set("provenance")), "|").alias("variants"))


@_query("SELECT lexeme_id, coalesce(max(CAST(coalesce(trim(homonr), '0') <> '0' AS INT)) OVER (PARTITION BY lemma, upos) = 1, FALSE) AND lemma IS NOT NULL AND upos IS NOT NULL AS numbered FROM lexeme_slots")
def numbered_siblings(spark, sf):
    """Whether a lexeme or a homonym of it has a number other than 0."""
    return evidence.numbered_siblings(_lexemes(spark, sf), "lexeme_id", ["lemma", "upos"], "homonr")


@_query(f"""
WITH p AS (SELECT lexeme_id, upper(upos) AS cls, lower(regexp_extract(stycke, '^[^|]*\\|([^|]*)$', 1)) AS key FROM lexeme_slots WHERE regexp_matches(stycke, '^[^|]+\\|[^|]+$')),
li AS (SELECT key, cls, count(DISTINCT entry_id) AS n FROM (SELECT lower(unnest(lemmas)) AS key, coalesce(cls, '') AS cls, entry_id FROM {_E} UNION ALL SELECT lower(head), coalesce(upper(upos), ''), 'h' || head_id FROM head_words) WHERE key <> '' GROUP BY 1, 2),
fi AS (SELECT key, cls, count(DISTINCT entry_id) AS n FROM (SELECT lower(unnest(list_transform(word_forms, lambda x: x.form))) AS key, coalesce(cls, '') AS cls, entry_id FROM {_E}) WHERE key <> '' GROUP BY 1, 2),
ls AS (SELECT key, sum(n) AS t FROM li GROUP BY 1), fs AS (SELECT key, sum(n) AS t FROM fi GROUP BY 1),
j AS (SELECT p.lexeme_id, CASE WHEN ls.t IS NOT NULL THEN l2.n ELSE f2.n END AS same, coalesce(ls.t, fs.t) AS total FROM p LEFT JOIN ls ON ls.key = p.key LEFT JOIN li l2 ON l2.key = p.key AND l2.cls = p.cls LEFT JOIN fs ON fs.key = p.key LEFT JOIN fi f2 ON f2.key = p.key AND f2.cls = p.cls)
SELECT lexeme_id, CASE WHEN coalesce(same, total, 0) = 0 THEN 'none' ELSE CASE WHEN coalesce(same, total) = 1 THEN 'unique' ELSE 'multiple' END || CASE WHEN same IS NOT NULL THEN '_same_class' ELSE '_class_mismatch' END END AS outcome, CAST(coalesce(same, total, 0) AS BIGINT) AS candidates FROM j""")
def head_recovery(spark, sf):
    """What the heads of compounds with one joint are in the lexica: lemmas first, forms if no lemma is."""
    parts = _lexemes(spark, sf).filter(F.col("stycke").rlike(r"^[^|]+\|[^|]+$")).select("lexeme_id", F.upper("upos").alias("cls"), F.lower(F.regexp_extract("stycke", r"^[^|]*\|([^|]*)$", 1)).alias("head"))
    heads = table(spark, sf, "head_words").select(F.lower("head").alias("key"), F.concat(F.lit("h"), "head_id").alias("entry_id"), F.upper("upos").alias("cls"))
    lemmas = _entries(spark, sf).select(F.explode(F.transform("lemmas", F.lower)).alias("key"), "entry_id", "cls").unionByName(heads)
    return evidence.head_outcomes(parts, "lexeme_id", "head", "cls", lemmas, _entry_forms(spark, sf).select(F.lower("form").alias("key"), "entry_id", "cls"))


@_query(f"""
WITH i AS (SELECT form, count(DISTINCT entry_id) AS entries FROM (SELECT entry_id, unnest(list_transform(word_forms, lambda x: x.form)) AS form FROM {_E}) WHERE form IS NOT NULL GROUP BY 1),
c AS (SELECT lemma, slot, written_form, array_to_string(list_sort(list(DISTINCT lexeme_id)), ',') AS occurrences FROM slot_forms JOIN lexeme_slots USING (lexeme_id) WHERE written_form IS NOT NULL GROUP BY 1, 2, 3)
SELECT c.*, coalesce(entries, 0) AS entries FROM c LEFT JOIN i ON i.form = c.written_form""")
def global_presence(spark, sf):
    """Every distinct case of lemma, slot and form, where it occurs, and how many entries have the form."""
    cases = _forms(spark, sf).join(_lexemes(spark, sf).select("lexeme_id", "lemma"), "lexeme_id")
    return evidence.presence(cases, ["lemma", "slot", "written_form"], "lexeme_id", _entry_forms(spark, sf).select("form", "entry_id"), "written_form")


_ENDS = "|".join(sorted(evidence.INFLECTION_ENDINGS, key=len, reverse=True))


@_query(f"""
WITH e AS (SELECT DISTINCT lemma, lower(form) AS form FROM (SELECT unnest(lemmas) AS lemma, form FROM (SELECT lemmas, unnest(list_transform(word_forms, lambda x: x.form)) AS form FROM {_E})) WHERE form IS NOT NULL),
m AS (SELECT lexeme_id, lower(l.lemma) AS lemma, form FROM lexeme_slots l JOIN e ON e.lemma = l.lemma WHERE NOT EXISTS (SELECT 1 FROM slot_forms s WHERE s.lexeme_id = l.lexeme_id AND lower(s.written_form) = e.form))
SELECT lexeme_id, form, CASE WHEN length(form) >= 3 AND regexp_matches(form, '(a|as)$') AND (regexp_matches(lemma, '(a|as|e|i|ä)$') OR length(lemma) <= 3) AND 1 - levenshtein(form, lemma) / greatest(length(form), length(lemma), 1) >= 0.45 THEN 'other_spelling'
 WHEN length(form) >= 3 AND left(form, 3) = left(lemma, 3) AND length(lemma) >= 3 AND regexp_matches(form, '({_ENDS})$') THEN 'inflection' ELSE 'unknown' END AS reason FROM m""")
def missing_form_reasons(spark, sf):
    """Forms of the other lexicon that a lexeme of the lemma lacks, and why they may be missing."""
    e = _entry_forms(spark, sf).select(F.explode("lemmas").alias("lemma"), F.lower("form").alias("form")).distinct()
    own = _forms(spark, sf).select("lexeme_id", F.lower("written_form").alias("form")).distinct()
    m = _lexemes(spark, sf).select("lexeme_id", "lemma").join(e, "lemma").join(own, ["lexeme_id", "form"], "left_anti")
    return m.select("lexeme_id", "form", evidence.miss_reason(F.col("form"), F.lower("lemma")).alias("reason"))


@_query("""
SELECT w.word_id, count(l.top) AS lines_above FROM ocr_words w LEFT JOIN (SELECT DISTINCT page_id, top FROM ocr_words WHERE level = '4') l ON l.page_id = w.page_id AND l.top <= w.top WHERE w.level = '5' GROUP BY 1""")
def lines_above(spark, sf):
    """How many lines of its page begin above or at each word."""
    o = table(spark, sf, "ocr_words")
    words = o.filter("level = '5'").select("page_id", "top", "word_id")
    return evidence.place_among(words, o.filter("level = '4'").select("page_id", "top").distinct(), ["page_id"], "top", "lines_above").select("word_id", "lines_above")


# ---- aggregates, orders and sets -----------------------------------------------------------


@_query("""
SELECT lexeme_id, slot, written_form, CASE WHEN count(DISTINCT provenance) > 1 THEN 'merged' ELSE min(provenance) END AS provenance, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(*) AS n FROM slot_forms GROUP BY 1, 2, 3""")
def merged_provenance(spark, sf):
    """Every form of a slot once, its provenance merged where it has several."""
    g = table(spark, sf, "slot_forms").groupBy("lexeme_id", "slot", "written_form").agg(
        F.count_distinct("provenance").alias("k"), F.min("provenance").alias("p"), F.array_sort(F.collect_set("source")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    return g.select("lexeme_id", "slot", "written_form", F.when(F.col("k") > 1, "merged").otherwise(F.col("p")).alias("provenance"), F.when(F.size("s") > 0, F.array_join("s", "|")).alias("sources"), "n")


@_query(f"""
WITH e AS (SELECT lemma, list_distinct(flatten(list(list_transform(word_forms, lambda x: x.form)))) AS g FROM (SELECT unnest(lemmas) AS lemma, word_forms FROM {_E}) GROUP BY 1),
f AS (SELECT lexeme_id, list(DISTINCT written_form) FILTER (provenance = 'row') AS old, list(DISTINCT written_form) AS new FROM slot_forms WHERE written_form IS NOT NULL GROUP BY 1),
s AS (SELECT upper(upos) AS cls, CASE WHEN len(old) IS NULL THEN 'none' WHEN e.g IS NULL THEN 'no_entry' WHEN list_has_all(e.g, old) THEN 'covered' ELSE 'mismatch' END AS before, CASE WHEN e.g IS NULL THEN 'no_entry' WHEN list_has_all(e.g, new) THEN 'covered' ELSE 'mismatch' END AS after FROM f JOIN lexeme_slots USING (lexeme_id) LEFT JOIN e USING (lemma))
SELECT cls, count(*) AS lexemes, count(*) FILTER (before = 'covered') AS covered_before, count(*) FILTER (after = 'covered') AS covered_after, count(*) FILTER (before = 'covered' AND after = 'mismatch') AS lost, count(*) FILTER (before <> 'covered' AND after = 'covered') AS won FROM s GROUP BY 1""")
def rebaseline_counts(spark, sf):
    """By class, lexemes whose forms the other lexicon covers: those of rows alone, and all of them."""
    e = _entries(spark, sf).select(F.explode("lemmas").alias("lemma"), "word_forms").groupBy("lemma").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("word_forms", lambda x: x["form"])))).alias("g"))
    f = table(spark, sf, "slot_forms").filter("written_form is not null").groupBy("lexeme_id").agg(F.collect_set(F.when(F.col("provenance") == "row", F.col("written_form"))).alias("old"), F.collect_set("written_form").alias("new"))
    d = f.join(_lexemes(spark, sf).select("lexeme_id", "lemma", F.upper("upos").alias("cls")), "lexeme_id").join(e, "lemma", "left")
    inside = lambda c: F.size(F.array_except(c, "g")) == 0
    before = F.when(F.size("old") == 0, "none").when(F.col("g").isNull(), "no_entry").when(inside("old"), "covered").otherwise("mismatch")
    after = F.when(F.col("g").isNull(), "no_entry").when(inside("new"), "covered").otherwise("mismatch")
    s = d.select("cls", before.alias("b"), after.alias("a"))
    return s.groupBy("cls").agg(
        F.count(F.lit(1)).alias("lexemes"), F.count_if(F.col("b") == "covered").alias("covered_before"), F.count_if(F.col("a") == "covered").alias("covered_after"),
        F.count_if((F.col("b") == "covered") & (F.col("a") == "mismatch")).alias("lost"), F.count_if((F.col("b") != "covered") & (F.col("a") == "covered")).alias("won"),
    )


@_query("""
WITH c AS (SELECT slot, source, count(*) AS n FROM slot_forms WHERE source IS NOT NULL GROUP BY 1, 2), r AS (SELECT slot, n, row_number() OVER (PARTITION BY slot ORDER BY source) AS stored, row_number() OVER (PARTITION BY slot ORDER BY n DESC, source) AS ranked FROM c)
SELECT slot, CAST(sum(stored * n) AS BIGINT) AS stored_cost, CAST(sum(ranked * n) AS BIGINT) AS ranked_cost FROM r GROUP BY 1""")
def popularity_cost(spark, sf):
    """What looking for the tokens of each slot costs in stored order, and in the order of their frequency."""
    c = table(spark, sf, "slot_forms").filter("source is not null").groupBy("slot", "source").agg(F.count(F.lit(1)).alias("n"))
    stored = ordered.running_sum(c, ["slot"], ["source"], F.lit(1).cast("bigint"), "stored")
    ranked = ordered.running_sum(stored.withColumn("__d", -F.col("n")), ["slot"], ["__d", "source"], F.lit(1).cast("bigint"), "ranked")
    return ranked.groupBy("slot").agg(F.sum(F.col("stored") * F.col("n")).alias("stored_cost"), F.sum(F.col("ranked") * F.col("n")).alias("ranked_cost"))


@_query("""
WITH m AS (SELECT line_num, word_num, median("left") AS l, median(width) AS w, count(*) AS n FROM ocr_words WHERE level = '5' GROUP BY 1, 2)
SELECT line_num, word_num, l AS median_left, w AS median_width, n, CAST(count(*) FILTER (abs(o."left" - l) <= 40) AS BIGINT) AS stable FROM ocr_words o JOIN m USING (line_num, word_num) WHERE level = '5' GROUP BY ALL""")
def consensus_places(spark, sf):
    """The usual place of the nth word of the nth line over all pages, and how many words are near it."""
    o = table(spark, sf, "ocr_words").filter("level = '5'").select("line_num", "word_num", "left", "width")
    m = o.groupBy("line_num", "word_num").agg(F.median("left").alias("median_left"), F.median("width").alias("median_width"), F.count(F.lit(1)).alias("n"))
    near = o.join(m, ["line_num", "word_num"]).withColumn("near", (F.abs(F.col("left") - F.col("median_left")) <= 40).cast("bigint"))
    return near.groupBy("line_num", "word_num", "median_left", "median_width", "n").agg(F.sum("near").alias("stable"))


_NUMBER = "CASE WHEN regexp_full_match(homonr, '[0-9]+') THEN CAST(homonr AS INT) ELSE 999999 END"


@_query(f"SELECT lexeme_id, row_number() OVER (PARTITION BY lower(lemma) ORDER BY {_NUMBER}, lexeme_id) AS place FROM lexeme_slots WHERE lemma IS NOT NULL")
def homonym_order(spark, sf):
    """The place of each lexeme among its homonyms, by number; those without one come last."""
    number = F.when(F.col("homonr").rlike("^[0-9]+$"), F.expr("try_cast(homonr AS INT)")).otherwise(999999)
    d = _lexemes(spark, sf).filter("lemma is not null").select("lexeme_id", F.lower("lemma").alias("key"), number.alias("number"))
    return ordered.running_sum(d, ["key"], ["number", "lexeme_id"], F.lit(1).cast("bigint"), "place").select("lexeme_id", "place")


@_query("SELECT source AS token, count(*) AS n, min(slot_form_id) AS first_id FROM slot_forms WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, first_id LIMIT 20")
def most_common_tokens(spark, sf):
    """The 20 most frequent tokens, ties by first occurrence."""
    g = table(spark, sf, "slot_forms").filter("source is not null").groupBy(F.col("source").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.min("slot_form_id").alias("first_id"))
    return g.orderBy(F.desc("n"), "first_id").limit(20)


@_query("SELECT msd, n, row_number() OVER (ORDER BY n DESC, msd) AS place FROM (SELECT msd, count(*) AS n FROM generated_word_forms WHERE msd IS NOT NULL GROUP BY 1)")
def msd_by_count(spark, sf):
    """The forms' descriptions by number, then by name."""
    g = table(spark, sf, "generated_word_forms").filter("msd is not null").groupBy("msd").agg(F.count(F.lit(1)).alias("n"), (-F.count(F.lit(1))).alias("__d"))
    return ordered.running_sum(g, [], ["__d", "msd"], F.lit(1).cast("bigint"), "place").select("msd", "n", "place")


_FAMILIES = [("genitive", ["+s"]), ("definite_en", ["+en", "+ens"]), ("definite_et", ["+et", "+ets"]), ("definite_n", ["+n", "+ns"]), ("plural_ar", ["+ar", "+arna", "+arnas", "+ars"]), ("plural_er", ["+er", "+erna", "+ernas", "+ers"])]
_FAMILY_SQL = "CASE " + " ".join(f"WHEN list_has_all({f}, d) AND len(d) > 0 THEN '{n}'" for n, f in _FAMILIES) + " WHEN len(d) = 0 THEN 'none' ELSE 'other' END"
_OWN = "(SELECT lexeme_id, list(DISTINCT lower(written_form)) AS f FROM slot_forms WHERE written_form IS NOT NULL GROUP BY 1)"
_OTHER = "(SELECT lower(lemma) AS lemma, list_distinct(list_transform(list_filter(flatten(list(list_transform(word_forms, lambda x: x.form))), lambda y: y IS NOT NULL), lambda z: lower(z))) AS g FROM (SELECT unnest(lemmas) AS lemma, word_forms FROM saldo_analyses) WHERE lemma IS NOT NULL GROUP BY 1)"
_REL = "list_sort(list_transform(list_filter({a}, lambda x: NOT list_contains({b}, x)), lambda x: CASE WHEN starts_with(x, lemma) THEN '+' || substr(x, length(lemma) + 1) ELSE '=' || x END))"
_PAIR_SQL = f"(SELECT lexeme_id, lower(l.lemma) AS lemma, l.notation, f, g FROM lexeme_slots l JOIN {_OWN} USING (lexeme_id) JOIN {_OTHER} o ON o.lemma = lower(l.lemma))"


def _two_sides(spark, sf) -> DataFrame:
    """Lexemes with their folded forms `f` and those of all entries of their lemma `g`, and what each lacks as relative forms."""
    own = _forms(spark, sf).groupBy("lexeme_id").agg(F.collect_set(F.lower("written_form")).alias("f"))
    other = _entries(spark, sf).select(F.explode(F.transform("lemmas", F.lower)).alias("lemma"), "word_forms").filter("lemma is not null")
    other = other.groupBy("lemma").agg(F.array_distinct(F.transform(F.array_compact(F.flatten(F.collect_list(F.transform("word_forms", lambda x: x["form"])))), F.lower)).alias("g"))
    d = _lexemes(spark, sf).select("lexeme_id", F.lower("lemma").alias("lemma"), "notation").join(own, "lexeme_id").join(other, "lemma")
    rel = lambda a, b: F.array_sort(F.transform(F.array_except(a, b), lambda x: F.when(x.startswith(F.col("lemma")), F.concat(F.lit("+"), F.substring(x, F.length("lemma") + 1, F.length(x)))).otherwise(F.concat(F.lit("="), x))))
    return d.withColumns({"extra": rel("g", "f"), "missing": rel("f", "g")})


@_query(f"SELECT family, count(*) AS n FROM (SELECT {_FAMILY_SQL} AS family FROM (SELECT {_REL.format(a='g', b='f')} AS d FROM {_PAIR_SQL})) GROUP BY 1")
def suffix_families(spark, sf):
    """What the other lexicon has beyond a lexeme's forms, as families of endings."""
    out = None
    for name, endings in _FAMILIES:
        hit = (F.size("extra") > 0) & (F.size(F.array_except("extra", F.array(*map(F.lit, endings)))) == 0)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return _two_sides(spark, sf).select(out.when(F.size("extra") == 0, "none").otherwise("other").alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


_SINGULAR = ("+en", "+et", "+n", "+t", "+s", "+")


@_query(f"""
SELECT lexeme_id, CASE WHEN len(m) = 0 THEN 'exact' ELSE 'mismatch' END AS singular, array_to_string(m, ' ') AS missing, array_to_string(x, ' ') AS extra FROM (SELECT lexeme_id, {_REL.format(a='f', b='g')} AS m, {_REL.format(a='g', b='f')} AS x FROM {_PAIR_SQL} WHERE trim(notation) IN {_SINGULAR}) WHERE len(x) > 0""")
def licensed_scope(spark, sf):
    """Lexemes whose notation licenses a singular only: whether the other lexicon, which has more, has all of it."""
    d = _two_sides(spark, sf).filter(F.trim("notation").isin(*_SINGULAR) & (F.size("extra") > 0))
    return d.select("lexeme_id", F.when(F.size("missing") == 0, "exact").otherwise("mismatch").alias("singular"), F.array_join("missing", " ").alias("missing"), F.array_join("extra", " ").alias("extra"))


_PAIRS = [["+en", "+ens"], ["+et", "+ets"], ["+n", "+ns"], ["+t", "+ts"]]


@_query(f"""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lemma, '\\s') THEN 'several_words' WHEN len(list_filter(list_concat(m, x), lambda v: starts_with(v, '='))) > 0 THEN 'variant'
 WHEN m IN {_PAIRS} AND ({' OR '.join(f"list_has_all(x, {p})" for p in _PAIRS)}) THEN 'competing_definite' ELSE 'other' END AS kind FROM (SELECT lemma, {_REL.format(a='f', b='g')} AS m, {_REL.format(a='g', b='f')} AS x FROM {_PAIR_SQL}) WHERE len(m) + len(x) > 0) GROUP BY 1""")
def difference_triage(spark, sf):
    """Why two lexica differ in the forms of a lexeme, by the first reason that holds."""
    d = _two_sides(spark, sf).filter(F.size("missing") + F.size("extra") > 0)
    pairs = [F.array(*map(F.lit, p)) for p in _PAIRS]
    lacks = F.reduce(F.array(*[F.col("missing") == p for p in pairs]), F.lit(False), lambda a, b: a | b)
    has = F.reduce(F.array(*[F.size(F.array_except(p, "extra")) == 0 for p in pairs]), F.lit(False), lambda a, b: a | b)
    kind = F.when(F.col("lemma").rlike(r"\s"), "several_words").when(F.exists(F.concat("missing", "extra"), lambda v: v.startswith("=")), "variant").when(lacks & has, "competing_definite").otherwise("other")
    return d.select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT form, string_agg(DISTINCT stage, '|' ORDER BY stage) AS stages FROM (SELECT lower(written_form) AS form, 'generated' AS stage FROM generated_word_forms UNION ALL SELECT lower(written_form), 'slots' FROM slot_forms UNION ALL SELECT lower(written_form), 'other' FROM saldo_word_forms) WHERE form IS NOT NULL GROUP BY 1""")
def stage_union(spark, sf):
    """The forms of all stages once, with the stages that have them."""
    one = lambda t, name: table(spark, sf, t).select(F.lower("written_form").alias("form"), F.lit(name).alias("stage"))
    both = one("generated_word_forms", "generated").unionByName(one("slot_forms", "slots")).unionByName(one("saldo_word_forms", "other"))
    return both.filter("form is not null").groupBy("form").agg(F.array_join(F.array_sort(F.collect_set("stage")), "|").alias("stages"))


@_query("""
WITH c AS (SELECT source, coalesce(lang, '?') AS k, count(*) AS n FROM documents GROUP BY 1, 2 UNION ALL SELECT source, 'kind:' || coalesce(doc_kind, '?'), count(*) FROM documents GROUP BY 1, 2)
SELECT source, string_agg(k || '=' || n, ';' ORDER BY k) AS counters FROM c GROUP BY 1""")
def merged_counters(spark, sf):
    """The counters of languages and kinds of each source as one map, written out by key."""
    d = table(spark, sf, "documents")
    counts = lambda c: d.groupBy("source", c.alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    a, b = counts(F.coalesce("lang", F.lit("?"))), counts(F.concat(F.lit("kind:"), F.coalesce("doc_kind", F.lit("?")))).withColumnRenamed("m", "m2")
    both = a.join(b, a.source.eqNullSafe(b.source)).select(a.source, F.map_concat("m", "m2").alias("m"))
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return both.select("source", F.array_join(pairs, ";").alias("counters"))


# ---- rasters -------------------------------------------------------------------------------


def _drawn(spark, sf) -> tuple[DataFrame, dict]:
    """The words of print as drawn pages, and the glyphs of all letters that the table of fixed size has."""
    words = table(spark, sf, "print_vocab").filter("word is not null")
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().limit(5000).collect()
    return raster.draw_words(words, "word_no", "word"), {r.c: list(raster.drawn_glyph(r.c)) for r in letters}


@_query("SELECT CAST(word_no AS BIGINT) AS page, word AS text, CAST(0 AS INT) AS lost FROM print_vocab WHERE length(word) > 0")
def raster_round_trip(spark, sf):
    """Words drawn as pages and read back, glyph by glyph from the left."""
    pages, glyphs = _drawn(spark, sf)
    return raster.row_texts(raster.read_pages(pages, glyphs)).select("page", "text", "lost")


@_query("SELECT CAST(word_no AS BIGINT) AS page, CAST(1 AS BIGINT) AS rows, CAST(length(word) AS BIGINT) AS glyphs, CAST(0 AS BIGINT) AS unsolved_rows, CAST(0 AS BIGINT) AS lost FROM print_vocab WHERE length(word) > 0")
def raster_page_results(spark, sf):
    """What reading each drawn page came to."""
    pages, glyphs = _drawn(spark, sf)
    return raster.page_results(raster.read_pages(pages, glyphs))


@_query(f"SELECT CAST(word_no AS BIGINT) AS page, CAST(2 AS INT) AS top, CAST({2 + raster.GLYPH_HEIGHT} AS INT) AS bottom FROM print_vocab WHERE length(word) > 0")
def raster_bands(spark, sf):
    """The inked bands of each drawn page."""
    bands = ocr.row_bands(ocr.ink_pixels(_drawn(spark, sf)[0]))
    return bands.select("page", "top", "bottom")


# ---- relations, sources and sinks ------------------------------------------------------------

_RAW = "(SELECT lexeme_id, CAST(head_id AS VARCHAR) AS g, coalesce(homonr, '') AS h, coalesce(nullif(stycke, ''), lemma, '') AS heading, coalesce(lemma, '') AS lemma, coalesce(upos, '') = 'X' AS ref FROM lexeme_slots)"
_HEADINGS = f"""(SELECT r.*, CASE WHEN h NOT IN ('', '0') THEN h WHEN lo = hi THEN lo ELSE '' END AS number FROM {_RAW} r JOIN (SELECT g, min(CASE WHEN h NOT IN ('', '0') THEN h END) AS lo, max(CASE WHEN h NOT IN ('', '0') THEN h END) AS hi FROM {_RAW} WHERE NOT ref GROUP BY 1) USING (g) WHERE NOT ref)"""


def _relations(spark, sf) -> dict[str, DataFrame]:
    """Lexemes as raw records, grouped by their head; those of class X as references."""
    none = F.lit(None).cast("string")
    raw = _lexemes(spark, sf).select(
        F.col("lemma").alias("normaliserat_ord"), "homonr", F.when(F.coalesce("upos", F.lit("")) == "X", "(HV) adj. komp.").otherwise("s.").alias("ordkl"), "stycke", F.col("head_id").cast("bigint").alias("urspr_lopnr"),
        F.lit(None).cast("bigint").alias("subnr"), F.col("notation").alias("text"), none.alias("source"), "upos", none.alias("ord"), F.col("lexeme_id").alias("row_idx"),
    )
    return relational.materialize(raw)


@_query(f"SELECT lexeme_id AS row_idx, CASE WHEN number <> '' THEN g || ':' || g || ':' || number ELSE '' END AS article_id, heading, CASE WHEN h NOT IN ('', '0') THEN 'primary' ELSE 'alternate' END AS heading_type, number FROM {_HEADINGS}")
def relation_headings(spark, sf):
    """The headings of raw records, each with its article; a homonym number 0 goes to the only other number of its group."""
    h = _relations(spark, sf)["headings"]
    return h.select(F.col("source_row_index").alias("row_idx"), "article_id", "heading", "heading_type", F.col("homonym_number").alias("number"))


@_query(f"SELECT g || ':' || g || ':' || number AS article_id, arg_min(lemma, (CAST(h IN ('', '0') AS INT), lexeme_id)) AS lemma, CAST(count(*) AS INT) AS source_row_count FROM {_HEADINGS} WHERE number <> '' GROUP BY 1")
def relation_articles(spark, sf):
    """The articles of raw records, with the lemma of their first primary row."""
    return _relations(spark, sf)["articles"].select("article_id", "lemma", "source_row_count")


@_query(f"SELECT lexeme_id AS row_idx, g || ':' || g || ':' || h || ':' || heading AS reference_id, lemma AS target_lemma, 'inflection_reference' AS reference_type FROM {_RAW} WHERE ref")
def relation_references(spark, sf):
    """The references among raw records."""
    r = _relations(spark, sf)["references"]
    return r.select(F.col("source_row_index").alias("row_idx"), "reference_id", "target_lemma", "reference_type")


@_query(f"SELECT (SELECT count(*) FROM {_RAW}) AS records, (SELECT count(*) FROM {_HEADINGS}) AS headings, (SELECT count(*) FROM {_RAW} WHERE ref) AS refs, (SELECT count(*) FROM {_HEADINGS} WHERE number = '') AS unresolved")
def lossless_accounting(spark, sf):
    """Records in, and headings, references and unresolved rows out: none is lost."""
    rel = _relations(spark, sf)
    parts = {"records": _lexemes(spark, sf), "headings": rel["headings"], "refs": rel["references"], "unresolved": rel["unresolved"]}
    counts = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts])


@_query("""
SELECT 'lemma' AS field, 'string' AS type, count(*) AS rows, count(*) FILTER (lemma IS NULL) AS nulls, count(*) FILTER (trim(lemma) = '') AS blanks, min(lemma) AS least, max(lemma) AS most FROM lexeme_slots
UNION ALL SELECT 'upos', 'string', count(*), count(*) FILTER (upos IS NULL), count(*) FILTER (trim(upos) = ''), min(upos), max(upos) FROM lexeme_slots
UNION ALL SELECT 'notation', 'string', count(*), count(*) FILTER (notation IS NULL), count(*) FILTER (trim(notation) = ''), min(notation), max(notation) FROM lexeme_slots""")
def field_profile(spark, sf):
    """What the fields of lexemes hold."""
    return sources.profile(_lexemes(spark, sf).select("lemma", "upos", "notation")).drop("distinct")


@_query("SELECT entry_id, lemma, array_to_string(f, '|') AS forms FROM (SELECT entry_id, coalesce(lemmas[1], list_min(f)) AS lemma, f FROM (SELECT entry_id, lemmas, list_sort(list_distinct(list_concat(lemmas, list_transform(word_forms, lambda x: x.form)))) AS f FROM saldo_analyses))")
def lmf_written_forms(spark, sf):
    """Entries as elements of an LMF lexicon, read with all their written forms."""
    feat = lambda name, c: F.array(F.struct(F.lit(name).alias("_att"), c.alias("_val")))
    e = table(spark, sf, "saldo_analyses").select(
        F.col("entry_id").alias("_id"), F.struct(F.transform("lemmas", lambda x: F.struct(feat("writtenForm", x).alias("feat"))).alias("FormRepresentation")).alias("Lemma"),
        F.transform("word_forms", lambda w: F.struct(F.concat(feat("writtenForm", w["form"]), feat("msd", w["msd"])).alias("feat"))).alias("WordForm"),
    )
    return lexicon.all_written_forms(e).select("entry_id", "lemma", F.array_join("forms", "|").alias("forms"))


@_query("SELECT lower(form) AS form, string_agg(DISTINCT msd, '|' ORDER BY msd) AS labels FROM (SELECT f.form AS form, f.msd AS msd FROM (SELECT unnest(word_forms) AS f FROM saldo_analyses)) WHERE form IS NOT NULL GROUP BY 1")
def lmf_form_labels(spark, sf):
    """Every form of the other lexicon with its grammatical labels."""
    feat = lambda name, c: F.array(F.struct(F.lit(name).alias("_att"), c.alias("_val")))
    e = table(spark, sf, "saldo_analyses").select(F.transform("word_forms", lambda w: F.struct(F.concat(feat("writtenForm", w["form"]), feat("msd", w["msd"])).alias("feat"))).alias("WordForm"))
    return lexicon.form_labels(e).select("form", F.when(F.size("labels") > 0, F.array_join("labels", "|")).alias("labels"))


@_query("SELECT lexeme_id, lemma, notation FROM lexeme_slots WHERE lemma = (SELECT min(lemma) FROM lexeme_slots) ORDER BY lexeme_id LIMIT 1")
def point_lookup(spark, sf):
    """The first lexeme of one lemma."""
    d = _lexemes(spark, sf).select("lexeme_id", "lemma", "notation")
    return lexicon.one_record(d, "lemma", d.agg(F.min("lemma")).first()[0], "lexeme_id")
