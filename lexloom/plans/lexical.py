"""Queries of the operators over the lexical tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff, grouping, match, notation, ordered, relational
from ..sources import ocr_words, standalone, strip_html, with_next
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


# ---- projections and filters -----------------------------------------------------------

_REASON = """CASE WHEN w IS NULL OR w = '' THEN 'EMPTY' WHEN length(w) = 1 THEN 'ONE_CHARACTER' WHEN regexp_full_match(w, '\\p{L}+') THEN NULL
 WHEN regexp_matches(w, '[\\p{Nd}²³¹⁰-⁹₀-₉]') THEN 'CONTAINS_DIGIT' WHEN regexp_matches(w, '[-‐‑‒–—−]') THEN 'CONTAINS_HYPHEN'
 WHEN regexp_matches(w, '[''’]') THEN 'CONTAINS_APOSTROPHE' ELSE 'CONTAINS_OTHER_NONLETTER' END"""
_DOC_WORDS = "(SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(text), '[^\\s.,;:!?()]+')) AS w FROM documents WHERE text IS NOT NULL)"


def _doc_words(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", "source", "lang", F.explode(T.words(F.lower("text"), r"[^\s.,;:!?()]+")).alias("w"))


@_query(f"""
SELECT w AS form, min(doc_id) AS first_doc, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(*) - 1 AS duplicates
FROM {_DOC_WORDS} WHERE ({_REASON}) IS NULL GROUP BY w""")
def words_reject_dedupe(spark, sf):
    """Usable words of the documents, one row each, with where they came from."""
    g = grouping.group_first_union(_doc_words(spark, sf), ["w"], "doc_id", ["doc_id"], ["source"])
    # each distinct word is judged once
    g = g.filter(T.rejection_reason("w").isNull())
    return g.select(F.col("w").alias("form"), F.col("doc_id").alias("first_doc"), F.array_join("source", "|").alias("sources"), (F.col("n") - 1).alias("duplicates"))


@_query(f"SELECT coalesce({_REASON}, 'ACCEPTED') AS reason, count(*) AS n, count(DISTINCT w) AS forms FROM {_DOC_WORDS} GROUP BY 1")
def reject_reason_counts(spark, sf):
    """How many words each reason rejects."""
    w = _doc_words(spark, sf).groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    return w.groupBy(F.coalesce(T.rejection_reason("w"), F.lit("ACCEPTED")).alias("reason")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("forms"))


@_query("""
SELECT lexeme_id, trim(regexp_replace(translate(regexp_replace(stycke, '<sup>.*?</sup>|<[^>]*>', '', 'g'), '­·|', ''), '\\s+', ' ', 'g')) AS surface FROM lexeme_slots""")
def surface_clean(spark, sf):
    """Headwords without marks."""
    return table(spark, sf, "lexeme_slots").select("lexeme_id", T.clean_surface("stycke").alias("surface"))


@_query("SELECT upos, count(*) AS n FROM lexeme_slots WHERE coalesce(trim(notation), '') IN ('', '(null)', 'null') GROUP BY upos")
def null_text_filter(spark, sf):
    """Lexemes whose notation is absent in any of its spellings."""
    return table(spark, sf, "lexeme_slots").filter(T.is_null_text("notation")).groupBy("upos").agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT upos_class, count(*) AS n FROM (SELECT CASE WHEN upper(trim(upos)) = 'NOUN' THEN 'NOUN' WHEN upper(trim(upos)) = 'ADJ' THEN 'ADJ' WHEN upper(trim(upos)) = 'VERB' THEN 'VERB'
  WHEN notation LIKE '%best. pl.%' THEN 'NOUN' WHEN notation LIKE '%komp.%' OR notation LIKE '%superl.%' THEN 'ADJ' WHEN notation LIKE '%sup.%' OR notation LIKE '%imper.%' THEN 'VERB' ELSE 'X' END AS upos_class
  FROM lexeme_slots) GROUP BY 1""")
def ordered_rule_classify(spark, sf):
    """A word class by ordered rules, the first that holds."""
    u, n = F.upper(F.trim("upos")), F.col("notation")
    rule = F.when(u == "NOUN", "NOUN").when(u == "ADJ", "ADJ").when(u == "VERB", "VERB").when(n.contains("best. pl."), "NOUN")
    rule = rule.when(n.contains("komp.") | n.contains("superl."), "ADJ").when(n.contains("sup.") | n.contains("imper."), "VERB").otherwise("X")
    return table(spark, sf, "lexeme_slots").select(rule.alias("upos_class")).groupBy("upos_class").agg(F.count(F.lit(1)).alias("n"))


@_query("""
SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS plain FROM documents""")
def html_plain(spark, sf):
    """Documents without their tags."""
    return table(spark, sf, "documents").select("doc_id", strip_html("text").alias("plain"))


@_query("""
SELECT msd, upper(split_part(msd, ' ', 1)) AS first_mark, len(string_split(msd, ' ')) AS marks, count(*) AS n FROM generated_word_forms WHERE msd IS NOT NULL GROUP BY 1, 2, 3""")
def msd_inventory(spark, sf):
    """Form marks taken apart and counted."""
    m = table(spark, sf, "generated_word_forms").filter("msd is not null").groupBy("msd").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("msd", " ")
    return m.select("msd", F.upper(parts[0]).alias("first_mark"), F.size(parts).cast("bigint").alias("marks"), "n")


@_query("""
SELECT s.slot, CASE WHEN starts_with(s.written_form, l.lemma) THEN '+' || substr(s.written_form, length(l.lemma) + 1) ELSE '=' END AS relation, count(*) AS n
FROM slot_forms s JOIN lexeme_slots l USING (lexeme_id) WHERE s.written_form IS NOT NULL AND l.lemma IS NOT NULL GROUP BY 1, 2""")
def relative_forms(spark, sf):
    """How forms relate to their lemma: the suffix where they begin with it."""
    j = table(spark, sf, "slot_forms").join(table(spark, sf, "lexeme_slots").select("lexeme_id", "lemma"), "lexeme_id").filter("written_form is not null and lemma is not null")
    rel = T.relative_form("lemma", "written_form")
    return j.select("slot", F.when(rel.startswith("="), "=").otherwise(rel).alias("relation")).groupBy("slot", "relation").agg(F.count(F.lit(1)).alias("n"))


# ---- joins -----------------------------------------------------------------------------


@_query("""
WITH k AS (SELECT lexeme_id, lemma AS k1, replace(stycke, '|', '') AS k2 FROM lexeme_slots),
t AS (SELECT written_form AS k, min(row_id) AS v FROM generated_word_forms WHERE written_form IS NOT NULL GROUP BY 1)
SELECT k.lexeme_id, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 0 ELSE 1 END AS place FROM k LEFT JOIN t a ON a.k = k1 LEFT JOIN t b ON b.k = k2 WHERE coalesce(a.v, b.v) IS NOT NULL""")
def coalesce_key_lookup(spark, sf):
    """The first generated row of a lexeme, by its lemma, else by its marked headword."""
    lex = table(spark, sf, "lexeme_slots")
    return match.lookup_by_keys(lex, "lexeme_id", [F.col("lemma"), F.replace("stycke", F.lit("|"), F.lit(""))], table(spark, sf, "generated_word_forms").filter("written_form is not null"), "written_form", "row_id")


_MANIFEST = [("AUTOMOBILE", 1, "CAR"), ("BUILDING", 2, "HOUSE"), ("MACHINERY", 3, "MACHINE")]


@_query("""
SELECT c_custkey, coalesce(m.n, c_mktsegment) AS c_mktsegment, m.n IS NOT NULL AS corrected FROM customer LEFT JOIN
 (VALUES ('AUTOMOBILE', 1, 'CAR'), ('BUILDING', 2, 'HOUSE'), ('MACHINERY', 3, 'MACHINE')) m(o, k, n) ON m.o = c_mktsegment AND m.k = c_nationkey""")
def correction_manifest(spark, sf):
    """Exact corrections by key and old value."""
    c = spark.createDataFrame(_MANIFEST, "old string, c_nationkey int, new string")
    return match.apply_corrections(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), c, ["c_nationkey"], "c_mktsegment").select("c_custkey", "c_mktsegment", "corrected")


@_query("""
SELECT 'dangling' AS problem, lexeme_id AS key FROM (SELECT DISTINCT lexeme_id FROM slot_forms) s WHERE NOT EXISTS (SELECT 1 FROM lexeme_slots l WHERE l.lexeme_id = s.lexeme_id)
UNION ALL SELECT 'childless', lexeme_id FROM lexeme_slots l WHERE NOT EXISTS (SELECT 1 FROM slot_forms s WHERE s.lexeme_id = l.lexeme_id)""")
def relation_integrity(spark, sf):
    """Lexemes without slot forms and slot forms without lexeme."""
    return relational.integrity(table(spark, sf, "slot_forms"), table(spark, sf, "lexeme_slots"), "lexeme_id", "lexeme_id")


_UPOS = "CASE upper(upos) WHEN 'NN' THEN 'NOUN' WHEN 'AV' THEN 'ADJ' WHEN 'VB' THEN 'VERB' ELSE upper(upos) END"


def _upos(c="upos"):
    u = F.upper(c)
    return F.when(u == "NN", "NOUN").when(u == "AV", "ADJ").when(u == "VB", "VERB").otherwise(u)


def _entry_lemmas(spark, sf):
    e = table(spark, sf, "saldo_analyses")
    return e.select("entry_id", _upos().alias("cls"), F.explode("lemmas").alias("lemma"))


@_query(f"""
WITH l AS (SELECT lexeme_id, lower(lemma) AS lemma, upper(upos) AS cls FROM lexeme_slots),
e AS (SELECT entry_id, {_UPOS} AS cls, lower(unnest(lemmas)) AS lemma FROM saldo_analyses),
k1 AS (SELECT cls || '/' || lemma AS k, count(DISTINCT entry_id) AS matches, min(entry_id) AS v FROM e WHERE cls IS NOT NULL GROUP BY 1),
k2 AS (SELECT lemma AS k, count(DISTINCT entry_id) AS matches, min(entry_id) AS v FROM e GROUP BY 1),
h AS (SELECT lexeme_id, 0 AS place, 'class' AS level, CASE WHEN matches = 1 THEN v END AS value, matches FROM l JOIN k1 ON k1.k = l.cls || '/' || l.lemma
 UNION ALL SELECT lexeme_id, 1, 'lemma', CASE WHEN matches = 1 THEN v END, matches FROM l JOIN k2 ON k2.k = l.lemma)
SELECT lexeme_id, level, value, matches FROM h QUALIFY row_number() OVER (PARTITION BY lexeme_id ORDER BY place) = 1""")
def priority_match(spark, sf):
    """Lexemes and entries by class and lemma, else by lemma; several entries are ambiguous."""
    l = table(spark, sf, "lexeme_slots").select("lexeme_id", F.lower("lemma").alias("lemma"), F.upper("upos").alias("cls"))
    e = _entry_lemmas(spark, sf).withColumn("lemma", F.lower("lemma"))
    key = lambda: F.concat("cls", F.lit("/"), "lemma")
    return match.ladder_match(l, e, "lexeme_id", [("class", key(), key()), ("lemma", F.col("lemma"), F.col("lemma"))], "entry_id")


@_query(f"""
WITH l AS (SELECT l.lexeme_id, l.lemma, list_sort(list(DISTINCT s.written_form)) AS f FROM lexeme_slots l JOIN slot_forms s USING (lexeme_id) WHERE s.written_form IS NOT NULL GROUP BY 1, 2),
e AS (SELECT entry_id, unnest(list_distinct(lemmas)) AS lemma, list_distinct(list_filter(list_transform(word_forms, lambda x: x.form), lambda y: y IS NOT NULL)) AS g FROM saldo_analyses),
p AS (SELECT lexeme_id, entry_id, len(list_intersect(f, g)) AS overlap, len(f) - len(list_intersect(f, g)) AS a, len(g) - len(list_intersect(f, g)) AS b FROM l JOIN e USING (lemma)),
q AS (SELECT lexeme_id, entry_id, CAST(a + b = 0 AS INT) AS exact, CAST(a = 0 AS INT) AS subset, overlap, a + b AS apart FROM p)
SELECT * FROM q QUALIFY rank() OVER (PARTITION BY lexeme_id ORDER BY exact DESC, subset DESC, overlap DESC, apart) = 1""")
def best_match_ties(spark, sf):
    """For each lexeme the entries of its lemma with the best set of forms."""
    lex = table(spark, sf, "lexeme_slots").select("lexeme_id", "lemma")
    f = table(spark, sf, "slot_forms").filter("written_form is not null").groupBy("lexeme_id").agg(F.collect_set("written_form").alias("f"))
    e = table(spark, sf, "saldo_analyses").select(
        "entry_id", F.explode(F.array_distinct("lemmas")).alias("lemma"), F.array_distinct(F.array_compact(F.transform("word_forms", lambda x: x["form"]))).alias("g")
    )
    out = match.best_set_match(lex.join(f, "lexeme_id"), e, "lemma", "lexeme_id", "entry_id", "f", "g")
    return out.withColumns({"overlap": F.col("overlap").cast("bigint"), "apart": F.col("apart").cast("bigint")})


_SALDO_STANDALONE = """(SELECT entry_id, f.form AS form, f.msd AS msd FROM (SELECT entry_id, unnest(word_forms) AS f FROM saldo_analyses)
 WHERE f.form IS NOT NULL AND lower(f.msd) NOT IN ('c', 'ci', 'cm', 'sms') AND f.form NOT LIKE '%-')"""


def _standalone(spark, sf):
    e = table(spark, sf, "saldo_analyses")
    return e.select("entry_id", F.explode(standalone(F.filter("word_forms", lambda f: f["form"].isNotNull()))).alias("f")).select("entry_id", "f.form", "f.msd")


@_query(f"""
WITH a AS (SELECT DISTINCT written_form AS form FROM slot_forms WHERE written_form IS NOT NULL), b AS (SELECT DISTINCT form FROM {_SALDO_STANDALONE})
SELECT coalesce(a.form, b.form) AS form, CASE WHEN b.form IS NULL THEN 'only_left' WHEN a.form IS NULL THEN 'only_right' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.form = b.form""")
def two_sided_audit(spark, sf):
    """Forms of one lexicon, of the other, and of both."""
    a = table(spark, sf, "slot_forms").select(F.col("written_form").alias("form"))
    return diff.two_sided(a, _standalone(spark, sf), "form")


@_query(f"""
WITH b AS (SELECT DISTINCT entry_id, form, msd FROM {_SALDO_STANDALONE} s WHERE NOT EXISTS (SELECT 1 FROM slot_forms f WHERE f.written_form = s.form)),
e AS (SELECT DISTINCT entry_id, {_UPOS} AS cls, unnest(lemmas) AS lemma FROM saldo_analyses)
SELECT b.form, CASE WHEN bool_or(b.msd LIKE '%s-form%') THEN 'S_FORM' WHEN bool_or(b.msd LIKE 'komp%' OR b.msd LIKE 'super%') THEN 'COMPARISON' WHEN bool_or(b.msd LIKE '% gen') THEN 'GENITIVE' ELSE 'CORE_INFLECTION' END AS category,
 count(DISTINCT l.lexeme_id) AS lexemes FROM b JOIN e USING (entry_id) JOIN lexeme_slots l ON l.lemma = e.lemma AND upper(l.upos) = e.cls GROUP BY b.form""")
def evidence_candidates(spark, sf):
    """Forms only the other lexicon has, of lemmas and classes both have, by kind."""
    have = table(spark, sf, "slot_forms").select(F.col("written_form").alias("form")).distinct()
    b = _standalone(spark, sf).distinct().join(have, "form", "left_anti")
    lex = table(spark, sf, "lexeme_slots").select("lexeme_id", "lemma", F.upper("upos").alias("cls"))
    j = b.join(_entry_lemmas(spark, sf).distinct(), "entry_id").join(lex, ["lemma", "cls"])
    m = F.col("msd")
    cat = F.when(F.bool_or(m.contains("s-form")), "S_FORM").when(F.bool_or(m.startswith("komp") | m.startswith("super")), "COMPARISON").when(F.bool_or(m.endswith(" gen")), "GENITIVE").otherwise("CORE_INFLECTION")
    return j.groupBy("form").agg(cat.alias("category"), F.count_distinct("lexeme_id").alias("lexemes"))


@_query("""
SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(article_text), '\\p{L}+')) AS word FROM match_candidates WHERE article_text IS NOT NULL) w
WHERE NOT EXISTS (SELECT 1 FROM print_vocab v WHERE v.word = w.word) AND NOT EXISTS (SELECT 1 FROM lexeme_slots l WHERE lower(l.lemma) = w.word)
 AND NOT EXISTS (SELECT 1 FROM slot_forms s WHERE lower(s.written_form) = w.word)""")
def anti_chain_unknown(spark, sf):
    """Words of articles that no list knows."""
    w = table(spark, sf, "match_candidates").filter("article_text is not null").select(F.explode(T.words(F.lower("article_text"))).alias("word"))
    return match.not_in_any(w, "word", [
        table(spark, sf, "print_vocab").select("word"), table(spark, sf, "lexeme_slots").select(F.lower("lemma").alias("word")), table(spark, sf, "slot_forms").select(F.lower("written_form").alias("word"))
    ])


_DEL = "CASE WHEN length(w) > 1 THEN list_distinct([w] || list_transform(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1))) ELSE [w] END"


@_query(f"""
WITH a AS (SELECT DISTINCT word AS w FROM print_vocab WHERE word IS NOT NULL), k AS (SELECT w, unnest({_DEL}) AS k FROM a)
SELECT DISTINCT x.w AS word, y.w AS candidate FROM k x JOIN k y ON x.k = y.k WHERE x.w <> y.w AND length(y.w) - length(x.w) BETWEEN 0 AND 1""")
def deletion_key_match(spark, sf):
    """Printed words that share a key after one deletion."""
    v = table(spark, sf, "print_vocab").filter("word is not null")
    return match.near_match(v, v, "word")


@_query("""
WITH s AS (SELECT DISTINCT lower(lemma) AS word FROM lexeme_slots WHERE lemma IS NOT NULL), h AS (SELECT DISTINCT head FROM head_words),
p AS (SELECT DISTINCT lower(split_part(stycke, '|', 1)) AS part FROM lexeme_slots WHERE contains(stycke, '|'))
SELECT word, substr(word, 1, i) AS head, substr(word, i + 1) AS tail FROM (SELECT word, unnest(range(2, length(word) - 1)) AS i FROM s)
WHERE substr(word, i + 1) IN (SELECT head FROM h) AND substr(word, 1, i) IN (SELECT part FROM p)""")
def compound_split(spark, sf):
    """Lemmas as a first part and a head, at every place that allows it."""
    lex = table(spark, sf, "lexeme_slots")
    words = lex.filter("lemma is not null").select(F.lower("lemma").alias("word"))
    parts = lex.filter(F.col("stycke").contains("|")).select(F.lower(F.split("stycke", r"\|")[0]).alias("word"))
    return match.compound_splits(words, parts, table(spark, sf, "head_words").select(F.col("head").alias("word")), "word")


@_query("""
WITH n AS (SELECT DISTINCT lexeme_id, written_form AS f FROM slot_forms WHERE written_form IS NOT NULL), z AS (SELECT lexeme_id, count(*) AS n FROM n GROUP BY 1),
o AS (SELECT DISTINCT entry_id, f.form AS f FROM (SELECT entry_id, unnest(word_forms) AS f FROM saldo_analyses) WHERE f.form IS NOT NULL)
SELECT lexeme_id, entry_id FROM (SELECT n.lexeme_id, o.entry_id, count(*) AS met FROM n JOIN o USING (f) GROUP BY 1, 2) JOIN z USING (lexeme_id) WHERE met = n""")
def subset_explains(spark, sf):
    """Entries whose forms include all those of a lexeme."""
    w = table(spark, sf, "slot_forms").select("lexeme_id", F.col("written_form").alias("f"))
    o = table(spark, sf, "saldo_analyses").select("entry_id", F.explode("word_forms").alias("x")).select("entry_id", F.col("x.form").alias("f"))
    return match.explained_by(w, o, "lexeme_id", "entry_id", "f")


@_query("""
WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT user_id, min(user_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) - 1 AS peers FROM s""")
def equal_set_peers(spark, sf):
    """Users with the same set of event types."""
    return match.equal_set_peers(table(spark, sf, "events"), "user_id", "event_type")


@_query("""
WITH x AS (SELECT lexeme_id, lower(lemma) AS k, lemma FROM lexeme_slots WHERE upper(coalesce(upos, 'X')) = 'X' AND lemma IS NOT NULL),
s AS (SELECT lower(lemma) AS k, upper(upos) AS c, coalesce(notation, '') AS t FROM lexeme_slots WHERE upper(coalesce(upos, 'X')) <> 'X'),
j AS (SELECT x.lexeme_id, list_sort(list(DISTINCT c) FILTER (contains(lower(t), lower(x.lemma)))) AS m, list_sort(list(DISTINCT c)) AS a FROM x JOIN s USING (k) GROUP BY 1),
r AS (SELECT x.lexeme_id, m, a, CASE WHEN len(m) > 0 THEN m ELSE a END AS rung FROM x LEFT JOIN j USING (lexeme_id))
SELECT lexeme_id, CASE WHEN len(rung) = 1 THEN CASE WHEN len(m) > 0 THEN 'mention' ELSE 'sole_class' END WHEN len(rung) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS route,
 CASE WHEN len(rung) = 1 THEN rung[1] END AS cls FROM r""")
def route_unclassed(spark, sf):
    """A class for lexemes without one, from siblings that mention them, else from a sole class."""
    lex = table(spark, sf, "lexeme_slots").filter("lemma is not null").withColumn("k", F.lower("lemma")).withColumn("c", F.upper(F.coalesce("upos", F.lit("X"))))
    sib = lex.filter("c <> 'X'").select("k", "c", F.coalesce("notation", F.lit("")).alias("t"))
    return match.route(lex.filter("c = 'X'").select("lexeme_id", "k", "lemma"), sib, "lexeme_id", "k", "lemma", "c", "t")


@_query("""
WITH w AS (SELECT DISTINCT lower(written_form) AS word FROM generated_word_forms WHERE written_form IS NOT NULL)
SELECT word, CASE WHEN word IN (SELECT lower(lemma) FROM lexeme_slots WHERE lemma IS NOT NULL) THEN 'lemma' WHEN word IN (SELECT lower(written_form) FROM slot_forms WHERE written_form IS NOT NULL) THEN 'slot'
 WHEN word IN (SELECT lower(written_form) FROM saldo_word_forms WHERE written_form IS NOT NULL) THEN 'other_system' ELSE 'none' END AS evidence FROM w""")
def evidence_precedence(spark, sf):
    """The best evidence for each generated form."""
    low = lambda t, c: table(spark, sf, t).filter(f"{c} is not null").select(F.lower(c).alias("word"))
    return match.evidence_order(low("generated_word_forms", "written_form"), "word", [("lemma", low("lexeme_slots", "lemma")), ("slot", low("slot_forms", "written_form")), ("other_system", low("saldo_word_forms", "written_form"))])


_ACC = f"translate(lower(w), '{T.ACCENTED}{T.ACCENTED.upper()}', '{T.PLAIN}{T.PLAIN.upper()}')"
_SEP = "regexp_replace(lower(w), '[\\s\\-·|/'']', '', 'g')"


@_query(f"""
WITH l AS (SELECT DISTINCT unnest(lemmas) AS w FROM saldo_analyses), r AS (SELECT DISTINCT lemma AS w FROM lexeme_slots WHERE lemma IS NOT NULL),
k AS (SELECT 0 AS place, 'fold' AS level, replace(lower(w), 'ß', 'ss') AS k, w FROM r UNION ALL SELECT 1, 'separators', {_SEP}, w FROM r
 UNION ALL SELECT 2, 'accents', {_ACC.replace('lower(w)', _SEP)}, w FROM r UNION ALL SELECT 3, 'loose', regexp_replace({_ACC}, '[^a-z0-9]', '', 'g'), w FROM r),
c AS (SELECT place, level, k, count(DISTINCT w) AS matches, min(w) AS v FROM k GROUP BY 1, 2, 3),
q AS (SELECT 0 AS place, replace(lower(w), 'ß', 'ss') AS k, w FROM l UNION ALL SELECT 1, {_SEP}, w FROM l UNION ALL SELECT 2, {_ACC.replace('lower(w)', _SEP)}, w FROM l UNION ALL SELECT 3, regexp_replace({_ACC}, '[^a-z0-9]', '', 'g'), w FROM l)
SELECT q.w AS lemma, level, CASE WHEN matches = 1 THEN v END AS value, matches FROM q JOIN c ON q.place = c.place AND q.k = c.k WHERE q.w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q.w ORDER BY q.place) = 1""")
def ortho_key_ladder(spark, sf):
    """Entry lemmas and lexeme lemmas by ever looser spellings."""
    e = _entry_lemmas(spark, sf).select("lemma").filter("lemma is not null")
    return match.key_ladder(e, table(spark, sf, "lexeme_slots").filter("lemma is not null"), "lemma")


@_query("""
WITH m AS (SELECT DISTINCT candidate_id, unnest(regexp_extract_all(lower(article_text), '\\p{L}+')) AS word FROM match_candidates WHERE article_text IS NOT NULL)
SELECT v.word_no, count(m.candidate_id) AS records FROM print_vocab v LEFT JOIN m ON m.word = lower(v.word) GROUP BY v.word_no""")
def mention_index(spark, sf):
    """In how many articles each printed word is mentioned."""
    m = table(spark, sf, "match_candidates").filter("article_text is not null").select("candidate_id", F.explode(F.array_distinct(T.words(F.lower("article_text")))).alias("word"))
    counts = m.groupBy("word").agg(F.count(F.lit(1)).alias("records"))
    v = table(spark, sf, "print_vocab").select("word_no", F.lower("word").alias("word"))
    return v.join(counts, "word", "left").select("word_no", F.coalesce("records", F.lit(0)).alias("records"))


@_query("""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(text), '[\\p{L}-]+')) AS w FROM runeberg_pages WHERE text IS NOT NULL), f AS (SELECT w, min(page_id) AS page_id FROM t GROUP BY 1)
SELECT l.lexeme_id, f.page_id FROM lexeme_slots l JOIN f ON f.w = lower(l.lemma)""")
def page_search_first(spark, sf):
    """The first page that has each lemma as a word, through an inverted index."""
    p = table(spark, sf, "runeberg_pages").filter("text is not null").select("page_id", F.explode(T.words(F.lower("text"), r"[\p{L}-]+")).alias("w"))
    first = p.groupBy("w").agg(F.min("page_id").alias("page_id"))
    return table(spark, sf, "lexeme_slots").select("lexeme_id", F.lower("lemma").alias("w")).join(first, "w").select("lexeme_id", "page_id")


@_query("""
SELECT lexeme_id, candidate_id, round(0.8 * headword_score + 0.2 * coalesce(text_score, 0), 6) AS rank_score, r AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY lexeme_id ORDER BY round(0.8 * headword_score + 0.2 * coalesce(text_score, 0), 6) DESC, candidate_id) AS r FROM match_candidates WHERE headword_score IS NOT NULL) WHERE r <= 3""")
def rank_weighted_topk(spark, sf):
    """The three best candidates of a lexeme by a weighted score."""
    score = F.round(F.lit(0.8) * F.col("headword_score") + F.lit(0.2) * F.coalesce("text_score", F.lit(0.0)), 6)
    c = table(spark, sf, "match_candidates").filter("headword_score is not null").select("lexeme_id", "candidate_id", score.alias("rank_score"))
    return grouping.top_per_key(c, ["lexeme_id"], [F.desc("rank_score"), F.asc("candidate_id")], 3)


@_query("""
WITH p AS (SELECT a.s_nationkey AS n, a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal - b.s_acctbal), 2) AS gap FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT n, a, b, gap, row_number() OVER (PARTITION BY n ORDER BY gap, a, b) AS rank FROM p QUALIFY rank <= 6""")
def group_pairs_top6(spark, sf):
    """The six closest pairs of suppliers of a nation: neighbours in balance order, ever further, as far as needed."""
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    # among the six closest pairs no two members are more than six places apart in the sorted order
    out, far = None, s.withColumns({"o_id": F.col("s_suppkey"), "o_bal": F.col("s_acctbal")})
    for _ in range(6):
        far = ordered.with_previous(far, ["s_nationkey"], ["s_acctbal", "s_suppkey"], ["o_id", "o_bal"], "p_").drop("o_id", "o_bal").withColumnsRenamed({"p_o_id": "o_id", "p_o_bal": "o_bal"})
        one = far.filter("o_id is not null").select(F.col("s_nationkey").alias("n"), F.least("s_suppkey", "o_id").alias("a"), F.greatest("s_suppkey", "o_id").alias("b"), F.round(F.abs(F.col("s_acctbal") - F.col("o_bal")), 2).alias("gap"))
        out = one if out is None else out.unionByName(one)
    return grouping.top_per_key(out, ["n"], [F.col("gap"), F.col("a"), F.col("b")], 6)


# ---- differences and sets --------------------------------------------------------------


@_query("""
WITH a AS (SELECT DISTINCT form_key, written_form, msd FROM generated_word_forms WHERE form_key IS NOT NULL), b AS (SELECT DISTINCT form_key, written_form, msd FROM saldo_word_forms WHERE form_key IS NOT NULL)
SELECT coalesce(a.form_key, b.form_key) AS form_key, CASE WHEN b.form_key IS NULL THEN 'removed' WHEN a.form_key IS NULL THEN 'added' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.form_key = b.form_key WHERE a.form_key IS NULL OR b.form_key IS NULL OR a.written_form IS DISTINCT FROM b.written_form OR a.msd IS DISTINCT FROM b.msd""")
def keyed_diff(spark, sf):
    """Keyed forms removed, added or changed between the two systems."""
    rows = lambda t: table(spark, sf, t).filter("form_key is not null").select("form_key", "written_form", "msd").distinct()
    return diff.keyed_diff(rows("generated_word_forms"), rows("saldo_word_forms"), "form_key", ["written_form", "msd"])


@_query("""
WITH a AS (SELECT row_number() OVER (ORDER BY word_no) AS pos, word FROM print_vocab), b AS (SELECT row_number() OVER (ORDER BY head, head_id) AS pos, head AS word FROM head_words)
SELECT coalesce(a.pos, b.pos) AS pos, a.word AS left_value, b.word AS right_value FROM a FULL JOIN b ON a.pos = b.pos WHERE a.pos IS NULL OR b.pos IS NULL OR a.word IS DISTINCT FROM b.word""")
def positional_diff(spark, sf):
    """Two lists place by place."""
    b = table(spark, sf, "head_words").select(F.col("head").alias("word"), "head_id")
    return diff.positional_diff(table(spark, sf, "print_vocab"), b, ["word_no"], ["word", "head_id"], "word")


@_query("""
WITH a AS (SELECT lexeme_id, list_sort(list(DISTINCT written_form)) AS f FROM slot_forms WHERE written_form IS NOT NULL GROUP BY 1),
b AS (SELECT lexeme_id, list_sort(list(DISTINCT written_form)) AS g FROM generated_word_forms WHERE written_form IS NOT NULL GROUP BY 1)
SELECT lexeme_id, CASE WHEN f = g THEN 'exact' WHEN list_sort(list_distinct(list_transform(f, lambda x: lower(x)))) = list_sort(list_distinct(list_transform(g, lambda x: lower(x)))) THEN 'exact_case'
 WHEN len(list_intersect(f, g)) = len(f) THEN 'subset' ELSE 'mismatch' END AS status, len(f) - len(list_intersect(f, g)) AS missing, len(g) - len(list_intersect(f, g)) AS extra,
 CASE WHEN f = g THEN 'unchanged' WHEN len(list_intersect(f, g)) = len(f) THEN 'more' WHEN len(list_intersect(f, g)) = len(g) THEN 'fewer' ELSE 'changed' END AS change FROM a JOIN b USING (lexeme_id)""")
def set_status_ladder(spark, sf):
    """The forms of a lexeme by slots against those generated."""
    sets = lambda t, n: table(spark, sf, t).filter("written_form is not null").groupBy("lexeme_id").agg(F.collect_set("written_form").alias(n))
    j = sets("slot_forms", "f").join(sets("generated_word_forms", "g"), "lexeme_id")
    return j.select(
        "lexeme_id", diff.set_status(F.col("f"), F.col("g")).alias("status"), F.size(F.array_except("f", "g")).cast("bigint").alias("missing"),
        F.size(F.array_except("g", "f")).cast("bigint").alias("extra"), diff.change_status(F.col("f"), F.col("g")).alias("change"),
    )


@_query("""
WITH g AS (SELECT lexeme_id, bool_or(kind = 'lemma') AS has_lemma, bool_or(kind LIKE 'derived%') AS derived, bool_or(msd IS NULL) AS unmarked, count(DISTINCT msd) AS marks FROM generated_word_forms GROUP BY 1)
SELECT l.lexeme_id, CASE WHEN g.lexeme_id IS NULL THEN 'missing' WHEN has_lemma AND derived THEN 'full' ELSE 'partial' END AS coverage,
 CASE WHEN g.lexeme_id IS NULL THEN 'not_applicable' WHEN unmarked THEN 'mismatch' WHEN marks >= 6 THEN 'exact' ELSE 'acceptable' END AS paradigm FROM lexeme_slots l LEFT JOIN g USING (lexeme_id)""")
def two_axis_status(spark, sf):
    """Coverage and paradigm of each lexeme as two statuses that don't depend on each other."""
    g = table(spark, sf, "generated_word_forms").groupBy("lexeme_id").agg(
        F.bool_or(F.col("kind") == "lemma").alias("has_lemma"), F.bool_or(F.col("kind").startswith("derived")).alias("derived"),
        F.bool_or(F.col("msd").isNull()).alias("unmarked"), F.count_distinct("msd").alias("marks"), F.lit(True).alias("there"),
    )
    j = table(spark, sf, "lexeme_slots").select("lexeme_id").join(g, "lexeme_id", "left")
    gone = F.col("there").isNull()
    return j.select(
        "lexeme_id", F.when(gone, "missing").when(F.col("has_lemma") & F.col("derived"), "full").otherwise("partial").alias("coverage"),
        F.when(gone, "not_applicable").when(F.col("unmarked"), "mismatch").when(F.col("marks") >= 6, "exact").otherwise("acceptable").alias("paradigm"),
    )


@_query("""
WITH t AS (SELECT candidate_id, lexeme_id, list_distinct(regexp_extract_all(lower(article_text), '\\p{L}+')) AS a FROM match_candidates WHERE article_text IS NOT NULL),
f AS (SELECT lexeme_id, list(DISTINCT lower(written_form)) AS b FROM slot_forms WHERE written_form IS NOT NULL GROUP BY 1)
SELECT candidate_id, len(list_intersect(a, b)) AS both, round(len(list_intersect(a, b)) / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1), 6) AS jaccard FROM t JOIN f USING (lexeme_id)""")
def jaccard_overlap(spark, sf):
    """How far the words of an article overlap with the forms of its lexeme."""
    t = table(spark, sf, "match_candidates").filter("article_text is not null").select("candidate_id", "lexeme_id", F.array_distinct(T.words(F.lower("article_text"))).alias("a"))
    f = table(spark, sf, "slot_forms").filter("written_form is not null").groupBy("lexeme_id").agg(F.collect_set(F.lower("written_form")).alias("b"))
    both, any_ = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return t.join(f, "lexeme_id").select("candidate_id", both.cast("bigint").alias("both"), F.round(both / F.greatest(any_, F.lit(1)), 6).alias("jaccard"))


# ---- groups ----------------------------------------------------------------------------


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab_totals(spark, sf):
    """Counts by two keys with all totals."""
    return grouping.crosstab_with_totals(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@_query("SELECT source, count(*) AS total, CAST(sum(CAST(text IS NOT NULL AND length(text) > 100 AS INT)) AS BIGINT) AS covered, round(100.0 * sum(CAST(text IS NOT NULL AND length(text) > 100 AS INT)) / count(*), 2) AS percent FROM documents GROUP BY source")
def coverage_ratio(spark, sf):
    """The share of documents with enough text, by source."""
    return grouping.coverage(table(spark, sf, "documents"), ["source"], F.col("text").isNotNull() & (F.length("text") > 100))


@_query("""
WITH l AS (SELECT page_id, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY word_num, word_id) AS line, count(*) AS words FROM ocr_words WHERE level = '5' AND trim(coalesce(text, '')) <> '' GROUP BY ALL)
SELECT page_id, block_num, count(*) AS lines, CAST(sum(words) AS BIGINT) AS words, md5(string_agg(line, '/' ORDER BY par_num, line_num)) AS digest FROM l GROUP BY 1, 2""")
def nested_groups(spark, sf):
    """Words to lines to blocks."""
    line = ocr_words(table(spark, sf, "ocr_words")).groupBy("page_id", "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "word_id", "text"))), lambda w: w["text"]), " ").alias("line"), F.count(F.lit(1)).alias("words")
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par_num", "line_num", "line"))), lambda x: x["line"]), "/")
    return line.groupBy("page_id", "block_num").agg(F.count(F.lit(1)).alias("lines"), F.sum("words").alias("words"), F.md5(text).alias("digest"))


@_query("SELECT lemma, count(DISTINCT upper(upos)) AS k, CASE WHEN count(DISTINCT upper(upos)) = 0 THEN 'none' WHEN count(DISTINCT upper(upos)) = 1 THEN 'unique' ELSE 'multiple' END AS kind FROM lexeme_slots GROUP BY lemma")
def cardinality_classify(spark, sf):
    """Lemmas by the number of their classes."""
    return grouping.cardinality(table(spark, sf, "lexeme_slots").select("lemma", F.upper("upos").alias("u")), "lemma", "u")


@_query("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
SELECT user_id, count(*) AS members, count(DISTINCT s) <= 1 AS agree FROM s GROUP BY 1""")
def set_agreement(spark, sf):
    """Whether a user has the same types of events every day."""
    e = table(spark, sf, "events").filter("event_type is not null").select("user_id", F.to_date("ts").alias("d"), "event_type")
    return grouping.set_agreement(e, "user_id", "d", "event_type")


@_query("SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents QUALIFY rank <= 5")
def capped_examples(spark, sf):
    """The five longest documents of each source."""
    return grouping.top_per_key(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc_nulls_last("n_chars"), F.asc("doc_id")], 5)


@_query()
def stratified_sample(spark, sf):
    """Ten documents of each language, the same ones in every run."""
    return grouping.stratified_sample(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 10)


@_query("SELECT lang, place, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents JOIN (VALUES ('de', 0), ('sv', 1), ('en', 2)) l(lang, place) USING (lang) QUALIFY rank <= 4")
def fixed_strata_first_n(spark, sf):
    """The first documents of listed languages, in the order of the list."""
    return grouping.listed_strata(table(spark, sf, "documents").select("lang", "doc_id"), "lang", ["de", "sv", "en"], "doc_id", 4)


@_query("""
WITH s AS (SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS w FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2), m AS (SELECT user_id, max(w) AS w FROM s GROUP BY 1)
SELECT user_id, w, min(event_type) AS event_type, count(*) AS tied FROM s JOIN m USING (user_id, w) GROUP BY 1, 2""")
def vote_argmax(spark, sf):
    """The type of event with the largest summed value of each user."""
    return grouping.weighted_vote(table(spark, sf, "events"), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint"))


@_query("WITH s AS (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS signature FROM events WHERE event_type IS NOT NULL GROUP BY 1) SELECT signature, count(*) AS members FROM s GROUP BY 1")
def array_signature_groups(spark, sf):
    """Users by their set of event types."""
    return grouping.signature_groups(table(spark, sf, "events"), "user_id", "event_type")


@_query(f"""
SELECT source, count(DISTINCT w) AS forms, count(DISTINCT w) FILTER (WHERE k = 1) AS own FROM (SELECT DISTINCT source, w FROM {_DOC_WORDS} WHERE source IS NOT NULL)
 JOIN (SELECT w, count(DISTINCT source) AS k FROM {_DOC_WORDS} WHERE source IS NOT NULL GROUP BY 1) USING (w) GROUP BY source""")
def provenance_contribution(spark, sf):
    """Words of each source, and those no other source has."""
    w = _doc_words(spark, sf).filter("source is not null").select("source", "w").distinct()
    k = w.groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.min("source").alias("only"))
    own = k.filter("k = 1").groupBy(F.col("only").alias("source")).agg(F.count(F.lit(1)).alias("own"))
    return w.groupBy("source").agg(F.count(F.lit(1)).alias("forms")).join(own, "source", "left").select("source", "forms", F.coalesce("own", F.lit(0)).alias("own"))


@_query()
def content_digest(spark, sf):
    """A digest of the keyed forms that doesn't depend on row order."""
    return grouping.content_digest(table(spark, sf, "generated_word_forms"), ["form_key", "written_form", "msd"])


@_query("""
SELECT page_id, median(d) AS step FROM (SELECT page_id, top - lag(top) OVER (PARTITION BY page_id ORDER BY top, word_id) AS d FROM ocr_words WHERE level = '4') WHERE d IS NOT NULL GROUP BY 1""")
def median_pitch(spark, sf):
    """The typical distance of the lines of a page."""
    return grouping.median_step(table(spark, sf, "ocr_words").filter("level = '4'"), ["page_id"], ["top", "word_id"], "top")


# ---- order -----------------------------------------------------------------------------


@_query("SELECT delta, count(*) AS n FROM (SELECT event_id - lag(event_id) OVER (ORDER BY ts, event_id) AS delta FROM events) WHERE delta IS NOT NULL GROUP BY 1")
def delta_histogram(spark, sf):
    """How ids step along the order in time."""
    return ordered.delta_counts(table(spark, sf, "events").select("ts", "event_id"), [], ["ts", "event_id"], "event_id")


@_query("""
SELECT event_id, prev_event_id, gap FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
 WHERE gap IS NOT NULL ORDER BY gap DESC, event_id LIMIT 50""")
def gap_top50(spark, sf):
    """The fifty longest gaps between events of a user."""
    e = ordered.with_previous(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], ["ts", "event_id"])
    gap = F.timestamp_diff("MICROSECOND", "prev_ts", "ts")
    return e.select("event_id", "prev_event_id", gap.alias("gap")).filter("gap is not null").orderBy(F.desc("gap"), "event_id").limit(50)


@_query("""
WITH d AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM d)
SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2""")
def islands(spark, sf):
    """Events of a user at most six hours apart."""
    apart = F.timestamp_diff("MICROSECOND", "prev_ts", "ts") > 6 * 3600 * 1_000_000
    i = ordered.islands(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], apart)
    return i.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))


@_query("""
WITH d AS (SELECT user_id, ts, event_id, event_type, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM d), c AS (SELECT user_id, run, event_type, count(*) AS len FROM r GROUP BY 1, 2, 3)
SELECT event_type, len, count(*) AS runs FROM c GROUP BY 1, 2""")
def run_lengths(spark, sf):
    """How long runs of one type of event are."""
    r = ordered.runs(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    c = r.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("len"))
    return c.groupBy("event_type", "len").agg(F.count(F.lit(1)).alias("runs"))


@_query("""
SELECT from_value, to_value, count(*) AS n FROM (SELECT lag(event_type) OVER w AS from_value, event_type AS to_value, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r > 1 GROUP BY 1, 2""")
def transitions(spark, sf):
    """Which type of event follows which."""
    return ordered.transitions(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@_query("""
SELECT lexeme_id, coalesce(last_value(CASE WHEN homonr <> '0' THEN homonr END IGNORE NULLS) OVER (PARTITION BY head_id ORDER BY lexeme_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 first_value(CASE WHEN homonr <> '0' THEN homonr END IGNORE NULLS) OVER (PARTITION BY head_id ORDER BY lexeme_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS anchor FROM lexeme_slots""")
def anchor_nearest(spark, sf):
    """The nearest numbered homonym before a row of its head, else after it."""
    l = table(spark, sf, "lexeme_slots").select("head_id", "lexeme_id", "homonr")
    return ordered.nearest_anchor(l, ["head_id"], ["lexeme_id"], F.when(F.col("homonr") != "0", F.col("homonr")), "anchor").select("lexeme_id", "anchor")


@_query("""
SELECT word_id, lead(text) OVER (PARTITION BY page_id ORDER BY word_id) AS next_text FROM ocr_words WHERE level = '5'""")
def entry_and_next(spark, sf):
    """Every word with the one after it on its page."""
    w = table(spark, sf, "ocr_words").filter("level = '5'").select("page_id", "word_id", "text")
    return with_next(w, ["page_id"], ["word_id"], ["text"]).select("word_id", "next_text")


@_query("""
WITH w AS (SELECT candidate_id, regexp_extract_all(lower(article_text), '\\p{L}+') AS a FROM match_candidates WHERE article_text IS NOT NULL),
g AS (SELECT unnest(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS gram FROM w WHERE len(a) > 2)
SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1""")
def ngram_windows(spark, sf):
    """Word triples that occur more than once."""
    a = table(spark, sf, "match_candidates").filter("article_text is not null").select(T.words(F.lower("article_text")).alias("a")).filter(F.size("a") > 2)
    g = a.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("a") - 2), lambda i: F.array_join(F.slice("a", i, 3), " "))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


_IV = "SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, CAST(epoch_us(l_shipdate) AS BIGINT) AS lo, CAST(epoch_us(l_shipdate) AS BIGINT) + CAST(l_quantity AS BIGINT) * 86400000000 AS hi FROM lineitem"


@_query(f"""
WITH i AS ({_IV}) SELECT l_suppkey, id FROM (SELECT l_suppkey, id, hi, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i) WHERE reach >= hi""")
def range_containment(spark, sf):
    """Stretches of shipping that lie within another of the supplier."""
    li = table(spark, sf, "lineitem")
    lo = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("l_shipdate").cast("timestamp_ntz"))
    i = li.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), lo.alias("lo"), (lo + F.col("l_quantity").cast("bigint") * 86_400_000_000).alias("hi"))
    return ordered.contained_in(i, "l_suppkey", "lo", "hi", "id")


# ---- notation --------------------------------------------------------------------------


@_query("""
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(notation, '</?[^>]+>', '', 'g'), '\\s*\\[[^\\]]*\\]', '', 'g'),
 '(^|[^\\p{L}\\p{N}])(\\p{L}+\\.)([+-])', '\\1\\2 \\3', 'g'), '(^|\\s)-\\s+([\\p{L}\\p{N}])', '\\1-\\2', 'g'), '\\s+', ' ', 'g')), '(?i)([;,]|[+-][^\\s;,_]*|[^\\s;,+_]+)')) AS token FROM lexeme_slots WHERE notation IS NOT NULL) GROUP BY 1""")
def notation_tokens(spark, sf):
    """Tokens of the notations and how often they occur."""
    n = table(spark, sf, "lexeme_slots").filter("notation is not null").select(notation.token_array(notation.clean_notation(F.col("notation"))).alias("t"))
    return n.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@_query()
def notation_forms(spark, sf):
    """The forms the notations give, slot by slot."""
    return notation.slot_forms(table(spark, sf, "lexeme_slots"), "lexeme_id", "lemma", "upos", "notation", "stycke")


@_query()
def noun_paradigms(spark, sf):
    """Noun forms with lemma, genitives and definite plurals added."""
    nouns = table(spark, sf, "lexeme_slots").filter("upper(upos) = 'NOUN'")
    return notation.complete_nouns(notation.slot_forms(nouns, "lexeme_id", "lemma", "upos", "notation", "stycke"), nouns, "lexeme_id", "lemma")


@_query()
def optimal_assignment(spark, sf):
    """Homonyms of a lemma and entries of that lemma, one to one, by their forms."""
    lex = table(spark, sf, "lexeme_slots").select("lexeme_id", F.lower("lemma").alias("lemma")).filter("lemma is not null")
    f = table(spark, sf, "slot_forms").filter("written_form is not null").groupBy("lexeme_id").agg(F.collect_set("written_form").alias("f"))
    e = table(spark, sf, "saldo_analyses").select("entry_id", F.lower(F.element_at("lemmas", -1)).alias("lemma"), F.array_compact(F.transform("word_forms", lambda x: x["form"])).alias("g")).filter("lemma is not null")
    return match.assign_within(lex.join(f, "lexeme_id"), e, "lemma", "lexeme_id", "entry_id", "f", "g")


@_query()
def word_alignment(spark, sf):
    """The words of a page and of its second reading, aligned in order."""
    r = ocr_words(table(spark, sf, "ocr_words")).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "text"))), lambda w: w["text"]).alias("b"))
    p = table(spark, sf, "runeberg_pages").filter("text is not null").select("page_id", F.split(F.trim("text"), r"\s+").alias("a"))
    return match.align_tokens(p.join(r, "page_id"), "page_id", "a", "b")
