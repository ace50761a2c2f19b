"""Word classes, paradigms and evidence on small fixtures, with nulls, empty tables and ties."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lexloom.functions import lexical as L
from lexloom.operators import evidence as E
from lexloom.operators import paradigm as P


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize("head,want", [
    ("s.", ["NOUN"]), ("adv. och adj. <i>+t</i>", ["ADJ", "ADV"]), ("V.", ["VERB"]), ("best. artikel", ["DET"]), ("adverbiellt", ["ADV"]), ("konj. samordnande", ["CCONJ"]), ("namn s.", ["NOUN", "PROPN"]), ("", []), (None, []), ("xs.", []),
])
def test_classes_of_head(spark, head, want):
    assert one(spark, head, lambda c: L.classes_of_record(c, F.lit(None).cast("string"))) == want


@pytest.mark.parametrize("head,code,want", [("adv. och adj.", None, "ADV"), ("s. pl.", None, "NOUN"), ("", " noun ", "NOUN"), (None, None, ""), ("pron. adj.", None, "PRON")])
def test_one_class(spark, head, code, want):
    assert one(spark, head, lambda c: L.one_class(c, F.lit(code).cast("string"))) == want


@pytest.mark.parametrize("word,note,want", [("-lunga", None, True), ("lunga-", None, True), ("lunga", "slutled", True), ("lunga", "i sms.", True), ("lunga", "s.", False), (None, None, False)])
def test_affix(spark, word, note, want):
    assert one(spark, word, lambda c: L.is_affix(F.lit(note).cast("string"), c)) is want


@pytest.mark.parametrize("text,want", [("+en [x] , +ar", "+en, +ar"), ("(null)", None), (None, None), ("  +n   -or ; ", "+n -or;"), ("[x]", None)])
def test_normal_pattern(spark, text, want):
    assert one(spark, text, L.normal_pattern) == want


@pytest.mark.parametrize("text,want", [("+en +ar", True), ("-or", False), ("+n; -or", True), ("+en el. +n", False), ("+en _ +n", False), ("+en [k]", False), ("flunga +n", False), ("", False), (None, False)])
def test_simple_relative(spark, text, want):
    assert one(spark, text, L.simple_relative) is want


@pytest.mark.parametrize("form,lemma,want", [("till freds", "x", "several_words"), ("freds", "till freds", "part_of_lemma"), ("fred", "till freds", "standalone"), ("", "a b", "empty"), (None, None, "empty"), ("a", "a", "standalone")])
def test_context(spark, form, lemma, want):
    assert one(spark, form, lambda c: L.context_of_form(c, F.lit(lemma).cast("string"))) == want


def test_keys_and_splits(spark):
    assert one(spark, "Flö‖sk¦a [x] –", L.reading_key) == "flöska -" and one(spark, "Flö‖sk¦a", L.structure_key) == "flö|sk·a"
    assert tuple(one(spark, "flö·sk|bryn", lambda c: L.verified_split(c, F.lit("flöskbryn")))) == ("flösk", "bryn")
    assert one(spark, "flösk|bryn", lambda c: L.verified_split(c, F.lit("annat"))) is None and one(spark, "x", lambda c: L.verified_split(c, c)) is None
    assert one(spark, "flöskbrynet", lambda c: L.restored_bar(c, F.lit("flösk|bryn"))) == "flösk|brynet" and one(spark, "annat", lambda c: L.restored_bar(c, F.lit("flösk|bryn"))) == "annat"
    assert one(spark, "FlÖ ", L.game_word) == "flö" and one(spark, "a", L.game_word) is None and one(spark, "a-b", L.game_word) is None


@pytest.mark.parametrize("text,want", [
    ("flev, flivit, fliven flivet flivna, pres. fliver", ["fliven", "flivet", "flivna"]), ("flev, flivit, pres. fliver", None), ("flev, flivit, fliven flivet flivna pres. x", None), ("a, b, c (d) e, pres. x", None), (None, None), ("", None),
])
def test_participles(spark, text, want):
    assert one(spark, text, P.participle_tokens) == want


LEX, SLOT = "id int, lemma string, notation string, head int", "id int, slot string, written_form string"


def test_verbs(spark):
    lex = spark.createDataFrame([(1, "flana", "+de +t", 1), (2, "flana", "+de, +t", 1), (3, "bräma", None, 1), (4, None, None, None), (5, "gno", None, 1)], LEX)
    forms = spark.createDataFrame(
        [(i, s, f) for i in (1, 2) for s, f in (("pret", "flanade"), ("sup", "flanat"), ("pret", "flanade"))] + [(3, "pret", "brämde"), (3, "sup", "brämt"), (4, None, None), (5, "pret", "gnodde")], SLOT
    )
    out = P.expand_verbs(forms, lex, "id", "lemma", "notation").collect()
    got = {i: {(r.slot, r.written_form) for r in out if r.id == i} for i in (1, 2, 3)}
    assert got[2] == {("pres", "flanar"), ("imper", "flana")} and got[3] == {("pres", "brämer"), ("imper", "bräm")}
    assert len(got[1]) == 10 and {("part_pres", "flanande"), ("part_perf_u", "flanad"), ("pret_passive", "flanades"), ("sup_passive", "flanats")} <= got[1] and len(out) == 14
    assert P.expand_verbs(forms.limit(0), lex.limit(0), "id", "lemma", "notation").count() == 0


def test_adjectives_and_names(spark):
    forms = spark.createDataFrame([(1, "pos_n", "grönt"), (1, "pos_pl", "gröna"), (1, "superl", "grönast"), (2, "superl", "störst"), (2, "pos_pl", "stora"), (3, "pres", "går"), (3, None, None)], SLOT)
    assert rows(P.expand_adjectives(forms, "id")) == [(1, "masc", "gröne"), (1, "superl_def", "grönaste"), (2, "superl_def", "största"), (2, "superl_masc", "störste")]
    assert rows(P.active_names(forms, "id")) == [(3, "pres_active", "går", "active:pres")]


def test_family_forms(spark):
    lex = spark.createDataFrame([(1, "aflö", "", 7), (2, "bflö", "", 7), (3, "cflö", "", 7), (4, "d", "", None), (5, None, "", 7)], LEX)
    forms = spark.createDataFrame([(1, "sg", "aflön"), (2, "sg", "bflön"), (1, "pl", "aflöar"), (2, "pl", "bflöor"), (3, "pl", "cflöar"), (5, "sg", "x")], SLOT)
    assert rows(P.family_forms(forms, lex, "id", "lemma", "head")) == [(3, "sg", "cflön")]


def test_attested_forms(spark):
    lex = spark.createDataFrame([(1, "flana", None, 1), (2, None, None, 1)], LEX)
    forms = spark.createDataFrame([(1, "pres", "flanar")], SLOT)
    e = spark.createDataFrame([("b", "flana", "flanat"), ("a", "flana", "flanat "), ("a", "flana", "flanar"), ("a", "flana", "flan-"), ("a", "flana", None), ("c", None, "x")], "entry_id string, lemma string, form string")
    assert rows(P.attested_forms(forms, lex, "id", "lemma", e)) == [(1, "flanat", "a,b")]


def test_unique_ladder(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, k string")
    right = spark.createDataFrame([("a", None, "x"), ("a", None, "y"), ("b", None, "x"), ("b", None, "y"), (None, "b", "z"), (None, "a", "z")], "k1 string, k2 string, v string")
    got = rows(E.unique_ladder(left, right, "id", "v", [("one", F.col("k"), F.col("k1"), True), ("two", F.when(F.col("k") == "b", F.col("k")), F.col("k2"), False), ("three", F.col("k"), F.col("k1"), False)]))
    assert got == [(1, "three", None, 2), (2, "two", "z", 1)]


def test_head_outcomes(spark):
    parts = spark.createDataFrame([(1, "fäst", "NOUN"), (2, "fäst", "VERB"), (3, "bryn", None), (4, "form", "NOUN"), (5, "x", "NOUN"), (6, None, None)], "id int, h string, c string")
    lemmas = spark.createDataFrame([("fäst", "a", "NOUN"), ("fäst", "b", "ADJ"), ("bryn", "c", "NOUN")], "key string, entry_id string, cls string")
    forms = spark.createDataFrame([("form", "d", "NOUN"), ("form", "e", "NOUN"), ("fäst", "q", "VERB")], "key string, entry_id string, cls string")
    got = {r.id: (r.outcome, r.candidates) for r in E.head_outcomes(parts, "id", "h", "c", lemmas, forms).collect()}
    assert got == {1: ("unique_same_class", 1), 2: ("multiple_class_mismatch", 2), 3: ("unique_class_mismatch", 1), 4: ("multiple_same_class", 2), 5: ("none", 0), 6: ("none", 0)}


def test_reasons_and_places(spark):
    d = spark.createDataFrame([("flöja", "flöjja"), ("brämen", "bräma"), ("kvitt", "annat"), (None, "x")], "f string, t string")
    assert [r.x for r in d.select(E.miss_reason(F.col("f"), F.col("t")).alias("x")).collect()] == ["other_spelling", "inflection", "unknown", "unknown"]
    words = spark.createDataFrame([(1, 5), (1, 10), (1, 11), (2, 1), (3, 4)], "p int, v int")
    marks = spark.createDataFrame([(1, 5), (1, 11), (2, 9)], "p int, v int")
    assert rows(E.place_among(words, marks, ["p"], "v", "n")) == sorted([(1, 5, 1), (1, 10, 1), (1, 11, 2), (2, 1, 0), (3, 4, 0)], key=repr)
    assert E.place_among(words.limit(0), marks.limit(0), ["p"], "v", "n").count() == 0
    s = spark.createDataFrame([(1, "a", "0"), (2, "a", "2"), (3, "b", None), (4, None, "1")], "id int, l string, h string")
    assert rows(E.numbered_siblings(s, "id", ["l"], "h")) == [(1, True), (2, True), (3, False), (4, False)]


def test_pipeline(spark):
    from lexloom.plans.pipeline import Step, run

    double = Step("double", lambda t: {"b": t["a"].selectExpr("id * 2 AS id")}, write=True, gate=lambda t: t["b"].count() == t["a"].count())
    total = Step("total", lambda t: {"c": t["b"].agg(F.sum("id").alias("s"))})
    assert run([double, total], {"a": spark.range(4)})["c"].first().s == 12
    with pytest.raises(ValueError, match="again"):
        run([double, double], {"a": spark.range(1)})
    with pytest.raises(RuntimeError, match="gate after none"):
        run([Step("none", lambda t: {}, gate=lambda t: False)], {})


@pytest.mark.parametrize("base,token,bar,want", [("kliva", "+", None, "kliva"), ("kliva", "+n", None, "klivan"), ("kliva", "-ivor", None, "klivor"), ("kliva", "klev", None, "klev"), ("kliva", "-or", "kliv", "klivor"), ("kliva", None, None, None), (None, "+n", None, None)])
def test_replay(spark, base, token, bar, want):
    from lexloom.operators import notation as N

    assert one(spark, base, lambda c: N.replayed_form(c, F.lit(token).cast("string"), F.lit(bar).cast("string"))) == want


def test_words_of_a_base(spark):
    from lexloom.operators import notation as N

    assert one(spark, "flana på", lambda c: N.imperative(c)) == "flan på" and one(spark, "gå", N.imperative) == "gå" and one(spark, None, N.imperative) is None
    assert one(spark, "stor flunga", lambda c: N.component_tail(c, F.lit("lungor"))) == "stor flungor" and one(spark, "stor flunga", lambda c: N.component_tail(c, F.lit("gor"))) is None
    assert one(spark, "tv-flunga", lambda c: N.on_word(c, "last", lambda w: F.upper(w))) == "tv-FLUNGA"
    p = one(spark, "pl def 1:2-3 nom", L.description_parts)
    assert (p.grammar, p.paradigm) == (["pl", "def", "nom"], ["1:2-3"])
    assert one(spark, "a <k>", lambda c: L.known_error({"w": "a <k>"}, F.lit("w"), c)) is True and one(spark, None, lambda c: L.known_error({"w": "a"}, F.lit("w"), c)) is False
