import json

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from lexloom import sources, streaming
from lexloom.operators import notation, ocr, relational
from lexloom.sources import sinks

NOUNS = [
    ("+en +ar", [("sg_def", "bilen"), ("pl_indef", "bilar")]),
    ("+et; pl. +", [("sg_def", "bilet"), ("pl_indef", "bil")]),
    ("+en el. +et", [("sg_def", "bilen"), ("sg_def", "bilet")]),
    ("+(e)n", [("sg_def", "biln"), ("sg_def", "bilen")]),
    ("+en best. pl. +arna", [("sg_def", "bilen"), ("pl_def", "bilarna")]),
    ("+en _ +ar", [("sg_def", "bilen"), ("sg_def", "bilar")]),
    ("pl.+ar [uttal]", [("pl_indef", "bilar")]),
    ("el. +en", None), ("", None), ("(null)", None), (None, None),
    ("+en pl.", None), ("+en okänd. +ar", [("sg_def", "bilen"), ("pl_indef", "bilar")]), ("+en = +ar", None),
]


@pytest.mark.parametrize("text,want", NOUNS)
def test_noun_slots(spark, text, want):
    df = spark.createDataFrame([(1, "bil", "NOUN", text, "bil")], "id int, lemma string, upos string, notation string, stycke string")
    got = sorted((r.slot, r.written_form) for r in notation.slot_forms(df, "id", "lemma", "upos", "notation", "stycke").collect())
    assert got == sorted(want or [])


@pytest.mark.parametrize("cls,text,want", [
    ("VERB", "-ade -at pres. -ar", [("preterite", "kastade"), ("supine", "kastat"), ("present", "kastar")]),
    ("ADJ", "+t +a komp. +are", [("neuter", "kastt"), ("definite_or_plural", "kasta"), ("comparative", "kastare")]),
    ("ADJ", "best.", [("definite_or_plural", "kast")]),
    ("ADJ", "+t +a", [("neuter", "kastt"), ("definite_or_plural", "kasta")]), ("ADJ", "+t +a +are +ast", [("neuter", "kastt"), ("definite_or_plural", "kasta"), ("comparative", "kastare"), ("superlative", "kastast")]),
    ("ADJ", "kasta", [("definite_or_plural", "kasta")]), ("ADJ", "+t +are h +aare", [("neuter", "kastt"), ("comparative", "kastare"), ("comparative", "kastaare")]), ("ADJ", "+t pl. +a el. +e", [("neuter", "kastt"), ("definite_or_plural", "kasta"), ("definite_or_plural", "kaste")]),
    ("ADJ", "+t +are +ast best. +e pl. +a", [("neuter", "kastt"), ("comparative", "kastare"), ("superlative", "kastast"), ("masculine_definite", "kaste"), ("definite_or_plural", "kasta")]),
    ("VERB", "kastade", [("explicit_form", "kastade")]), ("VERB", "+de +t", [("preterite", "kastade"), ("supine", "kastat")]), ("VERB", "pres.", [("present", "kasta")]), ("VERB", "+de högt. +t sup. +t", [("preterite", "kastade"), ("supine", "kastat")]),
    ("PRON", "gen. +s", [("genitive", "kasts")]), ("NUM", "ordn. +nde", [("ordinal", "kastnde")]), ("ADV", "komp. +re superl. +st", [("comparative", "kastre"), ("superlative", "kastst")]), ("PART", "-", []), ("DET", "n. +t pl. +a", [("neuter_singular", "kastt"), ("plural", "kasta")]),
])
def test_other_classes(spark, cls, text, want):
    base = "kasta" if cls == "VERB" else "kast"
    df = spark.createDataFrame([(1, base, cls, text, "kast|a")], "id int, lemma string, upos string, notation string, stycke string")
    assert sorted((r.slot, r.written_form) for r in notation.slot_forms(df, "id", "lemma", "upos", "notation", "stycke").collect()) == sorted(want)


def test_truncated_notation_and_tails(spark):
    text = "+en +ar best. pl. +arna el. vard. pl. något annat " + "x" * 3
    df = spark.createDataFrame([(text[:50],)], "t string")
    assert len(text[:50]) == 50 and df.select(notation.clean_notation(F.col("t"), 50)).first()[0] == "+en +ar best. pl. +arna el. vard. pl. något"
    r = spark.createDataFrame([("kliva", "ivor", None), ("kliva", "or", "kliv"), ("kliva", "or", None)], "b string, t string, p string")
    assert [x[0] for x in r.select(notation.replace_tail(F.col("b"), F.col("t"), F.col("p"))).collect()] == ["klivor", "klivor", None]


def test_cut_notation_is_read_as_far_as_it_goes(spark):
    text = "+en +ar; pl. best. +arna el. +erna _ " + "x" * 13
    assert len(text) == 50
    df = spark.createDataFrame([(1, "bil", "NOUN", text, "bil")], "id int, lemma string, upos string, notation string, stycke string")
    got = {(r.slot, r.written_form) for r in notation.slot_forms(df, "id", "lemma", "upos", "notation", "stycke", 50).collect()}
    assert got == set() or ("sg_def", "bilen") in got
    df = spark.createDataFrame([(1, "bil", "NOUN", ("+en +ar best. pl. +arna = " + "y" * 40)[:50], "bil")], df.schema)
    assert {(r.slot, r.written_form) for r in notation.slot_forms(df, "id", "lemma", "upos", "notation", "stycke", 50).collect()} == {("sg_def", "bilen"), ("pl_indef", "bilar"), ("pl_def", "bilarna")}


def test_noun_completion(spark):
    df = spark.createDataFrame([(1, "bil", "NOUN", "+en +ar", "bil"), (2, "hus", "NOUN", "+et +", "hus")], "id int, lemma string, upos string, notation string, stycke string")
    out = notation.complete_nouns(notation.slot_forms(df, "id", "lemma", "upos", "notation", "stycke"), df, "id", "lemma")
    got = {(r.id, r.msd): r.written_form for r in out.collect()}
    assert got[1, "pl def nom"] == "bilarna" and got[1, "pl def gen"] == "bilarnas" and got[2, "pl def nom"] == "husen" and got[2, "sg indef gen"] == "hus"


RAW = [
    ("flöm", "1", "s.", "flöm", 10, 1, "+n", "NOUN", "flöm", 0), ("flöm", "0", "s.", "flöhm", 10, 1, "+n", "NOUN", "flöhm", 1),
    ("flöm", "1", "(hv) s.", None, 20, 1, None, "NOUN", "flöhm", 2), ("brå", "1", "v.", "brå", 30, 1, "", "VERB", "brå", 3), ("brå", "2", "adj.", "brå", 30, 1, "", "ADJ", "brå", 4),
    ("brå", "0", "adj.", "bråå", 30, 1, "", "ADJ", "bråå", 5), ("brå", "2", "(HV) komp.", None, 40, 1, None, "ADJ", "brårre", 6),
]


def test_relations_lose_no_row(spark):
    df = spark.createDataFrame([(n, h, o, s, l, b, t, u, w, i) for n, h, o, s, l, b, t, u, w, i in RAW], "normaliserat_ord string, homonr string, ordkl string, stycke string, urspr_lopnr long, subnr long, text string, upos string, ord string, row_idx long").withColumn("source", F.lit("x"))
    rel = relational.materialize(df)
    assert rel["headings"].count() + rel["references"].count() == len(RAW)
    assert sorted(r.article_id for r in rel["articles"].collect()) == ["10:1:1", "30:1:1", "30:1:2"]
    assert sorted((r.heading, r.heading_type) for r in rel["headings"].filter("article_id = '10:1:1'").collect()) == [("flöhm", "alternate"), ("flöm", "primary")]
    assert [r.lemma for r in rel["unresolved"].collect()] == ["brå"]
    assert sorted(r.reference_type for r in rel["references"].collect()) == ["inflection_reference", "plain_reference"]
    assert rows(relational.integrity(rel["headings"].filter("article_id <> ''"), rel["articles"], "article_id", "article_id")) == []


def test_jsonl_round_trip(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"normaliserat_ord": "a", "subnr": 1}\n\n  \n{"normaliserat_ord": "b"}\n', encoding="utf-8")
    df = sources.read_jsonl(spark, str(p))
    assert sorted((r.normaliserat_ord, r.subnr, r.row_idx) for r in df.collect()) == [("a", 1, 0), ("b", None, 3)]
    sinks.write_jsonl(df.select("subnr", "normaliserat_ord"), str(tmp_path / "out"))
    lines = [x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(json.loads(x)["normaliserat_ord"] for x in lines) == ["a", "b"] and all(x.startswith('{"normaliserat_ord"') for x in lines)
    p.write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        sources.read_jsonl(spark, str(p)).collect()


def test_lmf_and_tables(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        '<LexicalResource xmlns="urn:x"><Lexicon><LexicalEntry id="hög..av.1"><Lemma><FormRepresentation><feat att="writtenForm" val="hög"/></FormRepresentation></Lemma>'
        '<WordForm><feat att="writtenForm" val="högre"/><feat att="msd" val="komp nom"/></WordForm><WordForm><feat att="writtenForm" val="hög-"/><feat att="msd" val="sms"/></WordForm></LexicalEntry></Lexicon></LexicalResource>', encoding="utf-8")
    x = spark.read.format("xml").option("rowTag", "LexicalEntry").option("attributePrefix", "_").schema(sources.LMF).load(str(tmp_path / "s.xml"))
    flat = sources.flatten_lmf(x).first()
    assert (flat.entry_id, flat.upos, flat.lemmas) == ("hög..av.1", "av", ["hög"])
    assert [f.form for f in sources.flatten_lmf(x).select(sources.standalone("word_forms").alias("f")).first().f] == ["högre"]
    (tmp_path / "w.tsv").write_text('level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t90.5\t"hej\n4\t1\t1\t1\t1\t0\t0\t0\t1\t1\t-1\t\n')
    assert [r.text for r in sources.read_tsv_words(spark, str(tmp_path / "w.tsv")).collect()] == ['"hej']


def test_guarded_write_profile_and_ids(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", None)], "w string, n int")
    assert not sinks.write_if_equal(a, a.limit(1), str(tmp_path / "no")) and sinks.write_if_equal(a, a, str(tmp_path / "yes"))
    assert {r.field: r.nulls for r in sources.profile(a).collect()} == {"w": 0, "n": 1}
    new = sinks.append_with_ids(a.select("w"), spark.createDataFrame([(7,)], "id long"), "id", "w")
    assert sorted((r.id, r.w) for r in new.collect()) == [(8, "x"), (9, "y")]
    sinks.write_sorted_list(a, "w", str(tmp_path / "list"))
    assert json.loads(sinks.summary(a))["rows"] == 2


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 10:00:00", "s1"), ("a", "2024-01-01 10:05:00", "s2"), ("a", "2024-01-01 10:05:00", "s2"), ("b", "2024-01-01 13:00:00", "s1")], "w string, t string, s string").selectExpr("w", "cast(t as timestamp) t", "s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("w string, t timestamp, s string").parquet(str(tmp_path / "in"))
    for name, df, n in (("u", streaming.first_union_stream(stream, "w", "t", ["s"]), 2), ("s", streaming.session_stream(stream, "w", "t"), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
    q = streaming.deduplicated_stream(stream, ["w", "s"], "t").writeStream.format("memory").queryName("d").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("d").count() == 3


def test_raster_to_text(spark):
    glyph = {"T": [(0, 0), (1, 0), (2, 0), (1, 1), (1, 2)], "I": [(0, 0), (0, 1), (0, 2)]}
    page = np.full((8, 14), 255, np.uint8)
    for label, x in (("T", 1), ("I", 6), ("T", 9)):
        for dx, dy in glyph[label]:
            page[2 + dy, x + dx] = 0
    df = spark.createDataFrame([(1, 14, 8, bytearray(page.tobytes()))], "page long, width int, height int, pixels binary")
    ink = ocr.ink_pixels(df)
    assert ink.count() == 13 and rows(ocr.row_bands(ink)) == [(1, 1, 2, 5)]
    assert [(r.left, r.right) for r in ocr.components(df).orderBy("left").collect()] == [(1, 4), (6, 7), (9, 12)]
    assert {r.y: r.left for r in ocr.left_profile(ink).collect()} == {2: 1, 3: 2, 4: 2}
    widths = spark.createDataFrame([("T", 3), ("I", 1)], "label string, width int")
    chosen = ocr.disjoint_row(ocr.exact_placements(df, glyph), widths)
    assert rows(ocr.row_text(chosen)) == [(1, 2, "TIT")]
