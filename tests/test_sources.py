"""Readers and sinks on small files."""

import hashlib

import pytest

from lexloom.sources import lexicon, sinks

XML = (
    '<LexicalResource xmlns="urn:x"><Lexicon><LexicalEntry id="hög..av.1"><Lemma><FormRepresentation><feat att="writtenForm" val="hög"/></FormRepresentation></Lemma>'
    '<WordForm><feat att="writtenForm" val="Högre"/><feat att="msd" val="komp nom"/></WordForm><WordForm><feat att="writtenForm" val="högre"/><feat att="msd" val="komp"/></WordForm></LexicalEntry>'
    '<LexicalEntry id="b..nn.1"><WordForm><feat att="writtenForm" val="bad"/></WordForm><WordForm><feat att="writtenForm" val="ack"/></WordForm></LexicalEntry></Lexicon></LexicalResource>'
)


def test_lmf_readings(spark, tmp_path):
    from lexloom.sources import LMF

    (tmp_path / "s.xml").write_text(XML, encoding="utf-8")
    e = spark.read.format("xml").option("rowTag", "LexicalEntry").option("attributePrefix", "_").schema(LMF).load(str(tmp_path / "s.xml"))
    assert sorted((r.entry_id, r.lemma, r.forms) for r in lexicon.all_written_forms(e).collect()) == [("b..nn.1", "ack", ["ack", "bad"]), ("hög..av.1", "hög", ["Högre", "hög", "högre"])]
    assert {r.form: r.labels for r in lexicon.form_labels(e).collect()} == {"högre": ["komp", "komp nom"], "bad": [], "ack": []}


def test_delimited_and_one_record(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('a\tn\n"x\t1\ny\tq\n', encoding="utf-8")
    df = lexicon.read_delimited(spark, str(tmp_path / "t.tsv"), "a STRING, n INT")
    assert sorted((r.a, r.n) for r in df.collect()) == [('"x', 1), ("y", None)]
    d = spark.createDataFrame([(3, "k"), (1, "k"), (2, "l"), (0, None)], "i int, k string")
    assert [r.i for r in lexicon.one_record(d, "k", "k", "i").collect()] == [1] and lexicon.one_record(d, "k", "none", "i").count() == 0


def test_fetch(tmp_path):
    (tmp_path / "a").write_bytes(b"hej" * 1000)
    target = str(tmp_path / "b")
    assert lexicon.fetch((tmp_path / "a").as_uri(), target) == hashlib.sha256(b"hej" * 1000).hexdigest()
    with pytest.raises(FileExistsError):
        lexicon.fetch((tmp_path / "a").as_uri(), target)
    with pytest.raises(OSError):
        lexicon.fetch((tmp_path / "missing").as_uri(), str(tmp_path / "c"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_replace_table_of_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_content_sha(spark):
    a = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    assert sinks.content_sha(a) == sinks.content_sha(a.orderBy("i", ascending=False).repartition(3).select("s", "i")) != sinks.content_sha(a.distinct())
    assert len(sinks.content_sha(a.limit(0))) == 64


def test_sample_page(spark):
    a = spark.createDataFrame([("g", f"<w{i}>", i) for i in range(9)] + [(None, "x", 1)], "g string, w string, i int")
    page = sinks.sample_page(a, "g", "w", "i", 2)
    assert page.count("<p>") == 3 and "&lt;w0&gt;" in page and "<w0>" not in page and "&lt;w2&gt;" not in page
