import random

import numpy as np
import pytest

from lexloom.llm import matching as M


@pytest.mark.parametrize("a,b", [("Hög|land", "hog-land"), ("crofevisnusc", "krofevisnusk"), ("dyniknefaest", "dyniknefäst"), ("slåt (1)", "SLÅT"), ("kökräböspöw", "kökräböspöv"), ("x [pl.]", "x")])
def test_fold_name(a, b):
    assert M.fold_name(a) == M.fold_name(b)


def test_particles_and_nulls():
    assert M.fold_name("kliva på", frozenset({"på"})) == "kliva" and M.fold_name("kliva på") == "klivapa" and M.fold_name(None) == ""


@pytest.mark.parametrize("a,b,want", [("abc", "abc", 0), ("abc", "abd", 1), ("abc", "ab", 1), ("abcd", "acbd", 1), ("abcd", "dcba", 2), ("a", "abc", 2)])
def test_near(a, b, want):
    assert M._near(a, b) == want == M._near(b, a)


def _name(rng):
    return "".join(rng.choice(["ba", "dö", "fri", "kå", "smy", "tvä", "plo", "gre"]) for _ in range(4)) + rng.choice(["fäst", "kliva", "spöv"])


def _lexemes(spark, names):
    rows = [(i, n, n, "NOUN", [n + "en", n + "ar"]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "lexeme_id long, name string, raw string, cls string, forms array<string>")


NO_VIEWS = "entry_id string, name string, cls string, forms array<string>"


def _found(spark, names, asked, space):
    frame = spark.createDataFrame([(x, True) for x in asked], "name string, asked boolean")
    return {(r.left_name, r.right_name) for r in M.name_pairs(_lexemes(spark, names), frame, space).collect()}


def test_recall_of_tables_against_brute_force(spark):
    rng = random.Random(1)
    names = sorted({M.fold_name(_name(rng)) for _ in range(600)})
    wrong = []
    for w in names[:200]:
        i = rng.randrange(1, len(w))
        wrong.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :]]))
    asked = sorted({*wrong, *names[200:250]} - {""})
    space = M.fit_space(_lexemes(spark, names), spark.createDataFrame([], NO_VIEWS))
    got = _found(spark, names, asked, space)
    # a name that has an equal one isn't searched any further
    want = {(a, b) for a in names for b in asked if (M._near(a, b) == 0 if b in names else M._near(a, b) == 1)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_trained_vectors_carry_the_recall(spark):
    """On the lexemes and entries of the tables: trained vectors hold single errors, random ones in the same tables don't."""
    sf = "/root/testdata/sf0.01"
    lex, slots, ent = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lexeme_slots", "slot_forms", "saldo_analyses"))
    particles = M._particles(lex)
    views = M.entry_views(ent, M.suffix_rules(ent, particles), particles).cache()
    lexemes = M.lexeme_views(lex, slots, particles).filter("name <> ''").cache()
    names = {r.name for r in lexemes.select("name").distinct().collect()}
    asked = {r.name for r in views.filter("kind = 'lemma' and name <> ''").select("name").distinct().collect()} - names
    want = {(a, b) for a in names for b in asked if abs(len(a) - len(b)) < 2 and M._near(a, b) == 1}
    trained, random_ = M.fit_space(lexemes, views), M.fit_space(lexemes, views, trained=False)
    random_.tables = trained.tables
    recall = [len(_found(spark, sorted(names), sorted(asked), s) & want) / len(want) for s in (trained, random_)]
    assert len(want) > 50 and recall[0] >= 0.95 and recall[1] < recall[0] - 0.08, recall


def test_signatures_agree_for_equal_names():
    space = M.NameSpace(np.random.default_rng(0).normal(size=(M.TOKENS, M.SIZE)), np.zeros(M.SIZE), 20, 3)
    a, b = (space.vectors([w]) for w in ("flibrafäst", "flibrafäst"))
    assert (space.signatures(a, 2) == space.signatures(b, 2)).all()
    probes = space.signatures(a, 1, 2)
    assert probes.shape == (1, 4) and len(set(probes[0].tolist())) == 4 and probes[0, 0] == space.signatures(a, 1)[0, 0]


def test_walks_stay_in_the_graph(spark):
    g = M.record_graph([(["abc", "abd"], "NOUN"), (["xyz"], None), ([""], "VERB")])
    assert len(g.first) == 3  # the record without a name is left out
    walks = M.random_walks(spark, g)
    assert walks.shape == (2 * M.MOST, M.LENGTH) and set(walks.ravel().tolist()) <= set(g.tokens.tolist())
    assert (walks == M.random_walks(spark, g)).all()
    assert M.random_walks(spark, M.record_graph([])).shape == (0, M.LENGTH) and len(M.train_tokens(np.zeros((0, M.LENGTH), np.int64))) == M.TOKENS


def test_calibrate_is_monotone():
    rng = np.random.default_rng(0)
    c = rng.random(500)
    steps = M.calibrate(c, (rng.random(500) < c).astype(float))
    assert [p for _, p in steps] == sorted(p for _, p in steps)
    assert M.calibrate(np.zeros(0), np.zeros(0)) == [(-1.0, 0.5)]


LEX = "lexeme_id long, lemma string, upos string"
SLOT = "slot_form_id long, lexeme_id long, slot string, written_form string"
ENT = "entry_id string, upos string, lemmas array<string>, word_forms array<struct<form:string,msd:string>>"


def _forms(w):
    return [(w, "sg indef nom"), (w + "s", "sg indef gen"), (w + "en", "sg def nom"), (w + "ar", "pl indef nom")]


def test_match_entities(spark):
    rng = random.Random(2)
    words = sorted({_name(rng) for _ in range(60)})
    words = [w for w in words if w.endswith("fäst")]
    lex = [(i, w, "NOUN") for i, w in enumerate(words)] + [(900, words[0], "VERB"), (901, None, None)]
    slots = [(i, i, "sg_def", w + "en") for i, w in enumerate(words)] + [(900, 900, "inf", words[0])]
    ent = [(f"e{i}", "nn", [w], _forms(w)) for i, w in enumerate(words)]
    ent[1] = ("e1", None, [words[1].upper()], [])
    ent[2] = ("e2", "av", ["helt annat", words[2][:3] + words[2][4:]], _forms(words[2]))
    ent[3] = ("e3", "nn", [words[3][:4] + "x" + words[3][4:]], _forms(words[3][:4] + "x" + words[3][4:]))
    ent[4] = ("e4", "vb", [words[0]], [(words[0], "inf aktiv")])
    ent += [("n1", None, None, None), ("n2", "nn", [], []), ("n3", "nn", [None], [(None, None)])]
    out = M.match_entities(spark.createDataFrame(lex, LEX), spark.createDataFrame(slots, SLOT), spark.createDataFrame(ent, ENT)).collect()
    got = {r.entry_id: r.lexeme_id for r in out}
    want = {f"e{i}": i for i in range(len(words)) if i not in (3, 4)} | {"e4": 900}
    assert got == want and all(0 <= r.confidence <= 1 for r in out)


@pytest.mark.parametrize("n", [2, 52])
def test_tied_homonyms_are_paired_in_turn(spark, n):
    lex = spark.createDataFrame([(i, "flibrafäst", "NOUN") for i in range(n)], LEX)
    ent = spark.createDataFrame([(f"e{i:03}", "nn", ["flibrafäst"], _forms("flibrafäst")) for i in range(n + 5)], ENT)
    out = M.match_entities(lex, spark.createDataFrame([], SLOT), ent).collect()
    assert len(out) == n + 5 == len({r.entry_id for r in out}) and len({r.lexeme_id for r in out}) == n
    assert all(0 <= r.confidence <= 1 / n for r in out)


def test_large_homonym_groups_pair_by_evidence(spark):
    n, w = 52, "flibrafäst"
    own = [f"{w}{a}{b}" for a in "bdgklmnprt" for b in "aeiouy"][:n]
    lex = spark.createDataFrame([(i, w, "NOUN") for i in range(n)] + [(n, w, "VERB"), (n + 1, w[1:], "NOUN")], LEX)
    slots = spark.createDataFrame([(i, i, "sg_def", own[i]) for i in range(n)], SLOT)
    # in another order than the ids, twice for one of them, and once without class
    ent = [(f"e{i:03}", "nn", [w], _forms(w) + [(own[(i * 7) % n], "sg def nom")]) for i in range(n)]
    ent += [("f", "nn", [w], _forms(w) + [(own[5], "sg def nom")]), ("g", None, [w], [(w, None), (own[9], None)]), ("h", "nn", [w], [(own[3], "sg def nom"), (w, "sg indef nom"), (w + "s", "sg indef gen")])]
    out = M.match_entities(lex, slots, spark.createDataFrame(ent, ENT)).collect()
    assert {r.entry_id: r.lexeme_id for r in out} == {f"e{i:03}": (i * 7) % n for i in range(n)} | {"f": 5, "g": 9, "h": 3} and len(out) == n + 3


def test_all_likely_stems_are_kept(spark):
    rules = {"m": [("en", x, 0.1) for x in ("", "a", "e", "el", "er")]}
    ent = spark.createDataFrame([("e", "nn", [], [("flibrafästen", "m")])], ENT)
    assert {r.name for r in M.entry_views(ent, rules, frozenset()).collect()} == {"flibrafast" + x for x in ("", "a", "e", "el", "er")}


def test_nothing_matches_nothing(spark):
    assert M.match_entities(spark.createDataFrame([], LEX), spark.createDataFrame([], SLOT), spark.createDataFrame([], ENT)).count() == 0
