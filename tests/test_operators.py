import itertools
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import diff, grouping, match, ordered, packed, skew


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# ---- cell diff --------------------------------------------------------------------------


def test_cell_diff(spark):
    a = frame(spark, [(1, "x", "m"), (1, "x", "m"), (2, None, "m"), (3, "z", None), (None, "q", "q"), (5, "e", "e")], "k long, v string, w string")
    b = frame(spark, [(1, "x", "m"), (2, "y", "m"), (3, "z", None), (4, "n", "n"), (None, "r", "r"), (5, "e", "f")], "k long, v string, w string")
    assert rows(diff.cell_diff(a, b, "k", ["v", "w"])) == [(2, "v"), (4, "only_right"), (5, "w")]
    assert rows(diff.cell_diff(a.limit(0), b.limit(0), "k", ["v"])) == []


def test_cell_diff_takes_clashing_extra_columns(spark):
    a = frame(spark, [(1, "x", "f", "s")], "key long, v string, field string, sign string")
    assert rows(diff.cell_diff(a, a, "key", ["v", "field"])) == []


def test_keyed_and_positional_diff(spark):
    a = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    b = frame(spark, [(2, "b"), (3, "x"), (4, "d")], "k int, v string")
    assert rows(diff.keyed_diff(a, b, "k", ["v"])) == [(1, "removed"), (3, "changed"), (4, "added")]
    assert rows(diff.positional_diff(a, b.limit(2), ["k"], ["k"], "v")) == [(1, "a", "b"), (2, "b", "x"), (3, "c", None)]


@pytest.mark.parametrize("g,o,want", [(["a"], ["a"], "exact"), (["a"], ["A"], "exact_case"), (["a"], ["a", "b"], "subset"), (["a"], ["b"], "mismatch"), ([], [], "exact")])
def test_set_status(spark, g, o, want):
    df = frame(spark, [(g, o)], "g array<string>, o array<string>")
    assert df.select(diff.set_status(F.col("g"), F.col("o"))).first()[0] == want


# ---- packed values ----------------------------------------------------------------------

PACKED = [
    (1, "+en el. +ar", ["+en", "+ar"]),
    (2, '+et / "pl. +n, förr +en" / best. pl. + [x; y]', ["+et", "pl. +n, förr +en", "best. pl. + [x; y]"]),
    (3, '"+en i ""tal""" ;+ar', ['+en i "tal"', "+ar"]),
    (4, "+n _ pl.-or|slut", ["+n", "pl.-or", "slut"]),
    (5, "+en", None), (6, None, None), (7, "", None), (8, "(null)", None), (9, " \t ", None),
    (10, "+en // +ar;;", ["+en", "+ar"]),
    (11, "»+t; tal« +a", ["+t; tal", "+a"]),
]


def test_unpack_values(spark):
    filler = [(100 + i, v, None) for i, v in enumerate(["+en +ar", "+et, +", "+n; -or", '"+en, +er" +ar', '"pl. +a; tal" / +are', "»+t el. x« | +a", "+t; +a", '+et "sg. +n"'] * 20)]
    df = frame(spark, [(i, n) for i, n, _ in PACKED + filler], "id long, notation string").withColumn("position", F.lit("clash"))
    got = {}
    for r in packed.unpack_values(df, "id", "notation", least=2).collect():
        got.setdefault(r.id, {})[r.position] = r.value
    for i, _, want in PACKED:
        if want is None:
            assert i not in got
        else:
            assert [got[i][k] for k in sorted(got[i])] == want
            assert sorted(got[i]) == list(range(1, len(want) + 1))


def test_unpack_nothing(spark):
    assert rows(packed.unpack_values(frame(spark, [], "id long, n string"), "id", "n")) == []


def test_long_field(spark):
    df = frame(spark, [(1, " el. ".join(["+en"] * 5000))], "id long, n string")
    assert packed.unpack_values(df, "id", "n").count() == 5000


# ---- skew -------------------------------------------------------------------------------


def test_lookup_join(spark):
    left = frame(spark, [(k, i) for i, k in enumerate([1] * 50 + [2, 3, None])], "k int, i int")
    right = frame(spark, [(1, "a"), (2, "b"), (9, "z")], "k int, v string")
    heavy = frame(spark, [(1,)], "k int")
    inner = skew.lookup_join(left, right, ["k"], heavy)
    assert inner.groupBy("v").count().orderBy("v").collect() == [("a", 50), ("b", 1)]
    assert skew.lookup_join(left, right, ["k"], heavy, "left").count() == 53


def test_heavy_keys_are_few(spark):
    counts = frame(spark, [(i, 30_000 if i < 3 else 1) for i in range(50)], "k int, n long")
    assert sorted(r.k for r in skew.heavy_keys(counts, ["k"]).collect()) == [0, 1, 2]


# ---- order ------------------------------------------------------------------------------


def _events(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), t, rng.choice([None, 0, 1, 2])) for t in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_operators_against_brute_force(spark, seed):
    data = _events(seed)
    df = frame(spark, data, "k string, t int, v int")
    by = {}
    for k, t, v in sorted(data, key=lambda r: r[1]):
        by.setdefault(k, []).append((t, v))
    prev = {(k, t): (by[k][i - 1][1] if i else None) for k in by for i, (t, _) in enumerate(by[k])}
    assert {(r.k, r.t): r.prev_v for r in ordered.with_previous(df, ["k"], ["t"], ["v"]).collect()} == prev
    total = {(k, t): sum(x or 0 for _, x in by[k][: i + 1]) for k in by for i, (t, _) in enumerate(by[k])}
    assert {(r.k, r.t): r.s for r in ordered.running_sum(df, ["k"], ["t"], F.coalesce("v", F.lit(0)), "s").collect()} == total
    near = {}
    for k in by:
        for i, (t, _) in enumerate(by[k]):
            back = [v for _, v in by[k][:i] if v]
            ahead = [v for _, v in by[k][i + 1 :] if v]
            near[k, t] = back[-1] if back else ahead[0] if ahead else None
    assert {(r.k, r.t): r.a for r in ordered.nearest_anchor(df, ["k"], ["t"], F.when(F.col("v") != 0, F.col("v")), "a").collect()} == near
    runs = {(k, t): sum(1 for j in range(i + 1) if j == 0 or by[k][j][1] != by[k][j - 1][1]) for k in by for i, (t, _) in enumerate(by[k])}
    assert {(r.k, r.t): r.run for r in ordered.runs(df, ["k"], ["t"], "v").collect()} == runs
    isl = {(k, t): sum(1 for j in range(i + 1) if j == 0 or by[k][j][0] - by[k][j - 1][0] > 9) for k in by for i, (t, _) in enumerate(by[k])}
    assert {(r.k, r.t): r.island for r in ordered.islands(df, ["k"], ["t"], F.col("t") - F.col("prev_t") > 9).collect()} == isl


def test_contained_in(spark):
    rng = random.Random(3)
    iv = [(rng.choice("ab"), a := rng.randrange(100), a + rng.randrange(30), i) for i in range(120)]
    df = frame(spark, iv, "k string, lo int, hi int, id int")
    want = sorted((k, i) for k, a, b, i in iv if any(k == q and j != i and c <= a and b <= d and ((c, d) != (a, b) or j < i) for q, c, d, j in iv))
    assert rows(ordered.contained_in(df, "k", "lo", "hi", "id")) == sorted(want, key=repr)


def test_empty_order(spark):
    e = frame(spark, [], "k string, t int, v int")
    assert ordered.with_previous(e, ["k"], ["t"], ["v"]).count() == 0
    assert ordered.runs(e, ["k"], ["t"], "v").count() == 0


# ---- groups -----------------------------------------------------------------------------


def test_first_union_does_not_depend_on_order(spark):
    data = [("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), ("a", 2, "x"), (None, 4, "z")]
    for p in itertools.islice(itertools.permutations(data), 0, 120, 40):
        g = grouping.group_first_union(frame(spark, list(p), "w string, i int, s string"), ["w"], "i", ["i"], ["s"])
        assert sorted(map(tuple, g.collect()), key=repr) == sorted([("a", 1, ["x", "y"], 3), ("b", 2, [], 1), (None, 4, ["z"], 1)], key=repr)


def test_top_per_key_and_votes(spark):
    df = frame(spark, [("a", i) for i in range(500)] + [("b", 1)], "k string, v int")
    assert rows(grouping.top_per_key(df, ["k"], [F.desc("v")], 2)) == [("a", 498, 2), ("a", 499, 1), ("b", 1, 1)]
    v = frame(spark, [("u", "x", 2), ("u", "y", 2), ("u", "z", 1), ("t", None, 5)], "k string, c string, w int")
    assert rows(grouping.weighted_vote(v, "k", "c", F.col("w"))) == [("u", 2, "x", 2)]


def test_digest_ignores_order(spark):
    a = frame(spark, [(1, "x"), (2, None)], "a int, b string")
    assert grouping.content_digest(a, ["a", "b"]).first() == grouping.content_digest(a.orderBy(F.desc("a")), ["a", "b"]).first()
    assert grouping.content_digest(a, ["a", "b"]).first() != grouping.content_digest(a.limit(1), ["a", "b"]).first()


# ---- matching ---------------------------------------------------------------------------


def test_ladder(spark):
    l = frame(spark, [(1, "A", "x"), (2, "b", "q"), (3, "c", "c"), (4, None, None)], "id int, p string, q string")
    r = frame(spark, [("a", 10), ("q", 11), ("c", 12), ("c", 13)], "w string, v int")
    out = match.ladder_match(l, r, "id", [("fold", F.lower("p"), F.col("w")), ("other", F.col("q"), F.col("w"))], "v")
    assert rows(out) == [(1, "fold", 10, 1), (2, "other", 11, 1), (3, "fold", None, 2)]


def test_near_split_and_subset(spark):
    w = frame(spark, [("kliva",), ("klivs",), ("klva",), ("hus",)], "w string")
    assert rows(match.near_match(w, w, "w")) == [("kliva", "klivs"), ("klivs", "kliva"), ("klva", "kliva")]
    s = match.compound_splits(frame(spark, [("hundhus",)], "w string"), frame(spark, [("hund",)], "w string"), frame(spark, [("hus",)], "w string"), "w")
    assert rows(s) == [("hundhus", "hund", "hus")]
    assert rows(match.split_kinds(frame(spark, [("hundhus",), ("x",)], "w string"), s, "w")) == [("hundhus", 1, "unique"), ("x", 0, "none")]
    a = frame(spark, [(1, "x"), (1, "y"), (1, "x"), (2, None)], "a int, m string")
    b = frame(spark, [(7, "x"), (7, "y"), (8, "x")], "b int, m string")
    assert rows(match.explained_by(a, b, "a", "b", "m")) == [(1, 7)]


def test_assignment_and_alignment(spark):
    l = frame(spark, [("k", 1, ["a", "b"]), ("k", 2, ["c"]), ("u", 3, ["x"])], "k string, l int, f array<string>")
    r = frame(spark, [("k", 8, ["c"]), ("k", 9, ["a"])], "k string, r int, g array<string>")
    assert rows(match.assign_within(l, r, "k", "l", "r", "f", "g")) == sorted([("k", 1, 9, 1, None), ("k", 2, 8, 1, None), ("u", None, None, None, "unequal")], key=repr)
    t = frame(spark, [(1, ["a", "bcd", "e"], ["a", "bcx", "q", "e"]), (2, None, ["a"])], "i int, a array<string>, b array<string>")
    got = [(r.i, r.left_pos, r.right_pos) for r in match.align_tokens(t, "i", "a", "b").collect()]
    assert got == [(1, 0, 0), (1, 1, 1), (1, None, 2), (1, 2, 3), (2, None, 0)]


def test_assignment_of_any_size(spark):
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(1, 7)
        a, b = ([{rng.choice("abcd") for _ in range(rng.randrange(4))} for _ in range(n)] for _ in range(2))
        score = [[(x == y, len(x & y), -len(x ^ y)) for y in b] for x in a]
        total = {p: tuple(sum(score[i][j][q] for i, j in enumerate(p)) for q in range(3)) for p in itertools.permutations(range(n))}
        best = [p for p in total if total[p] == max(total.values())]
        assert match.best_assignment(score) == (list(best[0]), len(best))
    n = 30
    l = frame(spark, [("k", i, [f"w{i}", "x"]) for i in range(n)] + [("t", i, ["a"]) for i in range(9)], "k string, l int, f array<string>")
    r = frame(spark, [("k", 100 + i, [f"w{n - 1 - i}", "y"]) for i in range(n)] + [("t", 100 + i, ["a"]) for i in range(9)], "k string, r int, g array<string>")
    want = [("k", i, 100 + n - 1 - i, 1, None) for i in range(n)] + [("t", i, 100 + i, 362880, None) for i in range(9)]
    assert sorted(tuple(x) for x in match.assign_within(l, r, "k", "l", "r", "f", "g").collect()) == want


def test_corrections_keep_other_rows(spark):
    df = frame(spark, [(1, "a"), (2, "a"), (3, None)], "k int, v string")
    c = frame(spark, [(1, "a", "b")], "k int, old string, new string")
    assert rows(match.apply_corrections(df, c, ["k"], "v")) == [(1, "b", True), (2, "a", False), (3, None, False)]


# ---- text -------------------------------------------------------------------------------


@pytest.mark.parametrize("w,want", [("", "EMPTY"), (None, "EMPTY"), ("x", "ONE_CHARACTER"), ("högan", None), ("a-b", "CONTAINS_HYPHEN"), ("r2", "CONTAINS_DIGIT"), ("x²", "CONTAINS_DIGIT"), ("rock'n", "CONTAINS_APOSTROPHE"), ("a/b", "CONTAINS_OTHER_NONLETTER")])
def test_rejection(spark, w, want):
    assert frame(spark, [(w,)], "w string").select(T.rejection_reason("w")).first()[0] == want


def test_text_functions(spark):
    df = frame(spark, [("högan", "<sup>1</sup>stor|å·s  x", "gräss", "sak", "Över ön")], "a string, b string, c string, d string, e string")
    r = df.select(T.nfc("a"), T.clean_surface("b"), T.join_parts("c", "d"), T.genitive("d"), T.genitive("c"), T.mentions("e", F.lit("ÖN")), T.mentions("e", F.lit("ve"))).first()
    assert tuple(r) == ("högan", "storås x", "grässak", "saks", "gräss", True, False)
    assert df.select(T.casefold(F.lit("STRASSE ß"))).first()[0] == "strasse ss"
