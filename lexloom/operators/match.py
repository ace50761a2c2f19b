"""Matching operators: ladders, best matches, near keys, splits, subset joins, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ladder_match(left: DataFrame, right: DataFrame, id_col: str, levels: list[tuple[str, Column, Column]], value: str) -> DataFrame:
    """Each left row with the level that matches first: (id, level, value, matches).

    A level is (name, left key, right key). At the first level at which a row matches, a unique
    value is its match; several make it ambiguous (value null, matches > 1). Right keys are
    reduced to one row with a count, so a key held by many rows is never expanded into pairs.
    """
    out = None
    for place, (name, lk, rk) in enumerate(levels):
        keys = right.select(rk.alias("__k"), F.col(value).alias("__v")).filter("__k is not null").groupBy("__k").agg(
            F.count_distinct("__v").alias("matches"), F.min("__v").alias("__v")
        )
        hit = left.select(id_col, lk.alias("__k")).filter("__k is not null").join(keys, "__k").select(
            id_col, F.lit(place).alias("place"), F.lit(name).alias("level"), F.when(F.col("matches") == 1, F.col("__v")).alias("value"), "matches"
        )
        out = hit if out is None else out.unionByName(hit)
    first = out.groupBy(id_col).agg(F.min_by(F.struct("level", "value", "matches"), "place").alias("m"))
    return first.select(id_col, "m.level", "m.value", "m.matches")


def best_set_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, left_set: str, right_set: str) -> DataFrame:
    """For each left row the right rows of its key with the best sets; ties are kept.

    Order: equal sets, subset, size of the overlap, fewest members on one side only.
    """
    pairs = left.join(right, key)
    both = F.size(F.array_intersect(left_set, right_set))
    apart = F.size(F.array_except(left_set, right_set)) + F.size(F.array_except(right_set, left_set))
    scored = pairs.select(
        left_id, right_id, (apart == 0).cast("int").alias("exact"), (F.size(F.array_except(left_set, right_set)) == 0).cast("int").alias("subset"),
        both.alias("overlap"), apart.alias("apart"),
    )
    score = F.struct("exact", "subset", "overlap", -F.col("apart"))
    best = scored.groupBy(left_id).agg(F.max(score).alias("best"))
    return scored.join(best, left_id).filter(score == F.col("best")).drop("best")


def near_match(left: DataFrame, right: DataFrame, word: str) -> DataFrame:
    """(word, candidate) of a word and candidates that share a key with it after one deletion, as long as it or one character longer.

    A candidate one shorter than the word isn't found: the search goes from readings, which lose characters.
    """
    keys = F.explode(F.array_union(F.array("__w"), T.deletion_keys("__w")))
    lk = left.select(F.col(word).alias("__w")).select(F.col("__w").alias("word"), keys.alias("k"))
    rk = right.select(F.col(word).alias("__w")).select(F.col("__w").alias("candidate"), keys.alias("k"))
    longer = F.length("candidate") - F.length("word")
    return lk.join(rk, "k").filter((F.col("word") != F.col("candidate")) & longer.between(0, 1)).select("word", "candidate").distinct()


def compound_splits(compounds: DataFrame, lefts: DataFrame, rights: DataFrame, word: str, least: int = 2) -> DataFrame:
    """(word, head, tail) for every split into a left word and a right word, each of `least` letters at least."""
    n = F.length(word)
    at = compounds.select(word).distinct().filter(n >= 2 * least).withColumn("i", F.explode(F.sequence(F.lit(least), n - least)))
    cut_ = at.select(F.col(word).alias("word"), F.expr(f"substr(`{word}`, 1, i)").alias("head"), F.expr(f"substr(`{word}`, i + 1)").alias("tail"))
    return cut_.join(lefts.select(F.col(word).alias("head")).distinct(), "head", "left_semi").join(rights.select(F.col(word).alias("tail")).distinct(), "tail", "left_semi").select("word", "head", "tail")


def split_kinds(words: DataFrame, splits: DataFrame, word: str) -> DataFrame:
    """Each word as none, unique or multiple by its number of splits."""
    k = splits.groupBy("word").agg(F.count(F.lit(1)).alias("k"))
    out = words.select(F.col(word).alias("word")).distinct().join(k, "word", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return out.withColumn("kind", F.when(F.col("k") == 0, "none").when(F.col("k") == 1, "unique").otherwise("multiple"))


def explained_by(wanted: DataFrame, offered: DataFrame, wanted_id: str, offered_id: str, member: str) -> DataFrame:
    """(wanted id, offered id) where an offered set holds all members of a wanted set.

    Relational division: members meet by equality, and the count of met ones must be all.
    Repeated members count once; empty sets are explained by none.
    """
    w = wanted.select(wanted_id, member).filter(F.col(member).isNotNull()).distinct()
    size = w.groupBy(wanted_id).agg(F.count(F.lit(1)).alias("size"))
    met = w.join(offered.select(offered_id, member).distinct(), member).groupBy(wanted_id, offered_id).agg(F.count(F.lit(1)).alias("met"))
    return met.join(size, wanted_id).filter("met = size").select(wanted_id, offered_id)


def equal_set_peers(df: DataFrame, member: str, value: str) -> DataFrame:
    """Each member with the number of others that have the same set of values, and the class they form.

    The class is named by its smallest member; pairs aren't made.
    """
    sets = df.filter(F.col(value).isNotNull()).groupBy(member).agg(F.array_sort(F.collect_set(value)).alias("s"))
    classes = sets.groupBy("s").agg(F.min(member).alias("class_id"), (F.count(F.lit(1)) - 1).alias("peers"))
    return sets.join(classes, "s").select(member, "class_id", "peers")


def not_in_any(df: DataFrame, key: str, others: list[DataFrame]) -> DataFrame:
    """The distinct keys that no other table has."""
    out = df.select(key).filter(F.col(key).isNotNull()).distinct()
    for o in others:
        out = out.join(o.select(key).distinct(), key, "left_anti")
    return out


def lookup_by_keys(df: DataFrame, id_col: str, keys: list[Column], table_: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with the value of the first of its keys that the table has: (id, value, place)."""
    asked = df.select(id_col, F.posexplode(F.array(*[k.cast("string") for k in keys])).alias("place", "__k")).filter("__k is not null")
    one = table_.groupBy(F.col(key).cast("string").alias("__k")).agg(F.min(value).alias("__v"))
    return asked.join(one, "__k").groupBy(id_col).agg(F.min_by("__v", "place").alias("value"), F.min("place").alias("place"))


def route(records: DataFrame, siblings: DataFrame, id_col: str, key: str, form: str, cls: str, text: str) -> DataFrame:
    """(id, route, cls): the class of records without one, from siblings that share their key.

    By the first evidence that exists: classes of siblings whose text mentions the form, else
    classes of all siblings. One class routes the record; several leave it ambiguous; none
    leaves it unresolved. Siblings that say the same are reduced to one before they meet.
    """
    s = siblings.filter(F.col(cls).isNotNull()).select(key, F.col(cls).alias("__c"), F.col(text).alias("__t")).distinct()
    pairs = records.select(id_col, key, form).join(s, key)
    ev = pairs.groupBy(id_col).agg(
        F.collect_set(F.when(T.mentions("__t", form), F.col("__c"))).alias("by_mention"), F.collect_set("__c").alias("by_key")
    )
    out = records.select(id_col).join(ev, id_col, "left")
    rung = F.when(F.size("by_mention") > 0, F.col("by_mention")).otherwise(F.col("by_key"))
    return out.select(
        id_col,
        F.when(F.size(rung) == 1, F.when(F.size("by_mention") > 0, "mention").otherwise("sole_class")).when(F.size(rung) > 1, "ambiguous").otherwise("unresolved").alias("route"),
        F.when(F.size(rung) == 1, rung[0]).alias("cls"),
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`column` replaced where (keys, column) equals a row (keys, old) of the corrections; also `corrected`.

    Corrections are a manifest of at most a few thousand rows, which is checked.
    """
    if corrections.limit(100_001).count() > 100_000:
        raise ValueError("corrections are a manifest, not a table of data")
    c = corrections.select(*keys, F.col("old").alias(column), F.col("new").alias("__new"))
    out = df.join(F.broadcast(c), [*keys, column], "left")
    return out.withColumn("corrected", F.col("__new").isNotNull()).withColumn(column, F.coalesce("__new", column)).select(*df.columns, "corrected")


def evidence_order(words: DataFrame, word: str, sources: list[tuple[str, DataFrame]], otherwise: str = "none") -> DataFrame:
    """(word, evidence): the first of the sources that has the word."""
    out = words.select(word).distinct()
    ranked = None
    for place, (name, df) in enumerate(sources):
        s = df.select(F.col(word)).distinct().withColumn("place", F.lit(place)).withColumn("evidence", F.lit(name))
        ranked = s if ranked is None else ranked.unionByName(s)
    best = ranked.groupBy(word).agg(F.min_by("evidence", "place").alias("evidence"))
    return out.join(best, word, "left").withColumn("evidence", F.coalesce("evidence", F.lit(otherwise)))


def key_ladder(left: DataFrame, right: DataFrame, word: str) -> DataFrame:
    """(word, level, value, matches) by folded, separator-free, accent-free and loose keys, the strictest first."""
    key = [("fold", T.fold), ("separators", lambda c: T.strip_separators(T.fold(c))), ("accents", lambda c: T.strip_accents(T.strip_separators(T.fold(c)))), ("loose", T.loose_key)]
    return ladder_match(left.select(word).distinct(), right.select(word).distinct().withColumn("__w", F.col(word)), word, [(n, f(F.col(word)), f(F.col(word))) for n, f in key], "__w")


def best_assignment(score: list[list[tuple[int, int, int]]]) -> tuple[list[int], int]:
    """The column of each row, so that the sums of the scores are the largest, compared in order; and how many tie.

    Hungarian method on one number a score; the optima are the perfect matchings of the pairs
    that are tight under its potentials, of which the first in order is given. Counting them is
    done by part, rows and columns that are alike at once.
    """
    import numpy as np

    n = len(score)
    if not n:
        return [], 1
    base = 2 * n * max(max(abs(x) for x in cell) for row in score for cell in row) + 1
    cost = np.array([[-((int(e) * base + o) * base + m) for e, o, m in row] for row in score], object)
    if base**2 * n * 4 < 2**62:
        cost = cost.astype(np.int64)
    far = 4 * n * (int(np.abs(cost).max()) + 1)
    u, v = np.zeros(n, cost.dtype), np.zeros(n, cost.dtype)
    owner = [-1] * n
    for row in range(n):
        least, before, done, i, at = np.full(n, far, cost.dtype), np.full(n, -1), np.zeros(n, bool), row, -1
        reached = [row]
        while True:
            slack = cost[i] - u[i] - v
            better = ~done & (slack < least)
            least[better], before[better] = slack[better], at
            free = np.flatnonzero(~done)
            at = int(free[np.argmin(least[free])])
            step = least[at]
            u[reached] += step
            v[done] -= step
            least[~done] -= step
            done[at] = True
            if owner[at] < 0:
                break
            i = owner[at]
            reached.append(i)
        while at >= 0:
            prior = int(before[at])
            owner[at] = owner[prior] if prior >= 0 else row
            at = prior
    tight = cost == u[:, None] + v
    column = [0] * n
    for j, i in enumerate(owner):
        column[i] = j
    for i in range(n):
        for j in np.flatnonzero(tight[i]).tolist():
            if j >= column[i]:
                break
            k = owner[j]
            if k < i:
                continue
            # row k gives j away if the rows after i can take what i leaves
            came, todo, goal = {}, [k], column[i]
            while todo and goal not in came:
                r = todo.pop()
                for c in np.flatnonzero(tight[r]).tolist():
                    if c != j and c not in came and (c == goal or owner[c] > i):
                        came[c] = r
                        if c == goal:
                            break
                        todo.append(owner[c])
            if goal in came:
                c = goal
                while True:
                    r = came[c]
                    given, column[r], owner[c] = column[r], c, r
                    if r == k:
                        break
                    c = given
                column[i], owner[j] = j, i
                break
    # only pairs on a cycle with the assigned ones are in any optimum
    reach = tight[:, column]
    while (more := reach | (reach.astype(np.float32) @ reach.astype(np.float32) > 0)).sum() > reach.sum():
        reach = more
    cyclic = np.zeros_like(tight)
    cyclic[:, column] = reach & reach.T
    return column, _matchings(tight & cyclic)


def _matchings(tight) -> int:
    """The number of perfect matchings of a square matrix of allowed pairs, which has one.

    Exact; the work grows with the ways in which kinds of columns can be left over, which are
    few if members of a group are alike, and exponential if many unlike ones tie.
    """
    from collections import Counter
    from math import comb, factorial

    rows, total = {i: frozenset(r.nonzero()[0].tolist()) for i, r in enumerate(tight)}, 1
    while rows:
        part, columns = set(), set(rows[next(iter(rows))])
        while more := {i for i, c in rows.items() if i not in part and c & columns}:
            part |= more
            columns = columns.union(*(rows[i] for i in more))
        mine = sorted(part)
        # columns that the same rows allow are one kind with a number left
        kinds = Counter(tuple(i for i in mine if j in rows[i]) for j in columns)
        names = list(kinds)
        alike = Counter(frozenset(k for k, name in enumerate(names) if i in name) for i in mine)
        states = {tuple(kinds[x] for x in names): 1}
        for allowed, times in sorted(alike.items(), key=lambda x: (len(x[0]), sorted(x[0]))):
            after: Counter = Counter()
            for left, ways in states.items():
                spread = [(left, times, ways)]
                for k in sorted(allowed):
                    spread = [(s[:k] + (s[k] - x,) + s[k + 1 :], need - x, w * comb(s[k], x)) for s, need, w in spread for x in range(min(s[k], need) + 1)]
                for s, need, w in spread:
                    if not need:
                        after[s] += w * factorial(times)
            states = after
        total *= sum(states.values())
        for i in mine:
            del rows[i]
    return total


def assign_within(df_left: DataFrame, df_right: DataFrame, key: str, left_id: str, right_id: str, left_set: str, right_set: str) -> DataFrame:
    """Best one-to-one assignment between groups of a key that have equal sizes, whatever the size.

    Score: equal sets, then overlap, then fewest members on one side only; of tied optima the
    first in the order of ids, and their number, null if it has more than 38 digits. Groups of
    unequal sizes are given with a reason and no pairs: (key, left_id, right_id, ties, reason).
    The assignment takes cubic time in the size of a group, counting the tied ones may take
    longer (see _matchings).
    """
    from decimal import Decimal

    import pandas as pd

    sizes = df_left.groupBy(key).agg(F.count(F.lit(1)).alias("a")).join(df_right.groupBy(key).agg(F.count(F.lit(1)).alias("b")), key, "full")
    reason = F.when(F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0)), "unequal")
    marked = sizes.withColumn("reason", reason)
    fine = marked.filter("reason is null").select(key)
    lk, rk = df_left.schema[left_id].dataType.simpleString(), df_right.schema[right_id].dataType.simpleString()
    kk = df_left.schema[key].dataType.simpleString()
    l = df_left.join(fine, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(left_id).alias("id"), F.col(left_set).alias("s")))).alias("l"))
    r = df_right.join(fine, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(right_id).alias("id"), F.col(right_set).alias("s")))).alias("r"))

    def solve(batches):
        for pdf in batches:
            out = []
            for k, a, b in zip(pdf[key], pdf["l"], pdf["r"]):
                ls, rs = [(x["id"], set(x["s"])) for x in a], [(x["id"], set(x["s"])) for x in b]
                best, ties = best_assignment([[(x == y, len(x & y), -len(x ^ y)) for _, y in rs] for _, x in ls])
                ties = Decimal(ties) if ties < 10**38 else None
                out += [(k, ls[i][0], rs[j][0], ties, None) for i, j in enumerate(best)]
            yield pd.DataFrame(out, columns=[key, left_id, right_id, "ties", "reason"])

    schema = f"`{key}` {kk}, `{left_id}` {lk}, `{right_id}` {rk}, ties decimal(38,0), reason string"
    pairs = l.join(r, key).mapInPandas(solve, schema)
    left_out = marked.filter("reason is not null").select(
        key, F.lit(None).cast(lk).alias(left_id), F.lit(None).cast(rk).alias(right_id), F.lit(None).cast("decimal(38,0)").alias("ties"), "reason"
    )
    return pairs.unionByName(left_out)


def align_tokens(df: DataFrame, id_col: str, left: str, right: str, gap: float = -0.36) -> DataFrame:
    """Monotone global alignment of two token arrays of a row: (id, left_pos, right_pos, score).

    Positions run from 0; a token without partner has a null on the other side. Scores of pairs
    are the share of equal leading and trailing letters; ties prefer pairs.
    """
    import numpy as np
    import pandas as pd

    kind = df.schema[id_col].dataType.simpleString()

    def like(a: str, b: str) -> float:
        if a == b:
            return 1.0
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        e = 0
        while e < min(len(a), len(b)) - k and a[-1 - e] == b[-1 - e]:
            e += 1
        return 2.0 * (k + e) / max(len(a) + len(b), 1) - 0.5

    def run(batches):
        for pdf in batches:
            out = []
            for i, a, b in zip(pdf[id_col], pdf[left], pdf[right]):
                a, b = list(a if a is not None else []), list(b if b is not None else [])
                m = np.zeros((len(a) + 1, len(b) + 1))
                m[:, 0], m[0, :] = gap * np.arange(len(a) + 1), gap * np.arange(len(b) + 1)
                s = np.array([[like(x, y) for y in b] for x in a]).reshape(len(a), len(b))
                for x in range(1, len(a) + 1):
                    for y in range(1, len(b) + 1):
                        m[x, y] = max(m[x - 1, y - 1] + s[x - 1, y - 1], m[x - 1, y] + gap, m[x, y - 1] + gap)
                x, y, rows = len(a), len(b), []
                while x or y:
                    if x and y and m[x, y] == m[x - 1, y - 1] + s[x - 1, y - 1]:
                        x, y = x - 1, y - 1
                        rows.append((i, x, y, float(s[x, y])))
                    elif x and m[x, y] == m[x - 1, y] + gap:
                        x -= 1
                        rows.append((i, x, None, None))
                    else:
                        y -= 1
                        rows.append((i, None, y, None))
                out += rows[::-1]
            frame = pd.DataFrame(out, columns=[id_col, "left_pos", "right_pos", "score"])
            yield frame.astype({"left_pos": "Int32", "right_pos": "Int32", "score": "Float64"})

    return df.select(id_col, left, right).mapInPandas(run, f"`{id_col}` {kind}, left_pos int, right_pos int, score double")
