"""Matching entities across sources without keys.

Records of both tables, their attributes (names, inflected forms, class) and the tokens of
these (character grams) form a graph. Random walks over it train skip-gram vectors of
tokens, so grams that stand together come near each other and a gram that an error made
weighs little: a name and its misspelling keep almost one direction, where vectors without
training lose it. Names are blocked by the sides of random hyperplanes in several tables,
with the planes a table has and the number of tables planned from the number of names and
from the angles of known errors; what meets is reranked exactly by edit distance, class,
spelling, forms and cosine, and cosines and votes of forms are calibrated on each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, discard

# ---- fixed values -------------------------------------------------------------------
#: Spellings of one sound, folded for comparison.
SPELLINGS = [("aa", "a"), ("ae", "a"), ("oe", "o"), ("æ", "a"), ("ø", "o"), ("w", "v"), ("c", "k"), ("kk", "k")]
CLASSES = {"nn": "NOUN", "av": "ADJ", "vb": "VERB", "noun": "NOUN", "adj": "ADJ", "verb": "VERB"}
CLASS_OF_MARK = {"sg": "NOUN", "pl": "NOUN", "pos": "ADJ", "komp": "ADJ", "super": "ADJ", "superl": "ADJ", "inf": "VERB", "pres": "VERB", "pret": "VERB", "sup": "VERB"}
# -------------------------------------------------------------------------------------

#: Records of each table that walks start from and pass through, at most: the token vectors are fitted to them, every record is indexed.
FIT_RECORDS = 10_000
GRAM_BUCKETS = 1 << 14
SIZE, SEED = 32, 7
WALKS, FEWEST, MOST, LENGTH, HOP = 80_000, 4, 40, 8, 0.05
#: The share of single errors that the tables must hold, by the errors tried on names of the sample, and the most tables there can be.
RECALL, MOST_TABLES = 0.97, 256
#: Hyperplanes that a searched name is closest to, on both sides of which it is looked for.
FLIPS = 3
#: A suffix rule must hold for this share of the forms with its mark.
RULE_SHARE = 0.02


def fold_name(text: str | None, particles: frozenset[str] = frozenset()) -> str:
    """A name for comparison: small letters of one spelling, no joints, notes or particles."""
    if not text:
        return ""
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]|[\d*]", " ", text.lower()).strip()
    words = s.split()
    while len(words) > 1 and words[-1] in particles:
        words.pop()
    s = re.sub(r"[-|·.´'’\s]", "", " ".join(words))
    for a, b in SPELLINGS:
        s = s.replace(a, b)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return s.replace("kk", "k")


def word_class(mark: str | None) -> str | None:
    """The class of a word-class code; null for unknown codes."""
    m = (mark or "").strip().lower()
    return CLASSES.get(m)


def class_of_forms(marks: list[str | None]) -> str | None:
    """The class most marks of inflected forms belong to."""
    votes = Counter(CLASS_OF_MARK.get((m or "").replace("_", " ").split(" ")[0]) for m in marks)
    votes.pop(None, None)
    return max(votes, key=lambda k: (votes[k], k)) if votes else None


def _grams(name: str) -> np.ndarray:
    """The buckets of the three-letter grams of a name, its ends marked."""
    c = np.frombuffer(("^" + name + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    c = c if len(c) > 2 else np.append(c, np.uint64(36))
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS


@dataclass
class Graph:
    """A bounded record-attribute-token graph: record r has attributes first[r]:first[r+1], attribute a tokens at[a]:at[a+1]."""

    first: np.ndarray
    at: np.ndarray
    tokens: np.ndarray
    holder_at: np.ndarray
    holders: np.ndarray

    def walks(self) -> int:
        """Walks from each record: WALKS in all, but FEWEST to MOST."""
        return min(max(-(-WALKS // max(len(self.first) - 1, 1)), FEWEST), MOST)

    def walk(self, start: int) -> np.ndarray:
        """Tokens met on walks of LENGTH steps: an attribute of the record, one of its tokens, now and then on to another record that has the token."""
        rng = np.random.default_rng((SEED, start))
        n = self.walks()
        out = np.empty((n, LENGTH), np.int64)
        dice, hops = rng.random((n, LENGTH, 3)), rng.random((n, LENGTH)) < HOP
        for w in range(n):
            r = start
            for k in range(LENGTH):
                a = self.first[r] + int(dice[w, k, 0] * (self.first[r + 1] - self.first[r]))
                t = self.tokens[self.at[a] + int(dice[w, k, 1] * (self.at[a + 1] - self.at[a]))]
                out[w, k] = t
                if hops[w, k]:
                    lo, hi = self.holder_at[t], self.holder_at[t + 1]
                    r = self.holders[lo + int(dice[w, k, 2] * (hi - lo))]
        return out


_CLASS_TOKENS = {c: GRAM_BUCKETS + i for i, c in enumerate(("NOUN", "ADJ", "VERB"))}
TOKENS = GRAM_BUCKETS + len(_CLASS_TOKENS)


def record_graph(records: list[tuple[list[str], str | None]]) -> Graph:
    """The graph of records given as (name and forms, class); records without names are left out."""
    first, lists, holder = [0], [], []
    for values, cls in records:
        mine = [_grams(v) for v in values if v]
        if mine:
            # the class stands beside the grams of the name: alone it would be every other token of a walk
            mine[0] = np.append(mine[0], _CLASS_TOKENS[cls]) if cls in _CLASS_TOKENS else mine[0]
            holder += [len(first) - 1] * sum(map(len, mine))
            lists += mine
            first.append(len(lists))
    tokens = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    holder_at = np.searchsorted(tokens[order], np.arange(TOKENS + 1))
    sizes = np.array([len(x) for x in lists], np.int64)
    return Graph(np.array(first), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), tokens, holder_at, np.array(holder, np.int64)[order] if lists else tokens)


def random_walks(spark: SparkSession, graph: Graph) -> np.ndarray:
    """The walks from every record of the graph, walked by the executors."""
    shared = spark.sparkContext.broadcast(graph)

    def walk(batches):
        for batch in batches:
            w = [shared.value.walk(r).ravel() for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.list_(pa.int64()))], names=["id", "walk"])

    rows = spark.range(len(graph.first) - 1).mapInArrow(walk, "id bigint, walk array<bigint>").toArrow().sort_by("id")
    return rows["walk"].combine_chunks().values.to_numpy().reshape(-1, LENGTH) if len(rows) else np.zeros((0, LENGTH), np.int64)


def train_tokens(walks: np.ndarray, rate: float = 0.1, noises: int = 3, batch: int = 1024) -> np.ndarray:
    """Skip-gram vectors of tokens with negative samples. They begin near nothing, so tokens that are hardly ever met stay there."""
    rng = np.random.default_rng(SEED)
    vectors = (rng.uniform(-0.5, 0.5, (TOKENS, SIZE)) / SIZE).astype(np.float32)
    if not len(walks):
        return vectors
    pairs = np.concatenate([np.stack([walks[:, :-d].ravel(), walks[:, d:].ravel()], 1) for d in (1, 2, 3)])
    pairs = pairs[rng.permutation(len(pairs))]
    context = np.zeros_like(vectors)
    noise = np.cumsum(np.bincount(walks.ravel(), minlength=TOKENS) ** 0.75)
    for at in range(0, len(pairs), batch):
        a, b = pairs[at : at + batch].T
        for target, label in [(b, 1.0)] + [(np.searchsorted(noise, rng.random(len(a)) * noise[-1], "right"), 0.0) for _ in range(noises)]:
            g = (np.float32(rate) * (np.float32(label) - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", vectors[a], context[target]), -30, 30)))))[:, None]
            da, dt = g * context[target], g * vectors[a]
            np.add.at(vectors, a, da)
            np.add.at(context, target, dt)
    return vectors


def _one_error(name: str, rng: np.random.Generator, letters: str) -> str:
    i, x, kind = int(rng.integers(len(name))), letters[int(rng.integers(len(letters)))], int(rng.integers(4))
    if kind == 0:
        return name[:i] + x + name[i + 1 :]
    if kind == 1:
        return name[:i] + x + name[i:]
    if kind == 2:
        return name[:i] + name[i + 1 :]
    return name[:i] + name[i : i + 2][::-1] + name[i + 2 :]


@dataclass
class NameSpace:
    """Token vectors, the mean direction of names, which tells nothing, and the plan of the tables."""

    tokens: np.ndarray
    mean: np.ndarray
    planes: int = 8
    tables: int = 1

    def vectors(self, names: list[str]) -> np.ndarray:
        """The vectors of names, of length 1."""
        if not names:
            return np.zeros((0, SIZE))
        ids = [_grams(n) for n in names]
        sizes = np.array([len(i) for i in ids])
        return _unit(_unit(np.add.reduceat(self.tokens[np.concatenate(ids)], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)) - self.mean)

    def signatures(self, vectors: np.ndarray, table: int, flips: int = 0) -> np.ndarray:
        """The sides of a table's hyperplanes as bits, with the table above them; with `flips`, 2 ** flips columns: all sides of the closest planes."""
        side = vectors @ np.random.default_rng((SEED, table)).normal(size=(SIZE, self.planes))
        key = ((side > 0) @ (1 << np.arange(self.planes, dtype=np.int64))).astype(np.int64) | (table << 48)
        out = key[:, None]
        if flips:
            for p in np.argsort(np.abs(side), axis=1)[:, :flips].T:
                out = np.concatenate([out, out ^ (np.int64(1) << p.astype(np.int64))[:, None]], axis=1)
        return out

    def plan(self, names: list[str], count: int, seed: int = SEED) -> None:
        """Planes for a quarter of a name in each bucket, of `count`; tables until RECALL of the errors made in `names` meet their names."""
        self.planes = int(min(max(np.ceil(np.log2(max(count, 1))) + 2, 8), 46))
        names = [n for n in names if len(n) > 1]
        if not names:
            return
        rng = np.random.default_rng(seed)
        letters = sorted(set("".join(names)))
        wrong = [_one_error(n, rng, letters) for n in names]
        a, b = self.vectors(names), self.vectors(wrong)
        met = np.zeros(len(names), bool)
        for self.tables in range(1, MOST_TABLES + 1):
            t = self.tables - 1
            met |= (self.signatures(b, t, FLIPS) == self.signatures(a, t)).any(axis=1)
            if met.mean() >= RECALL:
                return


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def fit_space(lex: DataFrame, views: DataFrame, trained: bool = True) -> NameSpace:
    """The vectors of names from walks over FIT_RECORDS records of each side, drawn by a hash, and the tables for all names of `lex`.

    `lex` is of lexeme_views, `views` of entry_views. Without `trained` the vectors of
    tokens are random, for comparison.
    """
    drawn = lambda df, *cols: df.orderBy(F.xxhash64(*cols), *cols).limit(FIT_RECORDS)
    ours = drawn(lex.select("lexeme_id", "name", "cls", "forms"), "lexeme_id").select("name", "cls", "forms").collect()
    theirs = drawn(views.groupBy("entry_id").agg(F.collect_set("name").alias("names"), F.max("cls").alias("cls"), F.first("forms").alias("forms")), "entry_id").collect()
    records = [([r.name, *sorted(r.forms or [])], r.cls) for r in ours] + [(sorted({*r.names, *(r.forms or [])}), r.cls) for r in theirs]
    names = sorted({r.name for r in ours})
    if trained:
        tokens = train_tokens(random_walks(lex.sparkSession, record_graph(records)))
    else:
        tokens = np.random.default_rng(SEED).normal(size=(TOKENS, SIZE))
    space = NameSpace(tokens, np.zeros(SIZE))
    space.mean = space.vectors(names).mean(axis=0) if names else space.mean
    # 2000 errors tell a share of 0.97 to 0.01
    space.plan([names[i] for i in np.random.default_rng(SEED).permutation(len(names))[:2000]], lex.select(F.count_distinct("name")).first()[0])
    return space


def _near(a: str, b: str) -> int:
    """0 for equal names, 1 for one letter more, less, other or two swapped, else 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ta, tb = a[i:], b[i:]
    if ta[1:] == tb[1:] or ta[1:] == tb or ta == tb[1:]:
        return 1
    return 1 if len(ta) > 1 and len(tb) > 1 and ta[0] == tb[1] and ta[1] == tb[0] and ta[2:] == tb[2:] else 2


def _keyed(names: DataFrame, space: Broadcast, prefix: str, tables: range, flips: int = 0) -> DataFrame:
    """(key, prefix_name): each name under its buckets in `tables`."""

    def key(batches):
        for batch in batches:
            texts = batch.column(0)
            v = space.value.vectors(texts.to_pylist())
            for t in tables:
                keys = space.value.signatures(v, t, flips)
                for k in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, k]), texts], names=["key", f"{prefix}_name"])

    return names.select("name").mapInArrow(key, f"key bigint, {prefix}_name string")


def name_pairs(left: DataFrame, right: DataFrame, space: NameSpace) -> DataFrame:
    """(left_name, right_name) of distinct names (name, asked) that share a bucket and are at most one error apart.

    Equal names share every bucket, so one table finds them. The names of `right` that are
    `asked` for and found no equal one there go on to all tables, and are looked for on both
    sides of the planes they are closest to. Buckets that hold many names are split by the
    skew handling of the join.
    """
    shared = left.sparkSession.sparkContext.broadcast(space)

    def exact(batches):
        for batch in batches:
            near = [_near(x, y) < 2 for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(near, pa.bool_()))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        # two letters swapped are a distance of two
        return a.join(b, "key").filter(F.levenshtein("left_name", "right_name", 2) >= 0).select("left_name", "right_name")

    names = left.filter("name <> ''").select("name").distinct()
    others = right.filter("name <> ''").groupBy("name").agg(F.max("asked").alias("asked"))
    first = cut(met(_keyed(names, shared, "left", range(1)), _keyed(others, shared, "right", range(1))).filter("left_name = right_name"), "equal-names")
    open_ = others.filter("asked").join(first.select(F.col("right_name").alias("name")), "name", "left_anti")
    tables = range(space.tables)
    more = met(_keyed(names, shared, "left", tables), _keyed(open_, shared, "right", tables, FLIPS)).distinct()
    return first.unionByName(more.mapInArrow(exact, more.schema))


def suffix_rules(entries: DataFrame, particles: frozenset[str]) -> dict[str, list[tuple[str, str, float]]]:
    """For each mark, how a form's ending turns into a name's: (ending, name's ending, share), counted over all entries.

    Rules below RULE_SHARE are left out, so a mark has fewer than 1 / RULE_SHARE.
    """

    def count(batches):
        for batch in batches:
            votes: Counter = Counter()
            for lemmas, forms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names = [fold_name(x, particles) for x in lemmas or []]
                for f in forms or []:
                    form, mark = fold_name(f["form"], particles), f["msd"]
                    if not form or not mark:
                        continue
                    for name in names:
                        k = 0
                        while k < min(len(name), len(form)) and name[k] == form[k]:
                            k += 1
                        if k >= 4 and len(name) - k <= 1 and len(form) - k <= 6:
                            votes[mark, form[k:], name[k:]] += 1
                            break
            cells = [list(c) for c in zip(*votes)] if votes else [[], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cells), pa.array(list(votes.values()), pa.int64())], names=["mark", "a", "b", "n"])

    rows = entries.select("lemmas", "word_forms").mapInArrow(count, "mark string, a string, b string, n bigint").groupBy("mark", "a", "b").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("mark"))
    out: dict[str, list[tuple[str, str, float]]] = defaultdict(list)
    for r in rows.withColumn("share", share).filter((F.col("share") >= RULE_SHARE) & (F.col("n") > 2)).collect():
        out[r.mark].append((r.a, r.b, r.share))
    return dict(out)


def stems_of(forms: list[tuple[str, str]], rules: dict[str, list[tuple[str, str, float]]]) -> dict[str, float]:
    """Names the (form, mark) pairs can belong to, each with the share of forms that vote for it."""
    votes: Counter = Counter()
    for form, mark in forms:
        mine = set()
        for a, b, _ in rules.get(mark, ()):
            if form.endswith(a) and len(form) - len(a) >= 4:
                mine.add(form[: len(form) - len(a)] + b)
        votes.update(mine)
    n = max(len(forms), 1)
    return {s: v / n for s, v in votes.items()}


_VIEWS = "entry_id string, name string, raw string, kind string, weight double, last boolean, cls string, sure_cls boolean, forms array<string>, lemmas array<string>"


def entry_views(entries: DataFrame, rules: dict, particles: frozenset[str]) -> DataFrame:
    """The names an entry may stand for: its lemmas, and every stem that half of its forms vote for."""
    shared = entries.sparkSession.sparkContext.broadcast((rules, particles))

    def views(batches):
        rules, particles = shared.value
        for batch in batches:
            out = []
            for entry, upos, lemmas, word_forms in zip(*(c.to_pylist() for c in batch.columns)):
                forms = [(fold_name(f["form"], particles), f["msd"]) for f in word_forms or [] if f and f["form"] and not f["form"].endswith("-")]
                told = class_of_forms([f["msd"] for f in word_forms or [] if f])
                folded = sorted({f for f, _ in forms})
                names = [x for x in lemmas or [] if x]
                common = (told or word_class(upos), told is not None, folded, [fold_name(x, particles) for x in names])
                for k, x in enumerate(names):
                    out.append((entry, common[-1][k], x.strip(), "lemma", 1.0, k == len(names) - 1, *common))
                stems = stems_of(forms, rules)
                for s, w in sorted(stems.items()):
                    if w >= 0.5:
                        out.append((entry, s, "", "stem", w, False, *common))
            cells = list(zip(*out)) if out else [[] for _ in range(10)]
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=[x.split()[0] for x in _VIEWS.split(", ")])

    return entries.select("entry_id", "upos", "lemmas", "word_forms").mapInArrow(views, _VIEWS)


def lexeme_views(lexemes: DataFrame, slots: DataFrame, particles: frozenset[str]) -> DataFrame:
    """(lexeme_id, name, raw, cls, forms): the folded lemma, class and inflected forms of each lexeme."""
    shared = lexemes.sparkSession.sparkContext.broadcast(particles)
    by = slots.groupBy("lexeme_id").agg(F.collect_set("written_form").alias("written"), F.collect_set("slot").alias("slots"))

    def views(batches):
        for batch in batches:
            ids, lemmas, upos, written, slots_ = (c.to_pylist() for c in batch.columns)
            names = [fold_name(x, shared.value) for x in lemmas]
            cls = [word_class(u) or class_of_forms(s or []) for u, s in zip(upos, slots_)]
            forms = [sorted({fold_name(w, shared.value) for w in ws or []}) for ws in written]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array([(x or "").strip() for x in lemmas]), pa.array(cls, pa.string()), pa.array(forms, pa.list_(pa.string()))],
                names=["lexeme_id", "name", "raw", "cls", "forms"],
            )

    return lexemes.join(by, "lexeme_id", "left").select("lexeme_id", "lemma", "upos", "written", "slots").mapInArrow(
        views, "lexeme_id bigint, name string, raw string, cls string, forms array<string>"
    )


def _particles(lexemes: DataFrame) -> frozenset[str]:
    """Words that often follow a lemma's first word: fewer than 100."""
    last = F.element_at(F.split(F.trim("lemma"), r"\s+"), -1)
    many = lexemes.filter(F.trim("lemma").contains(" ")).select(last.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = many.agg(F.sum("n").alias("total"))
    return frozenset(r.w for r in many.join(F.broadcast(total), F.col("n") * 100 > F.col("total")).filter(F.length("w") <= 4).collect())


def calibrate(values: np.ndarray, truths: np.ndarray, weights: np.ndarray | None = None) -> list[tuple[float, float]]:
    """Monotone steps (least value, probability) from values whose truth is known (pooled adjacent violators), each seen `weights` times."""
    if not len(values):
        return [(-1.0, 0.5)]
    w = np.ones(len(values)) if weights is None else weights
    order = np.argsort(values, kind="stable")
    # at least 20 in a step, so that a single one doesn't tell
    steps: list[list[float]] = []
    for c in order:
        if steps and steps[-1][2] < 20:
            steps[-1][1] += truths[c] * w[c]
            steps[-1][2] += w[c]
        else:
            steps.append([float(values[c]), float(truths[c] * w[c]) + 0.5, w[c] + 1.0])
    k = 0
    while k + 1 < len(steps):
        if steps[k][1] / steps[k][2] > steps[k + 1][1] / steps[k + 1][2]:
            steps[k][1] += steps[k + 1][1]
            steps[k][2] += steps[k + 1][2]
            del steps[k + 1]
            k = max(k - 1, 0)
        else:
            k += 1
    return [(s[0], s[1] / s[2]) for s in steps]


def _calibrated(rows: DataFrame, value: str, truth: Column) -> Column:
    """The probability that `truth` holds, by the value rounded to hundredths, from all rows; at most 201 counts reach the driver."""
    seen = rows.groupBy(F.round(value, 2).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(truth.cast("double")).alias("y")).collect()
    v, n, y = (np.array([r[k] for r in seen], float) for k in ("v", "n", "y"))
    steps = calibrate(v, y / n, n) if len(v) else calibrate(v, y)
    out = F.lit(steps[0][1])
    for least, p in steps:
        out = F.when(F.round(value, 2) >= least, F.lit(p)).otherwise(out)
    return F.when(F.col(value).isNotNull(), out)


def _lemmas_near(said: DataFrame, space: NameSpace) -> DataFrame:
    """`said` with the fewest errors between its name and a lemma, and the last lemma (null from two on), and the best cosine of such a lemma."""
    shared = said.sparkSession.sparkContext.broadcast(space)

    @F.arrow_udf("struct<lemma_near: int, last_near: int, lemma_cosine: double>")
    def compare(names: pa.Array, lemmas: pa.Array) -> pa.Array:
        names, lemmas = names.to_pylist(), lemmas.to_pylist()
        near = [[_near(name, x) for x in mine or []] for name, mine in zip(names, lemmas)]
        best = [min(n, default=2) for n in near]
        cosine = [1.0 if k == 0 else None for k in best]
        at = [(i, x) for i, k in enumerate(best) if k == 1 for x, n in zip(lemmas[i], near[i]) if n == 1]
        a, b = shared.value.vectors([names[i] for i, _ in at]), shared.value.vectors([x for _, x in at])
        for (i, _), c in zip(at, np.einsum("ij,ij->i", a, b).tolist()):
            cosine[i] = max(c, cosine[i] or -1.0)
        few = lambda ks: pa.array([k if k < 2 else None for k in ks], pa.int32())
        return pa.StructArray.from_arrays([few(best), few([n[-1] if n else 2 for n in near]), pa.array(cosine, pa.float64())], names=["lemma_near", "last_near", "lemma_cosine"])

    return said.withColumn("__near", compare("left_name", "lemmas")).select("*", "__near.*").drop("__near", "lemmas")


def match_entities(lexemes: DataFrame, slots: DataFrame, entries: DataFrame) -> DataFrame:
    """(lexeme_id, entry_id, confidence): at most one lexeme for each entry.

    An entry with forms belongs to a lexeme whose name the forms show; its own lemma may
    hold an error. An entry without forms belongs to the lexeme its last lemma names, one
    error allowed, or else another of its lemmas. Classes told by forms must agree. Of
    homonyms the one with the best class, spelling, forms and cosine is taken. The lexemes
    that tie in all of these are given to the entries that tie for them in turn, and the
    confidence is divided by their number. Null names match nothing; empty tables give no rows.
    """
    particles = _particles(lexemes)
    rules = suffix_rules(entries, particles)
    views = cut(entry_views(entries, rules, particles), "views")
    lex = cut(lexeme_views(lexemes, slots, particles).filter("name <> ''"), "lexemes")
    space = fit_space(lex, views)
    # forms that show a name say more than a lemma one error from it: lemmas are searched for where there are no forms
    asked = views.select("name", ((F.col("kind") == "lemma") & (F.size("forms") == 0)).alias("asked"))
    pairs = cut(name_pairs(lex, asked, space), "names")

    # what an entry says for each name it meets: its forms, and all its lemmas
    said = views.join(pairs.withColumnRenamed("right_name", "name"), "name").groupBy("entry_id", "left_name").agg(
        F.max(F.when((F.col("kind") == "stem") & (F.col("name") == F.col("left_name")), F.col("weight"))).alias("stem"),
        F.max_by("raw", F.struct(F.col("last"), F.col("kind"))).alias("raw"),
        F.first("cls").alias("cls"), F.first("sure_cls").alias("sure_cls"), F.first("forms").alias("forms"), F.first("lemmas").alias("lemmas"),
    )
    said = cut(_lemmas_near(said, space), "said")
    discard(views, pairs)
    has_forms = F.size("forms") > 0
    # lemmas and forms are two witnesses: each is calibrated on what the other says
    lemma_p = _calibrated(said.filter(has_forms & F.col("lemma_cosine").isNotNull()), "lemma_cosine", F.coalesce("stem", F.lit(0.0)) >= 0.5)
    forms_p = _calibrated(said.filter("stem is not null"), "stem", F.col("lemma_near").isNotNull())
    confidence = 1 - (1 - F.coalesce(lemma_p, F.lit(0.0))) * (1 - F.coalesce(forms_p, F.lit(0.0)))
    # damaged forms still begin as the name they belong to
    alike = F.expr("size(filter(forms, f -> startswith(f, left(left_name, length(left_name) - 1)))) >= 0.5 * size(forms)")
    shown = (F.coalesce(F.col("stem"), F.lit(0.0)) >= 0.5) | ((F.col("lemma_near") == 0) & alike)
    good = F.when(has_forms, shown).otherwise(F.col("lemma_near").isNotNull())
    named = said.filter(good).select(
        "entry_id", F.col("left_name").alias("name"), "raw", "cls", "sure_cls", F.col("forms").alias("entry_forms"),
        F.coalesce("lemma_near", F.lit(2)).alias("lemma_near"), (~has_forms & F.col("last_near").isNotNull()).cast("int").alias("by_last"),
        F.round(F.coalesce("lemma_cosine", F.lit(0.0)), 3).alias("cosine"), F.round(confidence, 4).alias("confidence"),
    )
    out = _chosen(named, lex)
    discard(said, lex)
    return out


def _scored(pairs: DataFrame) -> DataFrame:
    """Pairs of an entry and a lexeme of its name, without clashes of classes, with what speaks for them as `score`."""
    clash = F.col("cls").isNotNull() & F.col("lex_cls").isNotNull() & (F.col("cls") != F.col("lex_cls"))
    agree = F.coalesce((F.col("cls") == F.col("lex_cls")).cast("int"), F.lit(0)) - clash.cast("int")
    shared = F.size(F.array_intersect("entry_forms", "lex_forms"))
    score = F.struct("by_last", (-F.col("lemma_near")).alias("near"), agree.alias("agree"), (F.col("raw") == F.col("lex_raw")).cast("int").alias("raw"), shared.alias("shared"), "cosine")
    return pairs.filter(~(clash & F.col("sure_cls"))).withColumn("score", score)


_SAID = ["name", "cls", "sure_cls", "raw", "entry_forms", "by_last", "lemma_near", "cosine"]
#: Parts of the entries of a name that are compared in different tasks.
SALTS = 4


def _chosen(named: DataFrame, lex: DataFrame) -> DataFrame:
    """(lexeme_id, entry_id, confidence): the best lexeme of each entry.

    Lexemes of a name that say the same, and entries that say the same of it, are one row
    each; these are compared pair by pair, so the work grows with the number of different
    ones, whatever the number of rows. A lexeme without homonyms ties with none and meets its
    entries at once.
    """
    from ..operators.skew import heavy_keys, lookup_join
    from .ranking import ranked

    said = lambda cols: F.unhex(F.md5(F.to_json(F.struct(*cols))))
    by_name = cut(lex.groupBy("name").agg(F.count(F.lit(1)).alias("k"), *[F.first(c).alias(d) for c, d in (("lexeme_id", "lexeme_id"), ("cls", "lex_cls"), ("raw", "lex_raw"), ("forms", "lex_forms"))]), "by-name")
    busy = heavy_keys(named.groupBy("name").agg(F.count(F.lit(1)).alias("n")), ["name"])
    lonely = _scored(lookup_join(named, by_name.filter("k = 1").drop("k"), ["name"], busy))
    homonyms = by_name.filter("k > 1").select("name")
    ours = cut(lex.join(homonyms, "name", "left_semi").withColumn("lex_key", said(["name", "cls", "raw", "forms"])), "lexeme-kinds")
    theirs = cut(named.join(homonyms, "name", "left_semi").withColumn("entry_key", said(_SAID)), "entry-kinds")
    lex_kinds = ours.groupBy("lex_key").agg(
        F.first("name").alias("name"), F.first("cls").alias("lex_cls"), F.first("raw").alias("lex_raw"), F.first("forms").alias("lex_forms"),
        F.count(F.lit(1)).alias("k"), F.min("lexeme_id").alias("lexeme_id"),
    )
    counts = theirs.groupBy("entry_key").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in _SAID])
    entry_kinds = counts.withColumn("name", F.struct("name", F.pmod(F.xxhash64("entry_key"), F.lit(SALTS)).alias("salt")))
    salted = lex_kinds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))).withColumn("name", F.struct("name", "salt")).drop("salt")
    kinds = cut(_scored(entry_kinds.join(salted, "name")).select("entry_key", "score", "k", "lexeme_id", "lex_key"), "kinds")
    # the lexemes that tie for an entry are told by the sum of their kinds' hashes
    ties = kinds.groupBy("entry_key", "score").agg(
        F.sum("k").alias("tied"), F.min("lexeme_id").alias("lexeme_id"), F.sum(F.xxhash64("lex_key").cast("decimal(38,0)")).alias("tie"),
    )
    top = cut(ties.groupBy("entry_key").agg(F.max_by(F.struct("score", "tied", "lexeme_id", "tie"), "score").alias("m")).select("entry_key", "m.*"), "best-kinds")
    heavy = heavy_keys(counts.select("entry_key", "n"), ["entry_key"])
    hits = lookup_join(theirs.select("entry_id", "entry_key", "confidence"), top, ["entry_key"], heavy).drop("entry_key")
    hits = hits.unionByName(lonely.select("entry_id", "confidence", "score", F.lit(1).cast("bigint").alias("tied"), "lexeme_id", F.lit(None).cast("decimal(38,0)").alias("tie")))
    best = hits.groupBy("entry_id").agg(F.max_by(F.struct("lexeme_id", "confidence", "tied", "tie"), F.struct("score", -F.col("lexeme_id"))).alias("m")).select("entry_id", "m.*")
    best = cut(best.withColumn("confidence", F.round(F.col("confidence") / F.col("tied"), 4)), "best")
    discard(by_name, theirs)
    alone = best.filter("tied = 1").select("lexeme_id", "entry_id", "confidence")

    # the members of each tie, by one kind of entry that has it
    of = top.filter("tied > 1").groupBy("tie").agg(F.min_by(F.struct("entry_key", "score"), "entry_key").alias("m")).select("tie", "m.*")
    members = kinds.join(of, ["entry_key", "score"]).select("tie", "lex_key")
    a = ranked(ours.select("lex_key", "lexeme_id").join(members, "lex_key").select("tie", "lexeme_id"), ["tie"], "lexeme_id")
    b = ranked(best.filter("tied > 1").select("tie", "entry_id", "confidence", "tied"), ["tie"], "entry_id")
    turn = b.withColumn("rank", F.pmod("rank", "tied"))
    return alone.unionByName(a.join(turn, ["tie", "rank"]).select("lexeme_id", "entry_id", "confidence"))
