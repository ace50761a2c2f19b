"""Repair of text from scanned pages: furniture, words broken across lines, misread words.

Lines of all readings are first laid out as rows that know their place on the page and
their neighbours. A boosted line classifier, fitted to lines that repeat at page edges or have the
shape of furniture there, finds furniture; a boosted line-pair classifier, fitted to hyphens
within lines and at their ends, finds broken words. Unknown words meet the printed
vocabulary in an inverted join on their rarest character q-grams, one of which survives any
single misreading; a boosted ranker, fitted to words that two readings of one page disagree
about, chooses the replacement or keeps the word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .boosting import BoostedTrees

# ---- fixed values -------------------------------------------------------------------
#: Marks that can stand for the hyphen at a line's end.
BREAK_MARKS = "-¬‐­=‑"
DASHES = "–—-"
#: Letters that are often read in place of digits.
DIGIT_SHAPES = str.maketrans("lI|!ijOoQDZzSsBbgqGA", "11111100002255869964")
REFERENCE_MARKS = ("jfr", "se", "→")
EDGE_PUNCTUATION = ".,;:()[]\"'»«!?“”…"
#: Usual confusions (printed, read), the ranker's only guide where no page was read twice.
USUAL = "ä>ii ä>å ä>a å>ä å>a ö>6 ö>o ü>ii d>cl k>lc m>rn rn>m li>h h>b n>u u>n e>c c>e t>f f>t l>1 l>I l>i i>l i>j i>! i>1 s>5 o>0 g>9 g>q v>y cl>d >. >'"
# -------------------------------------------------------------------------------------

#: Rows of weakly or doubly read examples that each classifier is fitted to, at most.
FIT_ROWS = 20_000
#: Lines from a page edge that can be furniture.
EDGE = 3
GRAM_BUCKETS = 4096
OP_BUCKETS = 4096
#: A line text repeating at the edges of more than this share of pages is a running header.
HEADER_SHARE = 0.004
#: How sure the line classifier must be of furniture at an edge, and of furniture within a page.
SURE_EDGE, SURE_INNER = 0.5, 0.9

_USUAL = {tuple(x.split(">")) for x in USUAL.split()}
_LINE = "origin string, row_id bigint, page_no int, line_no int, line string, words array<bigint>, top int, bottom int, before array<string>, after array<string>"


def page_lines(pages: DataFrame, origin: str) -> DataFrame:
    """Rows of the non-blank lines of page texts (row_id, page_no, text), with their neighbours.

    Line numbers count every line from 1. `before` and `after` hold the neighbouring
    non-blank lines: two each, near an edge all up to the edge. Null and blank texts have no lines.
    """

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row_id, page_no, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [(k, x) for k, x in enumerate((text or "").split("\n"), 1) if x.strip()]
                n = len(lines)
                for i, (k, x) in enumerate(lines):
                    bottom = n - 1 - i
                    a = max(i - EDGE, 0) if i <= EDGE else i - 2
                    b = min(i + 1 + EDGE, n) if bottom <= 2 * EDGE else i + 3
                    rows.append((origin, row_id, page_no, k, x, None, i, bottom, [y for _, y in lines[a:i]], [y for _, y in lines[i + 1 : b]]))
            yield _batch(rows)

    return pages.select("row_id", "page_no", "text").mapInArrow(lay, _LINE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in range(10)]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = [x.split()[0] for x in _LINE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def reading_lines(words: DataFrame, origin: str) -> DataFrame:
    """The same rows for readings given word by word (page_id, page_num, block_num, ..., word_id, text).

    row_id is the page, `words` the word ids of the line. Only level-5 rows with text count;
    blanks inside a word are left out, so that words and ids stay together.
    """
    order = ["block_num", "par_num", "line_num"]
    lines = (
        words.filter("level = '5' and text is not null and trim(text) <> ''")
        .groupBy("page_id", *order)
        .agg(F.max("page_num").alias("page_no"), F.array_sort(F.collect_list(F.struct("word_num", "word_id", F.regexp_replace("text", r"\s+", "").alias("text")))).alias("w"))
    )
    by_page = Window.partitionBy("page_id").orderBy(*order)
    back = Window.partitionBy("page_id").orderBy(*[F.col(c).desc() for c in order])
    text = F.array_join(F.col("w.text"), " ")
    lines = lines.select("page_id", "page_no", *order, text.alias("line"), F.col("w.word_id").alias("words"))
    lines = lines.withColumn("top", F.row_number().over(by_page) - 1)
    # lead and lag reach as far as an edge can
    near = lambda f, ks: F.array_compact(F.array(*[f("line", k).over(by_page) for k in ks]))
    lines = lines.withColumns({"before": near(F.lag, range(EDGE, 0, -1)), "after": near(F.lead, range(1, EDGE + 1))})
    lines = lines.withColumn("bottom", F.row_number().over(back) - 1)
    return lines.select(
        F.lit(origin).alias("origin"), F.col("page_id").alias("row_id"), F.col("page_no").cast("int"),
        (F.col("top") + 1).cast("int").alias("line_no"), "line", "words", F.col("top").cast("int"), F.col("bottom").cast("int"), "before", "after",
    )


# ---- lines ---------------------------------------------------------------------------

_NUMBER = re.compile(r"[0-9lI|!ijOoQDZzSsBbgqGA]{1,4}\*?$")
_LETTERS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d")


def _grams(line: str) -> list[int]:
    s = "^" + re.sub(r"\d", "0", " ".join(line.lower().split())) + "$"
    return [_fnv(s[i : i + 3]) % GRAM_BUCKETS for i in range(len(s) - 2)]


@lru_cache(maxsize=1 << 16)
def _fnv(s: str) -> int:
    h = 2166136261
    for b in s.encode("utf-8"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def _is_number(token: str, digits: bool = True) -> bool:
    t = token.strip(EDGE_PUNCTUATION + DASHES)
    return bool(t) and bool(_NUMBER.match(t)) and (not digits or any(c.isdigit() for c in t))


def _page_match(token: str, page_no: int | None) -> bool:
    t = token.strip(EDGE_PUNCTUATION + DASHES)
    # a scan can show the next page beside this one
    return page_no is not None and 0 < len(t) <= 5 and t.translate(DIGIT_SHAPES) in (str(page_no), str(page_no + 1))


def line_shape(line: str, page_no: int | None) -> str | None:
    """The shape of lines that are furniture wherever a page ends: number, mark, guide words."""
    tokens = line.split()
    bare = [t for t in tokens if t.strip(EDGE_PUNCTUATION + DASHES)]
    if not bare:
        return None
    if len(bare) <= 2 and all(_page_match(t, page_no) or len(t.strip(".")) <= 3 and t[:1].isupper() and len(bare) > 1 for t in bare) and any(_page_match(t, page_no) for t in bare):
        return "number"
    if len(bare) == 1 and re.match(r"[\dlIZSO]{1,2}\*$", bare[0]):
        return "sheet"
    others = [t for t in bare if not _page_match(t, page_no)]
    if len(others) < len(bare) <= 5 and sum(len(t) > 4 for t in others) in (1, 2) and not any(c in t for t in others for c in "+.,;"):
        return "guide"
    words = re.split(r"\s+[–—-]\s+", line.strip())
    if len(words) == 1 and line.isupper():
        words = re.split("[–—-]", line.strip())
    if len(words) == 2 and all(len(w) > 4 and "+" not in w and "." not in w[:-1] and len(w.split()) <= 2 for w in words):
        return "guide"
    return None


def line_features(line: str, page_no: int | None, odds: np.ndarray, vocabulary: frozenset[str]) -> list[float]:
    tokens = line.split()
    letters = "".join(_LETTERS.findall(line))
    g = odds[_grams(line)]
    n = max(len(tokens), 1)
    size = len(line.strip())
    return [
        len(tokens), size,
        len(_DIGIT.findall(line)) / max(size, 1),
        float(any(_page_match(t, page_no) for t in tokens)),
        sum(_is_number(t) for t in tokens) / n,
        sum(map(str.isupper, letters)) / max(len(letters), 1),
        float(g.mean()), float(g.sum()),
        float(line.rstrip().endswith(".")),
        float(any(t[0] in "+→" for t in tokens)),
        sum(len(t) == 1 for t in tokens) / n,
        sum(t.strip(EDGE_PUNCTUATION).lower() in vocabulary for t in tokens) / n,
        float(bool(tokens) and _is_number(tokens[0])),
    ]


@dataclass
class LineModel:
    odds: np.ndarray
    furniture: BoostedTrees
    followers: dict[str, float]
    joins: BoostedTrees
    vocabulary: frozenset[str]

    def furniture_odds(self, lines: list[tuple[str, int | None]]) -> dict[tuple[str, int | None], float]:
        """How likely each (line, page number) is furniture by its text; all at once."""
        each = list(set(lines))
        if not each:
            return {}
        x = np.array([line_features(line, page_no, self.odds, self.vocabulary) for line, page_no in each])
        return dict(zip(each, self.furniture.predict(x).tolist()))

    def pair_features(self, token: str, follower: str) -> list[float]:
        body = token[:-1]
        word = follower.strip(EDGE_PUNCTUATION).lower()
        joined = (body + word).strip(EDGE_PUNCTUATION).lower()
        return [
            self.followers.get(word, 0.0), float(token[-1] != "-"), float(follower[:1].islower()), len(body), len(word),
            float(joined in self.vocabulary), float(body.strip(EDGE_PUNCTUATION).lower() in self.vocabulary),
        ]

    def breaks(self, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], bool]:
        """Whether each (last word of a line, first word of the next) is one broken word; all at once."""
        each = list(set(pairs))
        if not each:
            return {}
        p = self.joins.predict(np.array([self.pair_features(a, b) for a, b in each]))
        return dict(zip(each, (p > 0.5).tolist()))


def _flags(window: list[tuple[str, int, int]], p: list[float]) -> list[bool]:
    """Furniture: lines at an edge, or joined to it by furniture, that look like it; others that surely do."""
    out = []
    for i, (_, top, bottom) in enumerate(window):
        from_top = top < EDGE and i >= top and min(p[i - top : i + 1]) > SURE_EDGE
        from_bottom = bottom < EDGE and i + bottom < len(window) and min(p[i : i + bottom + 1]) > SURE_EDGE
        out.append(from_top or from_bottom or p[i] > SURE_INNER)
    return out


def broken_token(line: str) -> str | None:
    """The last word of a line if a mark that can stand for a hyphen ends it."""
    tokens = line.split()
    if not tokens or len(tokens[-1]) < 2 or tokens[-1][-1] not in BREAK_MARKS or tokens[-1][0] in "+-":
        return None
    return tokens[-1] if tokens[-1][-2].isalpha() else None


def _gram_counts(lines: DataFrame) -> np.ndarray:
    """How often each gram bucket occurs in edge lines and in inner lines: GRAM_BUCKETS x 2, over all lines."""

    def count(batches):
        total = np.zeros((GRAM_BUCKETS, 2), np.int64)
        for batch in batches:
            for line, top, bottom in zip(*(c.to_pylist() for c in batch.columns)):
                np.add.at(total[:, int(top >= EDGE and bottom >= EDGE)], _grams(line), 1)
        at = np.flatnonzero(total.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["b", "e", "i"])

    rows = lines.select("line", "top", "bottom").mapInArrow(count, "b bigint, e bigint, i bigint").groupBy("b").agg(F.sum("e"), F.sum("i")).collect()
    out = np.zeros((GRAM_BUCKETS, 2))
    for b, e, i in rows:
        out[b] = e, i
    return out


def fit_lines(lines: DataFrame, vocabulary: frozenset[str], fit_rows: int = FIT_ROWS) -> LineModel:
    """The line and line-pair classifiers, counts over all lines, fitted to at most `fit_rows` examples each."""
    counts = _gram_counts(lines) + 1
    share = counts / counts.sum(axis=0)
    odds = np.log(share[:, 0] / share[:, 1])

    edge = (F.col("top") < EDGE) | (F.col("bottom") < EDGE)
    # how a line begins, numbers aside
    plain = F.regexp_extract(F.trim(F.regexp_replace(F.regexp_replace("line", r"\d+[.*]?", ""), r"\s+", " ")), r"^(\S+ \S+)", 1)
    pages = lines.filter("top = 0").count()
    headers = {
        r.plain
        for r in lines.groupBy(plain.alias("plain")).agg(F.sum(edge.cast("int")).alias("e"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("e") > max(4, HEADER_SHARE * pages)) & (F.col("e") > 0.6 * F.col("n")) & (F.length("plain") > 4)).collect()
    }  # fewer than 2 * EDGE / HEADER_SHARE texts
    drawn = F.xxhash64("origin", "row_id", "line_no")
    sample = lambda of, n: lines.filter(of).orderBy(drawn).limit(n).select("line", "page_no", plain.alias("plain")).collect()
    x, y = [], []
    for r in sample(edge, fit_rows // 2):
        if r.plain in headers or line_shape(r.line, r.page_no):
            x.append(line_features(r.line, r.page_no, odds, vocabulary))
            y.append(1.0)
    for r in sample(~edge, fit_rows // 2):
        if r.plain in headers or line_shape(r.line, r.page_no):
            continue
        x.append(line_features(r.line, r.page_no, odds, vocabulary))
        y.append(0.0)
    furniture = BoostedTrees().fit(np.array(x).reshape(len(y), len(x[0]) if x else 1), np.array(y))

    inner, ends, total = Counter(), [], 0
    mid = []
    hyphened = F.col("line").rlike(r"\w[-¬‐\x{AD}=‑]( |$)") | F.col("line").rlike(r"\w[-¬‐\x{AD}=‑]\s*$")
    for r in lines.filter(hyphened).orderBy(drawn).limit(fit_rows).select("line", F.try_element_at("after", F.lit(1)).alias("next")).collect():
        tokens = r.line.split()
        for a, b in zip(tokens, tokens[1:]):
            if len(a) > 2 and a[-1] in BREAK_MARKS and a[-2].isalpha() and a[0] not in "+-":
                inner[b.strip(EDGE_PUNCTUATION).lower()] += 1
                total += 1
                mid.append((a, b))
        token = broken_token(r.line)
        if token and r.next:
            ends.append((token, r.next.split()[0]))
    followers = {w: n / total for w, n in inner.items() if n >= max(2, 0.01 * total)}
    model = LineModel(odds, furniture, followers, BoostedTrees(), vocabulary)
    x, y = [], []
    for a, b in mid:
        x.append(model.pair_features(a, b))
        y.append(0.0)
    # where a word stands tells, not how it looks: within a line it isn't broken, at the end it nearly always is
    for a, b in ends:
        x.append(model.pair_features(a, b))
        y.append(1.0)
    model.joins = BoostedTrees(rounds=30, depth=2).fit(np.array(x).reshape(len(y), len(x[0]) if x else 1), np.array(y))
    return model


# ---- words ---------------------------------------------------------------------------

_TOKEN = "origin string, row_id bigint, line_no int, word_no int, word_id bigint, kind string, token string, last boolean"


def token_form(word: str) -> str:
    """How a word is looked up: without edge punctuation, small letters, but an inner I kept as read."""
    s = word.strip(EDGE_PUNCTUATION)
    if len(s) > 2 and s[-1] in BREAK_MARKS:
        s = s[:-1]
    low = s.lower()
    if "I" in s[1:] and not s.isupper():
        low = low[0] + "".join("I" if c == "I" and s[i].islower() else d for i, (c, d) in enumerate(zip(s[1:], low[1:])))
    return low


def read_lines(lines: DataFrame, model: LineModel) -> DataFrame:
    """Rows by kind: `furniture` and `hyphen` lines (word_no 0), and the `word`s of running text.

    Words of furniture, both halves of a broken word, notation (+en, -or), words in square
    brackets and words without letters aren't given. For readings by word, furniture has a
    row for each word and word_id is set.
    """
    shared = lines.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        m: LineModel = shared.value
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            rows = list(zip(*(cols[x.split()[0]] for x in _LINE.split(", "))))
            out = _read_rows(m, rows)
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            cells = list(zip(*out)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=[x.split()[0] for x in _TOKEN.split(", ")])

    return lines.mapInArrow(read, _TOKEN)


def _read_rows(m: LineModel, rows: list[tuple]) -> list[tuple]:
    windows = []
    for *_, line, _, top, bottom, before, after in rows:
        nb = len(before)
        window = [(x, top - nb + i, bottom + nb - i) for i, x in enumerate(before)] + [(line, top, bottom)]
        windows.append(window + [(x, top + 1 + i, bottom - 1 - i) for i, x in enumerate(after)])
    p = m.furniture_odds([(x, r[2]) for r, w in zip(rows, windows) for x, *_ in w])
    flags = [_flags(w, [p[x, r[2]] for x, *_ in w]) for r, w in zip(rows, windows)]
    around = []
    for r, w, f in zip(rows, windows, flags):
        nb = len(r[8])
        following = next((x for (x, *_), g in zip(w[nb + 1 :], f[nb + 1 :]) if not g), None)
        previous = next((x for (x, *_), g in zip(w[:nb][::-1], f[:nb][::-1]) if not g), None)
        around.append((previous, following))
    pair = lambda a, b: (broken_token(a), b.split()[0]) if a and b and broken_token(a) else None
    pairs = [(pair(p, r[4]), pair(r[4], n)) for r, (p, n) in zip(rows, around)]
    joined = m.breaks([p for two in pairs for p in two if p])
    out: list[tuple] = []
    for r, f, (previous, following), (into, onward) in zip(rows, flags, around, pairs):
        out += _read_line(r, f[len(r[8])], previous, following, joined.get(into, False), joined.get(onward, False))
    return out


def _read_line(row: tuple, furniture: bool, previous: str | None, following: str | None, half: bool, broken: bool) -> list[tuple]:
    origin, row_id, _, line_no, line, words, *_ = row
    tokens = line.split()
    ids = words or [None] * len(tokens)
    if len(ids) != len(tokens):  # a word of a reading that holds a blank
        ids = [None] * len(tokens)
    if furniture:
        if words:
            return [(origin, row_id, 0, 0, w, "furniture", None, False) for w in words]
        return [(origin, row_id, line_no, 0, None, "furniture", None, False)]
    out = []
    if broken:
        out.append((origin, row_id, line_no if not words else 0, 0, ids[-1], "hyphen", None, False))
    inside = previous is not None and previous.rfind("[") > previous.rfind("]")
    for j, t in enumerate(tokens):
        opened = inside or "[" in t
        inside = (inside or "[" in t) and "]" not in t
        if opened or (j == 0 and half) or (broken and j == len(tokens) - 1) or t[0] in "+-" or "+" in t:
            continue
        form = token_form(t)
        if any(c.isalpha() for c in form):
            last = j == len(tokens) - 1 and following is None and not t.endswith(".") and (j == 0 or tokens[j - 1] not in REFERENCE_MARKS)
            out.append((origin, row_id, 0 if words else line_no, 0 if words else j + 1, ids[j], "word", form, last))
    return out


_PAIR = "token string, word string, printed string, read string, at double, tail boolean"


#: Letters of the grams of words, and how many of a word's grams one misread stretch of two characters can touch.
Q, TOUCHED = 3, 4
#: The most frequent grams whose counts order them; all others are rarer.
COMMON_GRAMS = 4096
#: Words so short that a stretch can touch all their grams meet by what a stretch leaves of them.
SHORT = 3


def word_grams(word: str) -> list[str]:
    """The character q-grams of a word, its ends marked, the nth of its kind numbered."""
    s = "^" * (Q - 1) + word + "$" * (Q - 1)
    seen: Counter = Counter()
    out = []
    for i in range(len(s) - Q + 1):
        g = s[i : i + Q]
        out.append(g if not seen[g] else f"{g}{seen[g]}")
        seen[g] += 1
    return out


def _gram_ranks(dictionary: DataFrame) -> dict[str, int]:
    """How frequent the COMMON_GRAMS most frequent grams of all printed words are."""

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                total.update(word_grams(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    rows = dictionary.select("word").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in rows.orderBy(F.desc("n"), "gram").limit(COMMON_GRAMS).collect()}


def _word_keys(word: str, ranks: dict[str, int], lengths: tuple[int, ...]) -> list[str]:
    """The keys of a word for words of any of `lengths`: its TOUCHED + 1 rarest grams, or what stretches leave of it.

    Two words that differ in one stretch of at most two characters lose TOUCHED grams each at
    most, so that many of the rarest and one more have one in common.
    """
    n = len(word)
    rare = sorted(word_grams(word), key=lambda g: (ranks.get(g, 0), g))[: TOUCHED + 1]
    keys = [f"{m}|{g}" for m in lengths if min(m, n) > SHORT for g in rare]
    if any(min(m, n) <= SHORT for m in lengths):
        left = {f"{word[:i]}\1{word[i + k :]}" for k in range(3) for i in range(n - k + 1)}
        keys += [f"{m}{x}" for m in lengths if min(m, n) <= SHORT for x in left]
    return keys


def _keyed(words: DataFrame, column: str, ranks: dict[str, int], index: bool) -> DataFrame:
    """(column, key): words under their keys; printed words (`index`) for their own length and shorter tokens, tokens for lengths that differ by one."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def keys(batches):
        for batch in batches:
            out = []
            for w in batch.column(0).to_pylist():
                n = len(w)
                if index:
                    # a short token meets any printed word by what stretches leave of it
                    mine = [f"{n}|{g}" for g in sorted(word_grams(w), key=lambda g: (shared.value.get(g, 0), g))[: TOUCHED + 1]] if n > SHORT else []
                    if n <= SHORT + 1:
                        mine += [f"{n}{x}" for x in {f"{w[:i]}\1{w[i + k :]}" for k in range(3) for i in range(n - k + 1)}]
                else:
                    mine = _word_keys(w, shared.value, (n - 1, n, n + 1))
                out += [(w, k) for k in mine]
            cells = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.string()), pa.array(cells[1], pa.string())], names=[column, "key"])

    return words.select(column).mapInArrow(keys, f"{column} string, key string")


def _compare(batches):
    """Keep the pairs that differ in one stretch of at most two characters, with that stretch."""
    for batch in batches:
        out = []
        for token, word in zip(*(c.to_pylist() for c in batch.columns)):
            m, n = len(token), len(word)
            a = 0
            while a < m and a < n and token[a] == word[a]:
                a += 1
            b = 0
            while b < m - a and b < n - a and token[m - 1 - b] == word[n - 1 - b]:
                b += 1
            if m - b - a > 2 or n - b - a > 2:
                continue
            out.append((token, word, word[a : n - b], token[a : m - b], a / max(n, 1), b == 0))
        cells = list(zip(*out)) if out else [[] for _ in range(6)]
        types = [pa.string()] * 4 + [pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=[x.split()[0] for x in _PAIR.split(", ")])


def candidate_pairs(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, word, printed, read, at, tail): printed words one misread stretch away from a token, from an inverted join on rare character grams."""
    ranks = _gram_ranks(dictionary)
    met = _keyed(tokens.filter("token <> ''"), "token", ranks, False).join(_keyed(dictionary.filter("word <> ''"), "word", ranks, True), "key")
    # one stretch of two characters is a distance of two at most
    return met.filter(F.levenshtein("token", "word", 2) >= 0).select("token", "word").distinct().mapInArrow(_compare, _PAIR)


def _pair_features(cols: dict[str, list], ops: np.ndarray) -> np.ndarray:
    rows = []
    for op, word, printed, read, at, tail, seen, known in zip(*(cols[c] for c in ("op", "word", "printed", "read", "at", "tail", "seen", "known"))):
        rows.append((
            np.log1p(ops[op]), float((printed, read) in _USUAL), len(word), at, float(tail),
            len(printed), len(read), np.log(seen), np.log1p(known or 0), np.log1p(known or 0) - np.log(seen),
            float(bool(read) and not read.isalpha()), float(at == 0),
        ))
    return np.array(rows).reshape(len(rows), 12)


def correct_words(words: DataFrame, dictionary: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(token, word): the tokens that are misreadings, each with the printed word behind it.

    `words` are the rows of kind `word`; `dictionary` (word) the printed words.
    """
    # a token that ends its text wherever it stands may be a word cut off
    seen = words.groupBy("token").agg(F.count(F.lit(1)).alias("seen"), F.min("last").alias("cut_off"))
    printed = dictionary.select("word").distinct()
    unknown = cut(seen.join(printed, seen.token == printed.word, "left_anti"), "unknown")
    known = seen.join(printed, seen.token == printed.word, "left_semi").select(F.col("token").alias("word"), F.col("seen").alias("known"))
    pairs = cut(
        candidate_pairs(unknown.select("token"), printed)
        .join(unknown, "token").join(known, "word", "left")
        # a word cut by the end of its text is no misreading
        .filter(~(F.col("cut_off") & F.col("tail") & (F.length("read") < F.length("printed")) & F.col("word").startswith(F.col("token"))))
        .withColumn("op", F.pmod(F.xxhash64("printed", "read"), F.lit(OP_BUCKETS)).cast("int")),
        "pairs",
    )
    ops = np.zeros(OP_BUCKETS)
    often = pairs.groupBy("op", "printed", "read").count().filter("count > 1").groupBy("op").agg(F.sum("count").alias("n"))
    for r in often.collect():  # OP_BUCKETS rows at most
        ops[r.op] = r.n

    x, y = _double_read(words, pairs, ops, fit_rows)
    model = BoostedTrees(rounds=80).fit(x, y) if min(y.sum(), len(y) - y.sum()) >= 20 else None
    shared = pairs.sparkSession.sparkContext.broadcast((model, ops))

    def rank(batches):
        trees, counts = shared.value
        for batch in batches:
            f = _pair_features({n: batch.column(n).to_pylist() for n in batch.schema.names}, counts)
            p = trees.predict(f) if trees else f[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("word"), pa.array(p, pa.float64())], names=["token", "word", "p"])

    return (
        pairs.mapInArrow(rank, "token string, word string, p double")
        .filter("p > 0.5")
        .groupBy("token").agg(F.max_by("word", F.struct("p", "word")).alias("word"))
    )


def _double_read(words: DataFrame, pairs: DataFrame, ops: np.ndarray, fit_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Examples from pages read twice: the other reading has the printed word (1) or the token itself (0)."""
    by_page = words.select("origin", F.col("row_id").alias("page"), "token").distinct()
    origins = F.when(F.col("origin") == words_origin(), F.lit("r")).otherwise(F.lit("w"))
    sides = by_page.select("page", "token", origins.alias("side"))
    twice = sides.groupBy("page").agg(F.count_distinct("side").alias("k")).filter("k = 2").select("page")
    here = sides.join(twice, "page")
    there = here.select("page", F.col("token").alias("t2"), F.when(F.col("side") == "r", "w").otherwise("r").alias("side"))
    asked = (
        here.join(pairs.select("token", "word"), "token")
        .orderBy(F.xxhash64("page", "side", "token"), "word").limit(fit_rows)
    )
    same = there.select("page", "side", F.col("t2").alias("token"), F.lit(1).alias("same"))
    other = there.select("page", "side", F.col("t2").alias("word"), F.lit(1).alias("other"))
    told = asked.join(same, ["page", "side", "token"], "left").join(other, ["page", "side", "word"], "left")
    told = told.withColumn("solved", F.max("other").over(Window.partitionBy("page", "side", "token")))
    told = told.filter("same is not null or solved is not null").select(
        "token", "word", F.when(F.col("same").isNull() & F.col("other").isNotNull(), 1).otherwise(0).alias("y")
    )
    rows = told.join(pairs, ["token", "word"]).collect()  # at most fit_rows
    cols = {c: [r[c] for r in rows] for c in ("op", "word", "printed", "read", "at", "tail", "seen", "known")}
    return _pair_features(cols, ops), np.array([r.y for r in rows], float)


def fixed_words(vocabulary: DataFrame, most: int = 1_000_000) -> frozenset[str]:
    """The words of a vocabulary (word) that goes to every worker, in small letters; one of more than `most` rows is refused."""
    rows = vocabulary.select(F.lower("word").alias("word")).filter("word is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} rows: give it as lemmas, which are joined")
    return frozenset(r.word for r in rows)


def words_origin() -> str:
    """The origin of readings by word; any other origin holds page texts."""
    return "ocr_words"


def find_noise(pages: DataFrame, readings: DataFrame, vocabulary: DataFrame, lemmas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, LineModel]:
    """The noise of both readings: (lines, items, corrections, model).

    `items` are rows of read_lines, `corrections` of correct_words. `vocabulary` (word) is of
    fixed size and goes to the workers; `lemmas` (word) may be of any size. Null texts and
    empty tables have no noise.
    """
    lines = cut(page_lines(pages, "runeberg_pages").unionByName(reading_lines(readings, words_origin())), "lines")
    fixed = fixed_words(vocabulary)
    model = fit_lines(lines, fixed)
    items = cut(read_lines(lines, model), "items")
    dictionary = vocabulary.select("word").unionByName(lemmas.select("word")).filter("word is not null")
    dictionary = dictionary.select(F.explode(F.split(F.lower("word"), r"\s+")).alias("word")).filter("word <> ''")
    corrections = cut(correct_words(items.filter("kind = 'word'"), dictionary), "corrections")
    return lines, items, corrections, model


def noise_rows(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """(origin, row_id, line_no, word_no, defect) for furniture, broken words and misread words."""
    row = F.coalesce("word_id", "row_id").alias("row_id")
    marks = items.filter("kind <> 'word'").select("origin", row, "line_no", "word_no", F.col("kind").alias("defect"))
    # the last word of a text without an end may be cut
    misread = items.filter("kind = 'word' and not last").join(corrections.select("token"), "token", "left_semi")
    return marks.unionByName(misread.select("origin", row, "line_no", "word_no", F.lit("misread").alias("defect")))


_LABELLED = re.compile(r"(\[|\+|-[a-zåäö]|(pl|best|sg|komp|superl|pres|pret|sup|imper)\.)")


def repair_text(text: str, furniture: set[int], joins: set[int], fixes: dict[tuple[int, int], str]) -> list[str]:
    """The paragraphs of a page: furniture left out, broken words joined, misread words replaced.

    A paragraph begins after a blank line, at an indented line, and at a headword with its
    notation after a line that ends a sentence or a reference.
    """
    paragraphs: list[list[str]] = []
    fresh, glue = True, False
    last = ""
    for k, line in enumerate(text.split("\n"), 1):
        if k in furniture:
            continue
        words = line.split()
        if not words:
            fresh = fresh or not glue
            continue
        for j, new in ((j, fixes.get((k, j + 1))) for j in range(len(words))):
            if new:
                core = words[j].strip(EDGE_PUNCTUATION)
                body = core[:-1] if core[-1:] in BREAK_MARKS and len(core) > 2 else core
                new = new.upper() if body.isupper() and len(body) > 1 else new[0].upper() + new[1:] if body[:1].isupper() else new
                words[j] = words[j].replace(body, new, 1)
        ended = last.endswith((".", ")")) or (len(last.split()) > 1 and last.split()[-2] in REFERENCE_MARKS)
        # notation follows a headword, or one of its forms
        headword = len(words) > 1 and (bool(_LABELLED.match(words[1])) or len(words[0]) > 6 and words[1].startswith(words[0][:-1]))
        if not glue and (fresh or line.startswith("  ") or (ended and headword)):
            paragraphs.append([])
        if glue and paragraphs and paragraphs[-1]:
            paragraphs[-1][-1] += words.pop(0)
        paragraphs[-1].extend(words) if paragraphs else paragraphs.append(words)
        fresh, glue, last = False, k in joins, line.rstrip()
        if glue and paragraphs[-1]:
            paragraphs[-1][-1] = paragraphs[-1][-1][:-1]
    return [" ".join(p) for p in paragraphs if p]


def repaired_pages(pages: DataFrame, origin: str, items: DataFrame, corrections: DataFrame) -> DataFrame:
    """(row_id, paragraph, text) of page texts (row_id, text); null and blank texts have no paragraphs."""
    own = items.filter(F.col("origin") == origin)
    fixes = own.filter("kind = 'word' and not last").join(corrections, "token").select("row_id", "line_no", "word_no", F.lit("word").alias("kind"), "word")
    marks = own.filter("kind <> 'word'").select("row_id", "line_no", "word_no", "kind", F.lit(None).cast("string").alias("word"))
    by_page = fixes.unionByName(marks).groupBy("row_id").agg(F.collect_list(F.struct("line_no", "word_no", "kind", "word")).alias("marks"))

    def run(batches):
        for batch in batches:
            out = []
            for row_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                furniture = {m["line_no"] for m in found or [] if m["kind"] == "furniture"}
                joins = {m["line_no"] for m in found or [] if m["kind"] == "hyphen"}
                fix = {(m["line_no"], m["word_no"]): m["word"] for m in found or [] if m["kind"] == "word"}
                out += [(row_id, k, p) for k, p in enumerate(repair_text(text or "", furniture, joins, fix), 1)]
            cells = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int32()), pa.array(cells[2], pa.string())], names=["row_id", "paragraph", "text"])

    return pages.select("row_id", "text").join(by_page, "row_id", "left").mapInArrow(run, "row_id bigint, paragraph int, text string")
