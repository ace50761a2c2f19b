"""Several values packed in one field: dialect selection by description length, then parsing.

A dialect is a set of separators and a set of quoting styles. Every field is parsed under
every dialect whose separators and quotes occur in it; the values of all parses are coded
by a first-order model over token classes, whose counts come from all fields (one weighted
vote per parse, added up across the cluster); the cheapest dialect then parses the field.
The class alphabet is bounded: labels, fixed marks and the MAX_SUFFIXES most frequent short
suffixes (any other is coded in raw letters), so the model that goes to the workers has at
most (MAX_SUFFIXES + 40) ** 2 entries whatever the data. Equal fields are parsed once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard

#: Fixed values of the notation: labels that stand before a form, separating words, nulls.
LABELS = ("pl.", "best.", "sg.", "komp.", "superl.", "n.", "pres.", "pret.", "sup.", "imper.")
WORD_SEPARATORS = ("el.", "ibl.", "_")
MARK_SEPARATORS = (",", ";", "/", "|")
NO_VALUES = ("(null)", "null")
QUOTES = {'"': '"', "“": "”", "»": "«"}

SUFFIX_LETTERS = 5
MAX_SUFFIXES = 500
#: Different fields that a worker remembers.
REMEMBERED = 50_000
#: A token of no known class is coded in raw bytes.
_CHAR_BITS = 8.0
_DIALECT_BITS = 2.0
_SPACE = re.compile(r"\s+")
_LABEL = re.compile("(?:" + "|".join(re.escape(x) for x in sorted(LABELS, key=len, reverse=True)) + ")")
_WORD_SEP = {w: re.compile(r"(?<!\S)" + re.escape(w) + (r"(?!\S)" if w == "_" else "")) for w in WORD_SEPARATORS}
_SUFFIX = re.compile(r"[+-][a-zåäö()]{0,%d}$" % SUFFIX_LETTERS)
_WORD = re.compile(r"\w[\w'()´-]*$")


def split_pieces(text: str, seps: frozenset[str], quotes: frozenset[str], spaced: bool) -> list[tuple[str, bool]]:
    """The pieces of `text` under one dialect, each with whether it was quoted.

    Square brackets and quoted stretches are whole; a quote opens only at the start of a
    piece, or after white space where that separates values (`spaced`), and only if it is
    closed; a doubled straight quote inside stands for one.
    """
    out: list[tuple[str, bool]] = []
    start = i = 0
    n = len(text)

    def flush(end: int) -> None:
        piece = text[start:end].strip()
        if piece:
            out.append((piece, False))

    while i < n:
        c = text[i]
        if c == "[" and (j := text.find("]", i)) > 0:
            i = j + 1
            continue
        if c in quotes and (not text[start:i].strip() or (spaced and text[i - 1].isspace())):
            end = _closing(text, i)
            if end:
                flush(i)
                body = text[i + 1 : end - 1]
                out.append((body.replace('""', '"') if c == '"' else body, True))
                start = i = end
                continue
        if c in seps:
            flush(i)
            i += 1
            start = i
            continue
        hit = next((w for w in WORD_SEPARATORS if w in seps and _WORD_SEP[w].match(text, i)), None)
        if hit:
            flush(i)
            i += len(hit)
            start = i
            continue
        i += 1
    flush(n)
    return out


def _closing(text: str, i: int) -> int:
    """The place after the quote that closes the one at `i`, or 0."""
    q = QUOTES[text[i]]
    j = i + 1
    while (j := text.find(q, j)) >= 0:
        if q == text[i] and text[j + 1 : j + 2] == q:
            j += 2
            continue
        return j + 1
    return 0


def piece_tokens(piece: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, text) of the labels, brackets and forms of an unquoted piece."""
    out = []
    i, n = 0, len(piece)
    while i < n:
        if piece[i].isspace():
            i += 1
            continue
        if piece[i] == "[" and (j := piece.find("]", i)) > 0:
            out.append(("bracket", i, j + 1, piece[i : j + 1]))
            i = j + 1
            continue
        if m := _LABEL.match(piece, i):
            out.append(("label", i, m.end(), m.group()))
            i = m.end()
            continue
        j = i
        while j < n and not piece[j].isspace() and piece[j] != "[":
            j += 1
        j = max(j, i + 1)
        out.append(("form", i, j, piece[i:j]))
        i = j
    return out


def piece_values(piece: str) -> list[str]:
    """The values of an unquoted piece as written: labels, one form token, its bracket."""
    values, begin, end = [], None, None
    for kind, a, b, _ in piece_tokens(piece):
        if kind == "label":
            if end is not None:
                values.append(piece[begin:end])
                begin = end = None
            begin = a if begin is None else begin
        elif kind == "form":
            if end is not None:
                values.append(piece[begin:end])
                begin = None
            begin, end = (a if begin is None else begin), b
        elif end is not None:
            values.append(piece[begin:b])
            begin = end = None
    if end is not None:
        values.append(piece[begin:end])
    return [v for v in values if v not in NO_VALUES and v not in WORD_SEPARATORS]


def _classes(piece: str, quoted: bool, suffixes: frozenset[str]) -> list[tuple[str, float]]:
    """The token classes that code a value, each with the bits its class leaves open."""
    out: list[tuple[str, float]] = [("<q>", 0.0)] if quoted else []
    for kind, _, _, t in piece_tokens(piece):
        if kind == "label":
            out.append((t, 0.0))
            continue
        if kind == "bracket":
            out.append(("<b>", 0.0))
            continue
        mark = t[-1] if t[-1] in MARK_SEPARATORS and len(t) > 1 else ""
        t = t[: len(t) - len(mark)]
        if t in suffixes:
            out.append((t, 0.0))
        elif _WORD.match(t):
            out.append(("<w>", 0.0))
        elif t in WORD_SEPARATORS or t in MARK_SEPARATORS:
            out.append((t, 0.0))
        else:
            out.append(("<x>", _CHAR_BITS * len(t)))
        if mark:
            out.append((mark, 0.0))
    out.append(("<end>", 0.0))
    return out


def dialects(text: str) -> list[tuple[frozenset[str], frozenset[str]]]:
    """All dialects made of the separators and quotes that occur in `text`."""
    bare = text.strip()
    seps = [m for m in MARK_SEPARATORS if m in bare]
    seps += [w for w in WORD_SEPARATORS if w in bare and _WORD_SEP[w].search(bare)]
    if _SPACE.search(bare):
        seps.append(" ")
    quotes = [q for q in QUOTES if q in bare]
    return [
        (frozenset(s), frozenset(q))
        for k in range(len(quotes), -1, -1)
        for q in combinations(quotes, k)
        for j in range(len(seps), -1, -1)
        for s in combinations(seps, j)
    ]


def _parse(text: str, seps: frozenset[str], quotes: frozenset[str]) -> list[tuple[str, bool]]:
    """Pieces under a dialect; white space separates values, not a label from its form."""
    spaced = " " in seps
    pieces = split_pieces(text, seps - {" "}, quotes, spaced)
    if not spaced:
        return pieces
    return [p for body, quoted in pieces for p in ([(body, quoted)] if quoted else [(v, False) for v in piece_values(body) or [body]])]


def _choose(text: str, cost: dict[tuple[str, str], float], unseen: float, suffixes: frozenset[str]) -> list[tuple[str, bool]]:
    best, chosen = math.inf, [(text.strip(), False)]
    for seps, quotes in dialects(text):
        pieces = _parse(text, seps, quotes)
        bits = _DIALECT_BITS * (len(seps) + len(quotes))
        for body, quoted in pieces:
            last = "<start>"
            for cls, extra in _classes(body, quoted, suffixes):
                bits += cost.get((last, cls), unseen) + extra
                last = cls
            if bits >= best:
                break
        if bits < best:
            best, chosen = bits, pieces
    return chosen


def _suffix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[str] = Counter()
        for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for t in re.split(r"[\s,;/|\"“”»«\[\]]+", text):
                if _SUFFIX.match(t):
                    seen[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["suffix", "n"])


def value_code(df: DataFrame, column: str) -> tuple[dict[tuple[str, str], float], float, frozenset[str]]:
    """Bits of each class after each other, from all fields of `column`, those of an unseen pair, and the suffixes that are classes."""
    texts = df.select(F.col(column).alias("__text")).filter(F.trim("__text") != "")
    texts = cut(texts.groupBy("__text").agg(F.count(F.lit(1)).alias("__n")), "fields")
    often = texts.mapInArrow(_suffix_batches, "suffix string, n bigint").groupBy("suffix").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "suffix")
    suffixes = frozenset(r.suffix for r in often.limit(MAX_SUFFIXES).collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter[tuple[str, str]] = Counter()
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                options = dialects(text)
                for seps, quotes in options:
                    for body, quoted in _parse(text, seps, quotes):
                        last = "<start>"
                        for cls, _ in _classes(body, quoted, suffixes):
                            votes[last, cls] += n / len(options)
                            last = cls
            keys = list(votes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string()), pa.array([votes[k] for k in keys], pa.float64())], names=["prev", "cls", "votes"]
            )

    counts = texts.mapInArrow(count, "prev string, cls string, votes double").groupBy("prev", "cls").agg(F.sum("votes").alias("votes")).collect()
    discard(texts)
    totals: Counter[str] = Counter()
    for r in counts:
        totals[r.prev] += r.votes
    alphabet = len({r.cls for r in counts}) + 1
    cost = {(r.prev, r.cls): math.log2((totals[r.prev] + alphabet) / (r.votes + 1)) for r in counts}
    return cost, math.log2(max(totals.values(), default=1) + alphabet), suffixes


def unpack_values(df: DataFrame, key: str, column: str, least: int = 1) -> DataFrame:
    """One row (key, position, value) per value of each field with at least `least` values.

    Null, empty and blank fields, `(null)` and `null` have no values. Positions run from 1.
    Other columns of `df` are ignored, repeated rows are unpacked each. Fields of any
    length are parsed whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(value_code(df, column))
    kind = df.schema[key].dataType

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}

        def values_of(text: str) -> list[str]:
            if text not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = []
                for body, quoted in _choose(text, *shared.value):
                    if quoted:
                        found += [body] if body.strip() else []
                    else:
                        found += piece_values(body)
                known[text] = found
            return known[text]

        for batch in batches:
            rows, positions, values = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text or text.strip() in NO_VALUES or not text.strip():
                    continue
                found = values_of(text)
                if len(found) >= least:
                    rows += [row] * len(found)
                    positions += range(1, len(found) + 1)
                    values += found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(positions, pa.int32()), pa.array(values, pa.string())],
                names=[key, "position", "value"],
            )

    return df.select(key, column).mapInArrow(unpack, f"`{key}` {kind.simpleString()}, position int, value string")
