"""One consistent form for text that looks the same but differs in its characters.

A whole Arrow batch becomes one numpy array of code points. Compatibility forms, canonical
decompositions and removals are gathers from lookup tables with expansion offsets; marks
are composed by sorted-pair search over the whole array; the script of each word part is
decided by segment sums. No string function runs per row.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------
#: Characters without ink: removed.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
#: Spaces other than the ordinary one.
SPACES = "               　"
#: Hyphens other than the ordinary one.
HYPHENS = "‐‑‒⁃−﹣－"
#: Letters that look alike: Latin, Cyrillic, Greek (a blank where a script has none).
LOOKALIKES = """
a а α
c с ϲ
d ԁ
e е
h һ
i і ι
j ј ϳ
k   κ
l ӏ
o о ο
p р ρ
q ԛ
s ѕ
u   υ
v ѵ ν
w ԝ
x х χ
y у
A А Α
B В Β
C С Ϲ
E Е Ε
G Ԍ
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N   Ν
O О Ο
P Р Ρ
S Ѕ
T Т Τ
V Ѵ
W Ԝ
X Х Χ
Y У Υ
Z   Ζ
ä ӓ
ö ӧ
ë ё
ï ї
"""
# -------------------------------------------------------------------------------------

_TOP = 0x110000
_LATIN, _CYRILLIC, _GREEK, _OTHER = 1, 2, 3, 4
#: Code points handled at a time, so that long texts don't multiply in memory.
CHUNK = 1 << 21


def _lookalikes() -> list[tuple[str, str, str]]:
    rows = []
    for line in LOOKALIKES.strip("\n").split("\n"):
        cells = (line + "     ")[:5]
        rows.append((cells[0], cells[2].strip(), cells[4].strip()))
    return rows


def _common(cp: int) -> bool:
    """Letters of living alphabets; a rarer look-alike doesn't make a Latin letter doubtful."""
    return 0x370 <= cp < 0x3E0 or 0x400 <= cp < 0x460


class _Tables:
    """Lookup tables over all code points, built by rule from the Unicode database."""

    def __init__(self) -> None:
        first = np.zeros(_TOP, np.int32)
        count = np.ones(_TOP, np.int8)
        flat: list[int] = []
        ccc = np.zeros(_TOP, np.uint8)
        pairs: list[tuple[int, int, int]] = []
        touched = np.zeros(_TOP, bool)
        expanded = np.zeros(_TOP, bool)

        def expand(cp: int, to: str) -> None:
            first[cp], count[cp] = len(flat), len(to)
            flat.extend(map(ord, to))
            touched[cp] = expanded[cp] = True

        flat.append(0)
        for cp in (*range(0xA0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x1F000), *range(0x2F800, 0x2FA20)):
            c = chr(cp)
            ccc[cp] = unicodedata.combining(c)
            touched[cp] |= ccc[cp] > 0
            d = unicodedata.decomposition(c)
            if not d:
                continue
            if d[0] == "<":
                k = unicodedata.normalize("NFKC", c)
                # compatibility forms of letters, digits and full-width punctuation look the same;
                # superscripts, fractions and spacing accents don't
                if d.startswith(("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")) and all(x.isalnum() or d.startswith(("<wide>", "<narrow>")) for x in k):
                    expand(cp, unicodedata.normalize("NFKD", c))
                continue
            expand(cp, unicodedata.normalize("NFD", c))
            parts = d.split()
            if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:
                pairs.append((int(parts[0], 16), int(parts[1], 16), cp))
        for c in INVISIBLE:
            expand(ord(c), "")
        for c in SPACES:
            expand(ord(c), " ")
        for c in HYPHENS:
            expand(ord(c), "-")
        self.first, self.count, self.flat, self.ccc = first, count, np.array(flat, np.uint32), ccc
        self.kept = ~expanded
        pairs.sort()
        self.pair_keys = np.array([a * _TOP + b for a, b, _ in pairs], np.int64)
        self.pair_to = np.array([c for *_, c in pairs], np.uint32)
        touched[0x1160:0x1200] = True  # conjoining letters

        script = np.zeros(_TOP, np.uint8)
        for cp in range(0x41, 0x2E80):
            c = chr(cp)
            if c.isalpha():
                name = unicodedata.name(c, "")
                script[cp] = _LATIN if name.startswith("LATIN") or c in "ªº" else _CYRILLIC if name.startswith("CYRILLIC") else _GREEK if name.startswith("GREEK") else _OTHER
        script[0x2E80:] = _OTHER
        for cp in (0x1E00, 0x1F00):
            for x in range(cp, cp + 0x100):
                name = unicodedata.name(chr(x), "")
                script[x] = _LATIN if name.startswith("LATIN") else _GREEK if name.startswith("GREEK") else script[x]
        self.script = script
        # vague[c]: the letter has a look-alike, so it says little about its part's script
        vague = np.zeros(_TOP, bool)
        to = {s: np.arange(_TOP, dtype=np.uint32) for s in (_LATIN, _CYRILLIC, _GREEK)}
        for latin, cyrillic, greek in _lookalikes():
            row = {_LATIN: latin, _CYRILLIC: cyrillic, _GREEK: greek}
            for s, c in row.items():
                if not c or len(c) != 1 or script[ord(c)] != s:
                    continue
                for target, other in row.items():
                    if other and target != s and script[ord(other)] == target:
                        to[target][ord(c)] = ord(other)
                        vague[ord(c)] |= s != _LATIN or _common(ord(other))
        self.vague, self.to = vague, to
        # a row with none of these characters is plain already
        self.suspect = touched.copy()
        self.suspect[(script == _CYRILLIC) | (script == _GREEK)] = True
        self.suspect[[cp for cp in range(0xC0, 0x2000) if script[cp] == _LATIN and count[cp] > 1 and cp < 0x250]] = False


@cache
def _tables() -> _Tables:
    return _Tables()


def _expand(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code point by its expansion: a gather along expansion offsets."""
    n = np.where(t.kept[cp], 1, t.count[cp]).astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    src = np.repeat(np.arange(len(cp)), n)
    inner = np.arange(total) - np.repeat(ends - n, n)
    base = cp[src]
    return np.where(t.kept[base], base, t.flat[t.first[base] + inner * ~t.kept[base]]), row[src]


def _order_marks(cp: np.ndarray, row: np.ndarray, t: _Tables) -> np.ndarray:
    """Canonical order: within a run of marks, stable by combining class."""
    c = t.ccc[cp]
    wrong = (c[1:] > 0) & (c[:-1] > c[1:]) & (row[1:] == row[:-1])
    if not wrong.any():
        return cp
    run = np.cumsum(np.r_[True, (c[1:] == 0) | (row[1:] != row[:-1])])
    return cp[np.lexsort((np.arange(len(cp)), c, run))]


def _compose(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Compose marks with their starters, all rows at once, until nothing composes."""
    while len(cp):
        c = t.ccc[cp]
        at = np.arange(len(cp))
        starter = np.maximum.accumulate(np.where((c == 0) | np.r_[True, row[1:] != row[:-1]], at, 0))
        prev_c = np.r_[0, c[:-1]]
        # a mark reaches its starter if it's next to it or the mark between has a lower class
        free = (c > 0) & (starter < at) & ((starter == at - 1) | (prev_c < c)) & (t.ccc[cp[starter]] == 0)
        cand = np.flatnonzero(free)
        if not len(cand):
            break
        keys = cp[starter[cand]].astype(np.int64) * _TOP + cp[cand]
        pos = np.searchsorted(t.pair_keys, keys)
        pos[pos == len(t.pair_keys)] = 0
        hit = t.pair_keys[pos] == keys
        cand, pos = cand[hit], pos[hit]
        if not len(cand):
            break
        # of one starter only the first mark composes in a round
        lead = np.r_[True, starter[cand][1:] != starter[cand][:-1]]
        cand, pos = cand[lead], pos[lead]
        cp = cp.copy()
        cp[starter[cand]] = t.pair_to[pos]
        keep = np.ones(len(cp), bool)
        keep[cand] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def _compose_hangul(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining Korean letters compose by arithmetic: lead and vowel, then the tail."""
    if not ((cp >= 0x1161) & (cp <= 0x11C2)).any():
        return cp, row
    same = row[1:] == row[:-1]
    vowel = np.flatnonzero((cp[1:] >= 0x1161) & (cp[1:] <= 0x1175) & (cp[:-1] >= 0x1100) & (cp[:-1] <= 0x1112) & same)
    cp = cp.copy()
    cp[vowel] = 0xAC00 + ((cp[vowel] - 0x1100) * 21 + cp[vowel + 1] - 0x1161) * 28
    keep = np.ones(len(cp), bool)
    keep[vowel + 1] = False
    cp, row = cp[keep], row[keep]
    same = row[1:] == row[:-1]
    whole = (cp[:-1] >= 0xAC00) & (cp[:-1] <= 0xD7A3) & ((cp[:-1] - 0xAC00) % 28 == 0)
    tail = np.flatnonzero((cp[1:] >= 0x11A8) & (cp[1:] <= 0x11C2) & whole & same)
    cp[tail] += cp[tail + 1] - 0x11A7
    keep = np.ones(len(cp), bool)
    keep[tail + 1] = False
    return cp[keep], row[keep]


def _one_script(cp: np.ndarray, row: np.ndarray, t: _Tables) -> np.ndarray:
    """Give every letter the script of its word part.

    A part is a stretch of letters, with `|`, the middle dot and marks inside it not ending it. Its
    script is that of most letters without look-alikes; a mixed part without such letters
    takes the script of most of them in its text, Latin if there are none.
    """
    s = t.script[cp]
    letter = s > 0
    inside = letter | (t.ccc[cp] > 0) | (cp == 0x7C) | (cp == 0xB7)
    part = np.cumsum(np.r_[True, ~inside[1:] | ~inside[:-1] | (row[1:] != row[:-1])]) - 1
    n = int(part[-1]) + 1
    clear = letter & ~t.vague[cp]
    rows = int(row[-1]) + 1
    best, overall = np.zeros(n, np.int64), np.zeros(rows, np.int64)
    which, of_row = np.zeros(n, np.uint8), np.full(rows, _LATIN, np.uint8)
    mixed = np.zeros(n, np.int8)
    for script in (_LATIN, _CYRILLIC, _GREEK):
        mine = s == script
        mixed += np.bincount(part[mine], minlength=n) > 0
        sure = np.bincount(part[mine & clear], minlength=n)
        better = sure > best
        best[better], which[better] = sure[better], script
        sure = np.bincount(row[mine & clear], minlength=rows)
        better = sure > overall
        overall[better], of_row[better] = sure[better], script
    target = np.where(which[part] > 0, which[part], of_row[row])
    out = cp
    todo = letter & (s != target) & (s != _OTHER) & (mixed[part] > 1)
    if todo.any():
        out = cp.copy()
        for script in (_LATIN, _CYRILLIC, _GREEK):
            m = todo & (target == script)
            out[m] = t.to[script][cp[m]]
    return out


def canonical_points(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of code points `cp` belonging to rows `row` (ascending)."""
    t = _tables()
    if not len(cp):
        return cp, row
    cp, row = _expand(cp, row, t)
    if not len(cp):
        return cp, row
    cp = _order_marks(cp, row, t)
    cp, row = _compose_hangul(*_compose(cp, row, t))
    same = _one_script(cp, row, t)
    # a mark may compose with the letter of the right script
    return (cp, row) if same is cp else _compose(same, row, t)


def _points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string array without nulls, and the offsets of its rows in them."""
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    lead = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32), lead[offsets - offsets[0]]


def _to_strings(cp: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    sizes = np.bincount(row, weights=width, minlength=n).astype(np.int64) if len(cp) else np.zeros(n, np.int64)
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def canonical_array(arr: pa.Array) -> pa.Array:
    """The consistent form of every string of an Arrow array; nulls stay null.

    Empty strings stay empty. Rows without any suspect character are passed on untouched.
    """
    whole = arr.cast(pa.large_string())
    valid = np.asarray(whole.is_valid())
    filled = whole.fill_null("") if not valid.all() else whole
    t = _tables()
    cp, offsets = _points(filled)
    sizes = np.diff(offsets)
    bad = np.zeros(len(filled), bool)
    hits = np.flatnonzero(t.suspect[cp]) if len(cp) else np.zeros(0, np.int64)
    bad[np.searchsorted(offsets, hits, side="right") - 1] = True
    if not bad.any():
        return arr
    rows = np.flatnonzero(bad)
    pieces = []
    for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // CHUNK)) + 1):
        n = sizes[part]
        row = np.repeat(np.arange(len(part)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[part], n)
        pieces.append(_to_strings(*canonical_points(cp[at], row), len(part)))
    fixed = pa.concat_arrays(pieces)
    index = np.arange(len(filled))
    index[rows] = len(filled) + np.arange(len(rows))
    out = pa.concat_arrays([filled, fixed]).take(pa.array(index))
    if not valid.all():
        out = pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.large_string()))
    return out.cast(arr.type)


def canonical(column: Column | str) -> Column:
    """The column with every text in one consistent form (see canonical_array).

    Precomposed letters, each in the script of its word part; ordinary hyphens and spaces;
    compatibility forms unfolded; nothing invisible. Case, punctuation, ASCII white space,
    and accents that are meant stay. Null stays null, empty stays empty.
    """

    @F.arrow_udf("string")
    def unify(values: pa.Array) -> pa.Array:
        return canonical_array(values)

    return unify(column)
