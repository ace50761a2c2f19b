"""How the word classes read their notation: chains of grammars, tried in order.

A grammar says which slot a label or a place means. Notations repeat, so a grammar reads each
distinct one once, in Arrow batches; a notation that no grammar of its class understands in
every branch has no reading.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa


@dataclass(frozen=True)
class Grammar:
    """labels: marks and their slots; places: slots of unlabelled forms in order, the last one repeating;
    keep: slots that later unlabelled forms stay in; alternatives: marks that put the next form into the slot before;
    passing: marks that say nothing about slots; editorial: whether usage notes pass too; bare: whether a label alone
    means the base; sizes: how many forms there must be; word: the slot of a lone word; loose: whether unknown marks pass;
    marked: whether there must be a label."""

    name: str
    labels: dict[str, str]
    places: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    alternatives: tuple[str, ...] = ("el.", "h", "ibl.")
    passing: tuple[str, ...] = ("i:", "som:", "används:", "anv.")
    editorial: bool = True
    bare: bool = False
    sizes: tuple[int, ...] = ()
    word: str | None = None
    loose: bool = False
    marked: bool = False


# ---- fixed values: labels, slots and marks of the word classes, and notes of usage ------
NOTES = ("högt.", "vanl.", "åld.", "t.ex.", "f.")
ALTERNATIVES = ("el.", "h", "ibl.")
NOUN = {"pl.": "pl_indef", "best.": "sg_def", "best.pl.": "pl_def", "sg.": "sg_def"}
POSITIVE = {"n.": "neuter", "neutr.": "neuter", "pl.": "definite_or_plural", "best.": "definite_or_plural"}
COMPARED = {"komp.": "comparative", "superl.": "superlative"}
VERB = {"pres.": "present", "pret.": "preterite", "sup.": "supine", "imper.": "imperative", "perf.": "participle_common", "part.": "participle_common", "n.": "participle_neuter"}
NOUN_PASSING = ("i:", "som:", "används:", "anv.", "vard.", "kan:", "användas:")
CHAINS = {
    "NOUN": (
        Grammar("noun", NOUN, ("sg_def", "pl_indef"), ("pl_indef", "pl_def"), passing=NOUN_PASSING),
        Grammar("noun_loose", NOUN, ("sg_def", "pl_indef"), ("pl_indef", "pl_def"), passing=NOUN_PASSING, loose=True),
    ),
    "ADJ": (
        Grammar("adjective_sequence", {}, ("neuter", "definite_or_plural", "comparative", "superlative"), alternatives=(), sizes=(1, 2, 4), word="definite_or_plural"),
        Grammar("adjective_bare", {"best.": "definite_or_plural"}, bare=True, sizes=(0,)),
        Grammar("adjective_rich", {"best.": "masculine_definite", "pl.": "definite_or_plural"}, ("neuter", "comparative", "superlative"), sizes=(5,), marked=True),
        Grammar("adjective_positive", POSITIVE, ("neuter", "definite_or_plural"), alternatives=("el.",), passing=("och:",), marked=True),
        Grammar("adjective_compared", POSITIVE | COMPARED, ("neuter", "definite_or_plural"), alternatives=("el.", "h"), marked=True),
        Grammar("adjective_unlabelled", {}, ("neuter", "comparative", "superlative"), alternatives=("h",)),
        Grammar("adjective_partial", {"superl.": "superlative"}, ("definite_or_plural",), alternatives=("el.",), passing=("vard.",), marked=True),
        Grammar("adjective", POSITIVE | COMPARED, ("neuter", "definite_or_plural", "comparative", "superlative"), bare=True),
    ),
    "VERB": (
        Grammar("verb_basic", {}, ("preterite", "supine"), alternatives=(), passing=(), editorial=False, sizes=(2,)),
        Grammar("verb_word", {}, alternatives=(), passing=(), editorial=False, sizes=(1,), word="explicit_form"),
        Grammar("verb", VERB, ("preterite", "supine", "participle_common", "participle_neuter", "participle_plural"), alternatives=("el.", "h"), passing=("ibl.",), editorial=False, bare=True),
        Grammar("verb_loose", VERB, ("preterite", "supine"), alternatives=("el.", "h"), passing=("ibl.",), loose=True),
    ),
    "PRON": (
        Grammar(
            "pronoun", {"n.": "neuter_singular", "pl.": "plural", "gen.": "genitive", "mask.": "masculine", "best.": "definite", "objektsform:": "object", "superl.": "superlative"},
            ("neuter_singular", "plural"), editorial=False,
        ),
    ),
    "NUM": (Grammar("numeral", {"n.": "neuter_singular", "best.": "definite", "ordn.": "ordinal"}, ("ordinal",), editorial=False),),
    "ADV": (Grammar("adverb", COMPARED, ("comparative", "superlative"), bare=True),),
    "DET": (Grammar("article", {"n.": "neuter_singular", "pl.": "plural"}, ("neuter_singular", "plural"), editorial=False),),
    "PART": (Grammar("particle", {}, ("variant",), editorial=False),),
}
#: Labels of two words that are one.
JOINED = (("best.", "pl."),)
# ----------------------------------------------------------------------------------------

Operation = tuple[str, str]
Assigned = tuple[str, str, str, str, str | None]  # slot, token, kind, value, alternative


def scan(branch: str) -> list[str] | None:
    """The tokens of a cleaned branch, labels of two words joined; null if there are none or a mark belongs to none."""
    spaced = branch.replace(";", " ; ").replace(",", " , ")
    out: list[str] = []
    for chunk in spaced.split():
        head, plus, tail = (chunk, "", "") if chunk[0] in "+-" else chunk.partition("+")
        out += [x for x in (head, plus + tail) if x]
    if not out or any("_" in t for t in out):
        return None
    for first, second in JOINED:
        k = 0
        while k + 1 < len(out):
            if out[k].lower() == first and out[k + 1].lower() == second:
                out[k : k + 2] = [first + second]
            k += 1
    return out


def read_token(token: str) -> list[Operation] | None:
    """What a form token does to a base, `a(b)c` in both ways; null for marks and anything else."""
    if token.startswith("(") and token.endswith(")"):
        token = token[1:-1]
    if token.count("(") == 1 and token.count(")") == 1 and (i := token.index("(")) < (j := token.index(")")) - 1:
        variants = list(dict.fromkeys((token[:i] + token[j + 1 :], token[:i] + token[i + 1 : j] + token[j + 1 :])))
    else:
        variants = [token]
    out = [_operation(v) for v in variants]
    return None if None in out else out


def _operation(raw: str) -> Operation | None:
    if raw == "+":
        return "unchanged", ""
    sign = raw[:1]
    if sign in ("+", "-"):
        rest = raw[1:].removeprefix("-") if sign == "+" else raw[1:]
        return (("append" if sign == "+" else "replace_tail"), rest) if rest else None
    return None if not raw or raw[-1] in ".:" or not raw[0].isalnum() else ("explicit", raw)


def assign(tokens: list[str], g: Grammar) -> list[Assigned] | None:
    """The operations of a branch with their slots by a grammar, or null if it doesn't understand them.

    An alternative mark puts the next form into the slot before it and takes no place; a label
    names the next form's slot. A label without a form is an error, or, alone, the base.
    """
    out: list[Assigned] = []
    slot = last = other = None
    place = forms = 0
    labelled = False
    for token in tokens:
        low = token.lower().removeprefix("(").removesuffix(")")
        if token in ",;" or low in g.passing or (g.editorial and (low in NOTES or low.endswith(":")) and low not in g.labels):
            continue
        if low in g.alternatives:
            if last is None:
                return None
            slot, other = last, low
            continue
        if low in g.labels:
            slot, other, labelled = g.labels[low], None, True
            continue
        ops = None if low in ALTERNATIVES else read_token(token)
        if ops is None:
            if g.loose and low.endswith((".", ":")) and low not in ALTERNATIVES:
                continue
            return None
        forms += 1
        if slot is None:
            if g.word and ops[0][0] == "explicit" and len(tokens) == 1:
                slot = g.word
            elif not g.places:
                return None
            else:
                slot = last if last in g.keep else g.places[min(place, len(g.places) - 1)]
        out += [(slot, token, kind, value, other) for kind, value in ops]
        place += other is None
        last, slot, other = slot, None, None
    if slot is not None:
        return [(slot, "+", "unchanged", "", None)] if g.bare and not out and other is None else None
    return out if out and (not g.sizes or forms in g.sizes) and (labelled or not g.marked) else None


def read_notation(cls: str, cleaned: str, open_ended: bool = False) -> tuple[str, list[list[Assigned]]] | None:
    """The grammar that understands all branches of a cleaned notation, and what they mean.

    A notation that its field cut (`open_ended`) is read as far as it can be: by its longest
    beginning that is understood.
    """
    parts = [b.strip() for b in f" {cleaned} ".replace(" _ ", "\0").split("\0")]
    branches = [scan(b) for b in parts]
    if None in branches:
        return None
    while branches:
        for g in CHAINS.get(cls, ()):
            read = [assign(b, g) for b in branches]
            if None not in read:
                return g.name, read
        if not open_ended:
            return None
        branches[-1] = branches[-1][:-1]
        if not branches[-1]:
            branches.pop()
    return None


ASSIGNED = "array<struct<slot:string,token:string,kind:string,value:string,alternative:string>>"
_TYPE = pa.list_(pa.struct([pa.field(n, pa.string()) for n in ("slot", "token", "kind", "value", "alternative")]))
READ = f"cls string, notation string, rule string, branch int, ops {ASSIGNED}"


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, notation, rule, branch, ops) of batches of (cls, notation, cleaned, open_ended)."""
    names = ("slot", "token", "kind", "value", "alternative")
    for batch in batches:
        out = []
        for cls, notation, cleaned, open_ended in zip(*(c.to_pylist() for c in batch.columns)):
            read = read_notation((cls or "").upper(), cleaned or "", bool(open_ended))
            if read:
                out += [(cls, notation, read[0], k, [dict(zip(names, a)) for a in ops]) for k, ops in enumerate(read[1])]
        cells = list(zip(*out)) if out else [[] for _ in range(5)]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), _TYPE]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=["cls", "notation", "rule", "branch", "ops"])
