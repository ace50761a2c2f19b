"""Raster pages to text: masks, columns, ownership of rows, peeling of glyphs from the left, exact covers, glyph libraries.

Rasters are rows (page, width, height, pixels BINARY of one gray byte each). A page is worked
on as one array within an Arrow batch; pages spread over the cluster. The library of glyphs
goes to the workers and is a fixed set of models.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ocr import components

Glyphs = dict[str, list[tuple[int, int]]]


class Library:
    """Glyphs by the shape of their left edge: what stands in the leftmost column, from its top pixel down."""

    def __init__(self, glyphs: Glyphs) -> None:
        self.by_edge: dict[tuple[int, ...], list[tuple[str, np.ndarray]]] = defaultdict(list)
        self.sizes: dict[str, int] = {}
        for label, points in sorted(glyphs.items()):
            p = np.array(sorted(set(points)), np.int64).reshape(-1, 2)
            if not len(p):
                continue
            edge = np.sort(p[p[:, 0] == p[:, 0].min(), 1])
            anchored = p - (p[:, 0].min(), edge[0])
            self.by_edge[tuple((edge - edge[0]).tolist())].append((label, anchored))
            self.sizes[label] = len(p)
        for models in self.by_edge.values():
            models.sort(key=lambda m: (-len(m[1]), m[0]))

    def at(self, ink: np.ndarray, x: int, y: int) -> list[tuple[str, np.ndarray]]:
        """The glyphs, largest first, whose every pixel is inked when their left edge begins at (x, y)."""
        h, w = ink.shape
        column = set((np.flatnonzero(ink[:, x]) - y).tolist())
        found = []
        for edge, models in self.by_edge.items():
            if not column.issuperset(edge):
                continue
            for label, p in models:
                xs, ys = p[:, 0] + x, p[:, 1] + y
                if xs.max() < w and ys.min() >= 0 and ys.max() < h and ink[ys, xs].all():
                    found.append((label, p))
        return sorted(found, key=lambda m: (-len(m[1]), m[0]))


def bands(filled: np.ndarray, gap: int = 0) -> list[tuple[int, int]]:
    """Stretches [start, end) of true values, joined over at most `gap` false ones."""
    at = np.flatnonzero(filled)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > gap + 1)
    return list(zip(at[np.r_[0, breaks + 1]].tolist(), (at[np.r_[breaks, len(at) - 1]] + 1).tolist()))


def peel(ink: np.ndarray, library: Library) -> tuple[list[tuple[int, int, str]], int]:
    """(x, y, label) of the glyphs of a row, taken from the left one by one, and how many pixels no glyph explains.

    The top pixel of the leftmost inked column belongs to a glyph whose left edge begins
    there; the largest that fits is taken and its ink removed.
    """
    rest = ink.copy()
    out, lost = [], 0
    columns = rest.sum(axis=0)
    x = 0
    while x < rest.shape[1]:
        if not columns[x]:
            x += 1
            continue
        y = int(np.argmax(rest[:, x]))
        fits = library.at(rest, x, y)
        if fits:
            label, p = fits[0]
            rest[p[:, 1] + y, p[:, 0] + x] = False
            np.subtract.at(columns, p[:, 0] + x, 1)
            out.append((x, y, label))
        else:
            rest[y, x] = False
            columns[x] -= 1
            lost += 1
    return out, lost


def exact_cover(ink: np.ndarray, library: Library, expected: list[str] | None = None, most: int = 100_000) -> list[tuple[int, int, str]] | None:
    """Glyphs that explain every pixel of the ink once, those of `expected` in order if given; null if there are none within `most` tries.

    Blank columns split the ink into groups that no glyph crosses; with nothing expected, each
    group is covered apart.
    """
    tries = 0

    def search(rest: np.ndarray, k: int) -> list[tuple[int, int, str]] | None:
        nonlocal tries
        columns = np.flatnonzero(rest.any(axis=0))
        if not len(columns):
            return [] if expected is None or k == len(expected) else None
        tries += 1
        if tries > most:
            return None
        x = int(columns[0])
        y = int(np.argmax(rest[:, x]))
        for label, p in library.at(rest, x, y):
            if expected is not None and (k >= len(expected) or expected[k] != label):
                continue
            left = rest.copy()
            left[p[:, 1] + y, p[:, 0] + x] = False
            more = search(left, k + 1)
            if more is not None:
                return [(x, y, label), *more]
        return None

    if expected is not None:
        return search(ink, 0)
    out = []
    for a, b in bands(ink.any(axis=0)):
        tries = 0
        group = search(ink[:, a:b], 0)
        if group is None:
            return None
        out += [(x + a, y, label) for x, y, label in group]
    return out


def without_ornaments(rasters: DataFrame, width: int, height: int, ink: int, density: float, threshold: int = 210) -> DataFrame:
    """Rasters with every component whitened that is at least so wide, high and inked and fills this share of its box."""
    boxes = components(rasters, threshold).filter(
        (F.col("right") - F.col("left") >= width) & (F.col("bottom") - F.col("top") >= height) & (F.col("ink") >= ink)
        & (F.col("ink") >= density * (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")))
    )
    by_page = boxes.groupBy("page").agg(F.collect_list(F.struct("left", "top", "right", "bottom")).alias("__boxes"))

    def run(batches):
        for pdf in batches:
            new = []
            for w, h, pixels, mine in zip(pdf.width, pdf.height, pdf.pixels, pdf["__boxes"]):
                a = np.frombuffer(pixels, np.uint8).reshape(h, w).copy()
                for b in mine if mine is not None else ():
                    a[b["top"] : b["bottom"], b["left"] : b["right"]] = 255
                new.append(a.tobytes())
            yield pdf.assign(pixels=new)[["page", "width", "height", "pixels"]]

    return rasters.select("page", "width", "height", "pixels").join(by_page, "page", "left").mapInPandas(run, "page bigint, width int, height int, pixels binary")


def owned_pixels(ink: DataFrame, rows: DataFrame) -> DataFrame:
    """Ink (page, x, y) with the `band` of `rows` (page, band, top, bottom) that holds its line; null outside of all.

    Bands are laid out line by line, so lines meet by equality.
    """
    lines = rows.select("page", "band", F.explode(F.sequence("top", F.col("bottom") - 1)).alias("y"))
    return ink.join(lines, ["page", "y"], "left").select("page", "x", "y", "band")


_GLYPH_ROWS = "page bigint, column int, row int, x int, y int, label string, lost int"


def read_pages(rasters: DataFrame, glyphs: Glyphs, threshold: int = 210, column_gap: int = 20, row_gap: int = 0) -> DataFrame:
    """(page, column, row, x, y, label, lost): the glyphs of every row, peeled from the left.

    Blank stretches wider than `column_gap` part columns, blank lines part the rows of each. A
    row with ink that no glyph explains says how many pixels in `lost`; a row without any
    glyph has one line without label. Empty pages have no rows.
    """
    library = Library(glyphs)

    def run(batches):
        for pdf in batches:
            out = []
            for page, w, h, pixels in zip(pdf.page, pdf.width, pdf.height, pdf.pixels):
                ink = np.frombuffer(pixels, np.uint8).reshape(h, w) < threshold
                for c, (left, right) in enumerate(bands(ink.any(axis=0), column_gap)):
                    for r, (top, bottom) in enumerate(bands(ink[:, left:right].any(axis=1), row_gap)):
                        found, lost = peel(ink[top:bottom, left:right], library)
                        out += [(page, c, r, x + left, y + top, label, lost) for x, y, label in found] or [(page, c, r, left, top, None, lost)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _GLYPH_ROWS.split(", ")]).astype({"page": "int64"})

    return rasters.select("page", "width", "height", "pixels").mapInPandas(run, _GLYPH_ROWS)


def row_texts(read: DataFrame) -> DataFrame:
    """(page, column, row, text, lost): the labels of every row from left to right."""
    labels = F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("x", "y", "label")))), lambda s: s["label"])
    return read.groupBy("page", "column", "row").agg(F.array_join(labels, "").alias("text"), F.max("lost").alias("lost"))


def page_results(read: DataFrame) -> DataFrame:
    """(page, rows, glyphs, unsolved_rows, lost): what reading a page came to."""
    rows = read.groupBy("page", "column", "row").agg(F.count("label").alias("glyphs"), F.max("lost").alias("lost"))
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("rows"), F.sum("glyphs").alias("glyphs"), F.count_if(F.col("lost") > 0).alias("unsolved_rows"), F.sum("lost").alias("lost"))


def merged_models(models: DataFrame) -> DataFrame:
    """(pixels, model_id, label, sources, conflict) of models (model_id, label, pixels, source): equal pixels once.

    The smallest id is kept, its label with it; sources are united; models of other labels make a conflict.
    """
    key = F.array_sort(F.array_distinct("pixels")).alias("pixels")
    g = models.select(key, "model_id", "label", "source").groupBy("pixels").agg(
        F.min_by(F.struct("model_id", "label"), "model_id").alias("m"), F.array_sort(F.collect_set("source")).alias("sources"), (F.count_distinct("label") > 1).alias("conflict")
    )
    return g.select("pixels", "m.model_id", "m.label", "sources", "conflict")


# ---- drawn pages: for round trips --------------------------------------------------------

GLYPH_HEIGHT, GLYPH_WIDTH = 7, 5


@cache
def drawn_glyph(letter: str) -> tuple[tuple[int, int], ...]:
    """A shape for a letter by rule: an upright, and to its right the bits of its code point, each column closed by a foot."""
    code = ord(letter)
    points = [(0, y) for y in range(GLYPH_HEIGHT)]
    for k in range((GLYPH_WIDTH - 1) * (GLYPH_HEIGHT - 2)):
        if code >> k & 1:
            points.append((1 + k // (GLYPH_HEIGHT - 2), 1 + k % (GLYPH_HEIGHT - 2)))
    return tuple(points + [(x, GLYPH_HEIGHT - 1) for x in range(1, GLYPH_WIDTH)])


def draw_words(words: DataFrame, id_col: str, word: str) -> DataFrame:
    """A raster for every word, its letters drawn side by side with a blank column between them."""

    def run(batches):
        for pdf in batches:
            out = []
            for page, text in zip(pdf[id_col], pdf[word]):
                a = np.full((GLYPH_HEIGHT + 4, 2 + len(text) * (GLYPH_WIDTH + 1)), 255, np.uint8)
                for k, letter in enumerate(text):
                    for x, y in drawn_glyph(letter):
                        a[2 + y, 1 + k * (GLYPH_WIDTH + 1) + x] = 0
                out.append((page, a.shape[1], a.shape[0], a.tobytes()))
            yield pd.DataFrame(out, columns=["page", "width", "height", "pixels"])

    return words.select(F.col(id_col).cast("bigint").alias(id_col), word).filter(F.col(word).isNotNull()).mapInPandas(run, "page bigint, width int, height int, pixels binary")
