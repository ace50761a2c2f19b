"""Raster to text rows: ink, components, bands, exact template placement, selection.

Rasters are rows (page, width, height, pixels BINARY of one gray byte each). Everything that
is local to a page runs Arrow batch by batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ink_pixels(rasters: DataFrame, threshold: int = 210) -> DataFrame:
    """(page, x, y) of pixels darker than `threshold`."""

    def run(batches):
        for pdf in batches:
            frames = [pd.DataFrame({"page": [], "x": [], "y": []})]
            for page, w, pixels in zip(pdf.page, pdf.width, pdf.pixels):
                at = np.flatnonzero(np.frombuffer(pixels, np.uint8) < threshold)
                frames.append(pd.DataFrame({"page": page, "x": at % w, "y": at // w}))
            yield pd.concat(frames).astype({"page": "int64", "x": "int32", "y": "int32"})

    return rasters.select("page", "width", "pixels").mapInPandas(run, "page bigint, x int, y int")


def components(rasters: DataFrame, threshold: int = 210) -> DataFrame:
    """(page, component, left, top, right, bottom, ink) of 4-connected ink, by union of runs of a row with the row above."""

    def label(ink: np.ndarray):
        parent: list[int] = []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        runs, above = [], []
        for y in range(ink.shape[0]):
            edge = np.flatnonzero(np.diff(np.r_[0, ink[y].astype(np.int8), 0]))
            here = []
            for a, b in zip(edge[::2], edge[1::2]):
                i = len(parent)
                parent.append(i)
                runs.append((y, int(a), int(b)))
                here.append((int(a), int(b), i))
                for c, d, j in above:
                    if c < b and a < d:
                        parent[root(i)] = root(j)
            above = here
        return runs, [root(i) for i in range(len(parent))]

    def run(batches):
        for pdf in batches:
            out = []
            for page, w, h, pixels in zip(pdf.page, pdf.width, pdf.height, pdf.pixels):
                runs, roots = label((np.frombuffer(pixels, np.uint8) < threshold).reshape(h, w))
                boxes: dict[int, list[int]] = {}
                for (y, a, b), r in zip(runs, roots):
                    box = boxes.setdefault(r, [a, y, b, y + 1, 0])
                    box[0], box[2], box[3], box[4] = min(box[0], a), max(box[2], b), y + 1, box[4] + b - a
                out += [(page, k, *boxes[r]) for k, r in enumerate(sorted(boxes))]
            yield pd.DataFrame(out, columns=["page", "component", "left", "top", "right", "bottom", "ink"]).astype("int64")

    return rasters.select("page", "width", "height", "pixels").mapInPandas(run, "page bigint, component bigint, left bigint, top bigint, right bigint, bottom bigint, ink bigint")


def row_bands(ink: DataFrame, gap: int = 1) -> DataFrame:
    """(page, band, top, bottom): stretches of inked lines at most `gap` apart."""
    from .ordered import islands

    lines = ink.select("page", "y").distinct()
    banded = islands(lines, ["page"], ["y"], F.col("y") - F.col("prev_y") > gap, "band")
    return banded.groupBy("page", "band").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"))


def left_profile(ink: DataFrame) -> DataFrame:
    """(page, y, left): the leftmost ink of every line."""
    return ink.groupBy("page", "y").agg(F.min("x").alias("left"))


def exact_placements(rasters: DataFrame, glyphs: dict[str, list[tuple[int, int]]], threshold: int = 210) -> DataFrame:
    """(page, label, x, y, size) where every pixel (dx, dy) of a glyph is inked; (x, y) is the place of (0, 0).

    A page is one array; a glyph is tested at all its places at once, as the conjunction of the
    page shifted by each of its pixels. The library goes to the workers and is a fixed set of models.
    """
    library = {k: sorted(set(v)) for k, v in glyphs.items() if v}

    def run(batches):
        for pdf in batches:
            out = []
            for page, w, h, pixels in zip(pdf.page, pdf.width, pdf.height, pdf.pixels):
                ink = np.frombuffer(pixels, np.uint8).reshape(h, w) < threshold
                for label, points in library.items():
                    xs, ys = [p[0] for p in points], [p[1] for p in points]
                    gw, gh = max(xs) - min(xs), max(ys) - min(ys)
                    if gw >= w or gh >= h:
                        continue
                    fits = np.ones((h - gh, w - gw), bool)
                    for dx, dy in points:
                        fits &= ink[dy - min(ys) : dy - min(ys) + h - gh, dx - min(xs) : dx - min(xs) + w - gw]
                        if not fits.any():
                            break
                    out += [(page, label, int(x) - min(xs), int(y) - min(ys), len(points)) for y, x in zip(*np.nonzero(fits))]
            yield pd.DataFrame(out, columns=["page", "label", "x", "y", "size"])

    return rasters.select("page", "width", "height", "pixels").mapInPandas(run, "page bigint, label string, x int, y int, size int")


def disjoint_row(placements: DataFrame, widths: DataFrame) -> DataFrame:
    """The heaviest set of placements of a row (page, y) that don't overlap in x: weighted interval scheduling.

    Weight is the number of pixels; on ties the placement further left, then the smaller label.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["end", "x", "label"]).reset_index(drop=True)
        ends = p.end.to_numpy()
        best, take = [0], []
        for i, r in enumerate(p.itertuples()):
            j = int(np.searchsorted(ends[:i], r.x, side="right"))
            with_it = best[j] + r.size
            take.append((with_it > best[i], j))
            best.append(max(best[i], with_it))
        keep, i = [], len(p)
        while i:
            if take[i - 1][0]:
                keep.append(i - 1)
                i = take[i - 1][1]
            else:
                i -= 1
        return p.loc[sorted(keep), ["page", "y", "x", "label"]]

    rows = placements.join(F.broadcast(widths), "label").withColumn("end", F.col("x") + F.col("width"))
    return rows.groupBy("page", "y").applyInPandas(pick, "page bigint, y int, x int, label string")


def row_text(chosen: DataFrame) -> DataFrame:
    """(page, y, text): the labels of a row from left to right."""
    return chosen.groupBy("page", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "label"))), lambda s: s["label"]), "").alias("text"))
