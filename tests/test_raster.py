"""Rasters: peeling, covers, masks, ownership, models."""

import numpy as np
from helpers import rows

from lexloom.operators import ocr, raster

GLYPHS = {"T": [(0, 0), (1, 0), (2, 0), (1, 1), (1, 2)], "I": [(0, 0), (0, 1), (0, 2)], "L": [(0, 0), (0, 1), (0, 2), (1, 2)]}


def page(placed, h=8, w=30):
    a = np.full((h, w), 255, np.uint8)
    for label, x, y in placed:
        for dx, dy in GLYPHS[label]:
            a[y + dy, x + dx] = 0
    return a


def frame(spark, pages):
    return spark.createDataFrame([(i, p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in enumerate(pages)], "page long, width int, height int, pixels binary")


def test_read_pages(spark):
    a = page([("T", 1, 1), ("I", 5, 1), ("L", 7, 1), ("I", 10, 5)])
    b = page([("L", 0, 0), ("I", 25, 0)])
    c = page([("T", 1, 1)])
    c[6, 9] = 0
    read = raster.read_pages(frame(spark, [a, b, c, page([])]), GLYPHS)
    assert rows(raster.row_texts(read)) == [(0, 0, 0, "TIL", 0), (0, 0, 1, "I", 0), (1, 0, 0, "L", 0), (1, 1, 0, "I", 0), (2, 0, 0, "T", 0), (2, 0, 1, "", 1)]
    assert rows(raster.page_results(read)) == [(0, 2, 4, 0, 0), (1, 2, 2, 0, 0), (2, 2, 1, 1, 1)]
    assert raster.read_pages(frame(spark, [a]).limit(0), GLYPHS).count() == 0


def test_exact_cover():
    lib = raster.Library(GLYPHS | {"LI": GLYPHS["L"] + [(2, 0), (2, 1), (2, 2)]})
    ink = page([("L", 0, 1), ("I", 2, 1), ("T", 6, 1)]) < 210
    assert [x[2] for x in raster.exact_cover(ink, lib)] == ["LI", "T"]
    assert [x[2] for x in raster.exact_cover(ink, lib, ["L", "I", "T"])] == ["L", "I", "T"]
    assert raster.exact_cover(ink, lib, ["I", "L", "T"]) is None and raster.exact_cover(ink & False, lib) == []
    ink[7, 20] = True
    assert raster.exact_cover(ink, lib) is None


def test_masks_and_ownership(spark):
    a = page([("T", 1, 1)])
    a[2:7, 15:25] = 0
    masked = raster.without_ornaments(frame(spark, [a, page([])]), 5, 4, 20, 0.9)
    ink = ocr.ink_pixels(masked)
    assert ink.count() == len(GLYPHS["T"])
    bands = spark.createDataFrame([(0, 1, 1, 3)], "page long, band int, top int, bottom int")
    assert sorted(r.band or 0 for r in raster.owned_pixels(ink, bands).collect()) == [0, 1, 1, 1, 1]


def test_merged_models(spark):
    m = spark.createDataFrame([(2, "a", [[0, 1], [0, 0]], "p"), (1, "b", [[0, 0], [0, 1], [0, 0]], "q"), (3, "c", [[5, 5]], "p"), (4, "c", [[5, 5]], None)], "model_id int, label string, pixels array<array<int>>, source string")
    assert rows(raster.merged_models(m)) == [([[0, 0], [0, 1]], 1, "b", ["p", "q"], True), ([[5, 5]], 3, "c", ["p"], False)]


def test_drawn_words_read_back(spark):
    words = spark.createDataFrame([(1, "flöjås"), (2, "a|b"), (3, ""), (4, None)], "i int, w string")
    pages = raster.draw_words(words, "i", "w")
    glyphs = {c: list(raster.drawn_glyph(c)) for c in "flöjåsa|b"}
    assert {r.page: r.text for r in raster.row_texts(raster.read_pages(pages, glyphs)).collect()} == {1: "flöjås", 2: "a|b"}
