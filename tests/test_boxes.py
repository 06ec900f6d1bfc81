"""Folds over boxes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import boxes as B

SCHEMA = "img bigint, box_id bigint, x int, y int, w int, h int, conf double"


def some(seed, n=60, imgs=4, empty=False):
    r = random.Random(seed)
    return [(r.randrange(imgs), k, r.randrange(200), r.randrange(150), r.randrange(0 if empty else 5, 60), r.randrange(0 if empty else 5, 40), r.randrange(10) / 10) for k in range(n)]


def inter(a, b):
    return max(min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), 0) * max(min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]), 0)


@pytest.mark.parametrize("empty", [False, True])
def test_suppress(spark, empty):
    rows = some(3, empty=empty)
    want = []
    for img in range(4):
        kept = []
        for b in sorted((b for b in rows if b[0] == img), key=lambda b: (-b[6], b[1])):
            if not any((u := k[4] * k[5] + b[4] * b[5] - inter(k, b)) == 0 or inter(k, b) * 100 > 45 * u for k in kept):
                kept.append(b)
        want += [b[1] for b in kept]
    assert sorted(r["box_id"] for r in B.suppress(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(want)


@pytest.mark.parametrize("strict", [True, False])
def test_merge_rows(spark, strict):
    rows = some(5)
    want = []
    for img in range(4):
        groups = []
        for b in sorted((b for b in rows if b[0] == img), key=lambda b: (b[3], b[2], b[1])):
            for g in groups:
                mean = (g[3] + b[5]) / 2
                gap = b[2] - (g[0] + g[2])
                if not strict:
                    gap = max(gap, g[0] - (b[2] + b[4]))
                if abs(g[1] + g[3] / 2 - b[3] - b[5] / 2) < mean / 2 and gap < 1.2 * mean:
                    x, y = min(g[0], b[2]), min(g[1], b[3])
                    g[:] = [x, y, max(g[0] + g[2], b[2] + b[4]) - x, max(g[1] + g[3], b[3] + b[5]) - y]
                    break
            else:
                groups.append([b[2], b[3], b[4], b[5]])
        want += [(img, *g) for g in groups]
    got = B.merge_rows(spark.createDataFrame(rows, SCHEMA), strict).select("img", "x", "y", "w", "h").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_merge_overlapping_leaves_none(spark):
    rows = some(7, 80)
    got = B.merge_overlapping(spark.createDataFrame(rows, SCHEMA)).collect()
    for a in got:
        for b in got:
            if a["img"] == b["img"] and a["box_id"] < b["box_id"]:
                assert not (a["x"] < b["x"] + b["w"] and b["x"] < a["x"] + a["w"] and a["y"] < b["y"] + b["h"] and b["y"] < a["y"] + a["h"])
    assert {r["img"] for r in got} == {r[0] for r in rows}


def test_split_by_formulas(spark):
    rows = some(9, 50)
    texts, formulas = [b for b in rows if b[1] % 2], [b for b in rows if not b[1] % 2]
    want = []
    for t in texts:
        segs = [(t[2], t[4], False)]
        for f in sorted((f for f in formulas if f[0] == t[0] and f[3] < t[3] + t[5] and f[3] + f[5] > t[3]), key=lambda f: (f[2], f[1])):
            for k, (x, w, is_f) in enumerate(segs):
                if not is_f and f[2] < x + w and f[2] + f[4] > x:
                    new = [(f[2], f[4], True)]
                    if f[2] - x > 6:
                        new.insert(0, (x, f[2] - x, False))
                    if x + w - (f[2] + f[4]) > 6:
                        new.append((f[2] + f[4], x + w - (f[2] + f[4]), False))
                    segs[k : k + 1] = new
                    break
        want += [(t[0], t[1], k, *s) for k, s in enumerate(segs)]
    got = B.split_by_formulas(spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(formulas, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_box_left_of_its_row_joins(spark):
    far = [(1, 1, 900, 0, 50, 20, 0.5), (1, 2, 0, 1, 50, 20, 0.9)]
    df = spark.createDataFrame(far, SCHEMA)
    assert [tuple(r)[1:5] for r in B.merge_rows(df).select("box_id", "x", "y", "w", "h").collect()] == [(0, 0, 950, 21)]
    assert B.merge_rows(df, strict_compat=False).count() == 2


def test_layout_of_blanks_and_formulas(spark):
    line = [(3, 10, 0, 0, 9, 9, "formula", "a"), (3, 11, 20, 0, 9, 9, "text", "  b\t"), (3, 12, 30, 0, 9, 9, "text", "   "), (3, 13, 40, 0, 9, 9, "text", None), (3, 14, 50, 0, 9, 9, "text", "c"), (3, 15, 0, 40, 9, 9, "text", " ")]
    one = [(4, 20, 0, 0, 9, 9, "text", " as it is "), (5, 21, 0, 0, 9, 9, "formula", "x")]
    df = spark.createDataFrame(line + one, "img bigint, region_id bigint, x int, y int, w int, h int, type string, text string")
    assert dict(B.layout_text(df).collect()) == {3: "$$\na\n$$  b c\n", 4: " as it is ", 5: "$$\nx\n$$"}


def test_lines_and_layout(spark):
    rows = [(1, 1, 100, 10, 20, 20, "text", "world"), (1, 2, 0, 12, 50, 20, "text", "hello"), (1, 3, 0, 60, 50, 20, "formula", "x^2"), (2, 4, 0, 0, 5, 0, "text", "")]
    df = spark.createDataFrame(rows, "img bigint, region_id bigint, x int, y int, w int, h int, type string, text string")
    assert {(r["line"], r["pos"], r["region_id"]) for r in B.group_lines(df).where("img = 1").collect()} == {(0, 0, 2), (0, 1, 1), (1, 0, 3)}
    assert dict(B.layout_text(df).collect()) == {1: "hello world\n$$\nx^2\n$$", 2: ""}


def test_anchor_count_and_labels(spark):
    assert B.anchors() == 12096
    assert spark.range(3).select(B.label(F.col("id").cast("int")).alias("l")).orderBy("id").collect()[2][0] == "2"


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (B.suppress, B.merge_rows, B.merge_overlapping, B.uncovered):
        assert f(none).count() == 0
