"""Detector boxes: decoding, filters, suppression, merging, splitting, reading order.

A box is a row (img, box_id, x, y, w, h, conf, ...). Order-dependent operators gather the boxes of one
image into a sorted array and fold it with `aggregate`: one shuffle by image, no Python. An image holds
at most as many boxes as the detector has anchors, so these arrays are bounded.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import trim_controls

# Fixed values of the detectors.
DETECTOR_SIDE, STRIDES = 768, (8, 16, 32)
CONFIDENCE, IOU, COVERED, TEXT_CONFIDENCE = 0.25, 0.45, 0.7, 0.45
SPLIT_MARGIN = 6
UNCLIP, MIN_SIDE = 1.6, 8
LABELS = {0: "embedding", 1: "isolated"}
MIN_AREA, MIN_PERIMETER, MIN_SCORE, MIN_BOX = 4, 0.5, 0.5, 4

BOX = "struct<x:int,y:int,w:int,h:int,conf:double,box_id:bigint>"


def half_up(x: Column) -> Column:
    """Rounding with halves towards positive infinity."""
    return F.floor(x + 0.5)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part of two intervals, 0 if there is none."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    """Common area of two boxes (structs with x, y, w, h)."""
    return overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union as a double; null if both boxes are empty."""
    common = intersection(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(union > 0, common.cast("double") / union)


def own_overlap(a: Column, b: Column) -> Column:
    """Part of box a that lies in box b; an empty box counts as of area 1."""
    return intersection(a, b).cast("double") / F.greatest(a["w"] * a["h"], F.lit(1))


def letterbox(w: Column, h: Column, side: int = DETECTOR_SIDE) -> Column:
    """struct(scale, pad_x, pad_y, new_w, new_h) of an image fitted into a square."""
    scale = F.least(F.lit(float(side)) / w, F.lit(float(side)) / h)
    new_w, new_h = half_up(w * scale), half_up(h * scale)
    pad = lambda n: half_up((F.lit(side) - n) / 2.0 - 0.1)
    return F.struct(scale.alias("scale"), pad(new_w).cast("int").alias("pad_x"), pad(new_h).cast("int").alias("pad_y"), new_w.cast("int").alias("new_w"), new_h.cast("int").alias("new_h"))


def anchors(side: int = DETECTOR_SIDE, strides: tuple[int, ...] = STRIDES) -> int:
    """Number of anchors of the detector."""
    return sum((-(-side // s)) ** 2 for s in strides)


def anchor_rows(output: DataFrame) -> DataFrame:
    """(img, anchor, v) with v = array(cx, cy, w, h, s0, s1) from the flat channel-major output (img, data)."""
    n = (F.size("data") / 6).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("anchor"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.element_at(F.col("data"), (c * n + k + 1).cast("int"))).alias("v")))
    return output.where(F.size("data") >= 6).select("img", F.inline(rows))


def decode_anchors(rows: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """Boxes in image coordinates from anchors (img, anchor, cx, cy, bw, bh, s0, s1) with the image's scale, pad_x, pad_y, orig_w, orig_h.

    The first class wins a tie; minima are floored, maxima rounded up, all clamped to the image.
    """
    conf = F.greatest("s0", "s1")
    lo = lambda c, half, pad, most: F.least(F.greatest(F.floor((F.col(c) - F.col(half) / 2 - F.col(pad)) / F.col("scale")), F.lit(0)), F.col(most))
    hi = lambda c, half, pad, most: F.least(F.greatest(F.ceil((F.col(c) + F.col(half) / 2 - F.col(pad)) / F.col("scale")), F.lit(0)), F.col(most))
    x0, y0 = lo("cx", "bw", "pad_x", "orig_w"), lo("cy", "bh", "pad_y", "orig_h")
    x1, y1 = hi("cx", "bw", "pad_x", "orig_w"), hi("cy", "bh", "pad_y", "orig_h")
    cls = F.when(F.col("s0") >= F.col("s1"), 0).otherwise(1)
    return rows.where(conf >= least).select("img", F.col("anchor").alias("box_id"), x0.cast("int").alias("x"), y0.cast("int").alias("y"), (x1 - x0).cast("int").alias("w"), (y1 - y0).cast("int").alias("h"), conf.alias("conf"), cls.alias("cls"), label(cls).alias("label"))


def label(cls: Column) -> Column:
    """Name of a class; the number itself for an unknown one."""
    out = cls.cast("string")
    for k, name in LABELS.items():
        out = F.when(cls == k, F.lit(name)).otherwise(out)
    return out


def _box() -> Column:
    return F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.col("conf").cast("double").alias("conf"), F.col("box_id").cast("bigint").alias("box_id"))


def _sorted(boxes: DataFrame, *keys: Column) -> DataFrame:
    """(img, boxes): the boxes of an image, ordered by keys."""
    one = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), _box().alias("b"))
    return boxes.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["b"]).alias("boxes"))


def suppress(boxes: DataFrame, limit: float = IOU) -> DataFrame:
    """Greedy non-maximum suppression over all classes: a box goes if it overlaps a kept, better one beyond limit.

    Order: confidence downwards, then box_id. Two empty boxes at hand count as the same (their ratio is undefined).
    """
    pct = round(limit * 100)

    def clash(k: Column, b: Column) -> Column:
        common = intersection(k, b)
        union = k["w"] * k["h"] + b["w"] * b["h"] - common
        return (union == 0) | (common * 100 > union * pct)

    kept = F.aggregate("boxes", F.array().cast(f"array<{BOX}>"), lambda acc, b: F.when(F.exists(acc, lambda k: clash(k, b)), acc).otherwise(F.concat(acc, F.array(b))))
    return _sorted(boxes, -F.col("conf"), F.col("box_id")).select("img", F.inline(kept))


def reading_order(boxes: DataFrame, *more: str) -> DataFrame:
    """boxes with pos, the place in reading order (y, then x, then box_id) within the image."""
    from pyspark.sql import Window

    return boxes.withColumn("pos", F.row_number().over(Window.partitionBy("img").orderBy("y", "x", "box_id")))


def score_order(boxes: DataFrame) -> DataFrame:
    """boxes with rank, the place by confidence downwards, then box_id."""
    from pyspark.sql import Window

    return boxes.withColumn("rank", F.row_number().over(Window.partitionBy("img").orderBy(F.col("conf").desc(), "box_id")))


def merge_rows(boxes: DataFrame, strict_compat: bool = True) -> DataFrame:
    """Boxes of one text row merged: in (y, x) order a box joins the first group whose centre is nearer than half
    the mean height and whose right side is less than 1.2 mean heights left of the box. There is no bound to the other
    side: a box anywhere left of a group joins it too. strict_compat=False measures the gap on either side."""

    def joins(g: Column, b: Column) -> Column:
        mean = (g["h"] + b["h"]) / 2.0
        near = F.abs((g["y"] + g["h"] / 2.0) - (b["y"] + b["h"] / 2.0)) < mean / 2
        right = b["x"] - (g["x"] + g["w"])
        gap = right if strict_compat else F.greatest(right, g["x"] - (b["x"] + b["w"]))
        return near & (gap < mean * 1.2)

    def joined(g: Column, b: Column) -> Column:
        x, y = F.least(g["x"], b["x"]), F.least(g["y"], b["y"])
        return F.struct(x.alias("x"), y.alias("y"), (F.greatest(g["x"] + g["w"], b["x"] + b["w"]) - x).alias("w"), (F.greatest(g["y"] + g["h"], b["y"] + b["h"]) - y).alias("h"), F.greatest(g["conf"], b["conf"]).alias("conf"), g["box_id"].alias("box_id"))

    def step(acc: Column, b: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: joins(g, b)), True)
        return F.when(at == 0, F.concat(acc, F.array(b))).otherwise(F.transform(acc, lambda g, k: F.when(k == at - 1, joined(g, b)).otherwise(g)))

    merged = F.aggregate("boxes", F.array().cast(f"array<{BOX}>"), step)
    return _sorted(boxes, F.col("y"), F.col("x"), F.col("box_id")).select("img", F.inline(merged))


def _fixpoint(pdf: pd.DataFrame) -> pd.DataFrame:
    boxes = pdf.sort_values(["y", "x", "box_id"])[["x", "y", "w", "h", "conf", "box_id"]].values.tolist()
    merged = True
    while merged:
        merged = False
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                a, b = boxes[i], boxes[j]
                if a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]:
                    x, y = min(a[0], b[0]), min(a[1], b[1])
                    boxes[i] = [x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y, max(a[4], b[4]), a[5]]
                    del boxes[j]
                    merged = True
                    break
            if merged:
                break
    out = pd.DataFrame(boxes, columns=["x", "y", "w", "h", "conf", "box_id"])
    out.insert(0, "img", pdf["img"].iloc[0])
    return out.astype({"x": "int32", "y": "int32", "w": "int32", "h": "int32", "box_id": "int64", "img": "int64"})


def merge_overlapping(boxes: DataFrame) -> DataFrame:
    """Boxes united until none overlap; a union may reach further boxes, so this runs to a fixpoint per image."""
    return boxes.select("img", "box_id", "x", "y", "w", "h", "conf").groupBy("img").applyInPandas(_fixpoint, "img bigint, x int, y int, w int, h int, conf double, box_id bigint")


def split_by_formulas(texts: DataFrame, formulas: DataFrame, margin: int = SPLIT_MARGIN) -> DataFrame:
    """(img, box_id, pos, x, w, is_formula): every text box cut into segments by the formulas on its height.

    Formulas go from left to right; each cuts the first text segment it meets, and a rest counts if it is wider than margin.
    """
    seg = "struct<x:int,w:int,f:boolean>"
    t = texts.select("img", "box_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    f = formulas.groupBy("img").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("box_id"), F.col("y").cast("int").alias("y"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h")))).alias("fs"))
    both = t.join(f, "img", "left")
    on_height = F.filter(F.coalesce("fs", F.array().cast("array<struct<x:int,box_id:bigint,y:int,w:int,h:int>>")), lambda g: (g["y"] < F.col("y") + F.col("h")) & (g["y"] + g["h"] > F.col("y")))

    def step(acc: Column, g: Column) -> Column:
        hit = F.transform(acc, lambda s: ~s["f"] & (g["x"] < s["x"] + s["w"]) & (g["x"] + g["w"] > s["x"]))
        at = F.array_position(hit, True)

        def cut(s: Column) -> Column:
            left, right = g["x"] - s["x"], s["x"] + s["w"] - (g["x"] + g["w"])
            none = F.array().cast(f"array<{seg}>")
            piece = lambda x, w, is_f: F.array(F.struct(x.cast("int").alias("x"), w.cast("int").alias("w"), F.lit(is_f).alias("f")))
            return F.concat(F.when(left > margin, piece(s["x"], left, False)).otherwise(none), piece(g["x"], g["w"], True), F.when(right > margin, piece(g["x"] + g["w"], right, False)).otherwise(none))

        return F.when(at == 0, acc).otherwise(F.flatten(F.transform(acc, lambda s, k: F.when(k == at - 1, cut(s)).otherwise(F.array(s)))))

    parts = F.aggregate(on_height, F.array(F.struct(F.col("x").alias("x"), F.col("w").alias("w"), F.lit(False).alias("f"))).cast(f"array<{seg}>"), step)
    return both.select("img", "box_id", F.posexplode(parts).alias("pos", "s")).select("img", "box_id", "pos", F.col("s.x").alias("x"), F.col("s.w").alias("w"), F.col("s.f").alias("is_formula"))


def uncovered(boxes: DataFrame, limit: float = COVERED, existing: DataFrame | None = None) -> DataFrame:
    """Boxes in reading order, without those that an earlier kept one, or one of the existing results (img, x, y, w, h),
    covers beyond limit of their own area. Existing ones come first and are not put out."""
    pct = round(limit * 100)
    seq = _sorted(boxes, F.col("y"), F.col("x"), F.col("box_id"))
    none = F.array().cast(f"array<{BOX}>")
    if existing is None:
        seq = seq.withColumn("known", none)
    else:
        whole = existing.select("img", *(F.col(c).cast("int").alias(c) for c in "xywh"), F.lit(0.0).alias("conf"), F.lit(-1).cast("bigint").alias("box_id"))
        seq = seq.join(whole.groupBy("img").agg(F.collect_list(_box()).alias("known")), "img", "left").withColumn("known", F.coalesce("known", none))

    def covered(k: Column, b: Column) -> Column:
        return intersection(k, b) * 100 > F.greatest(b["w"] * b["h"], F.lit(1)) * pct

    kept = F.aggregate("boxes", F.col("known"), lambda acc, b: F.when(F.exists(acc, lambda k: covered(k, b)), acc).otherwise(F.concat(acc, F.array(b))))
    return seq.select("img", F.filter(kept, lambda k, i: i >= F.size("known")).alias("kept")).select("img", F.inline("kept"))


def unclip(area: Column, perimeter: Column, ratio: float = UNCLIP) -> Column:
    """How far a shrunken region grows back; null for a region without edge."""
    return F.when(perimeter > 0, area * ratio / perimeter)


def grown(x: Column, y: Column, w: Column, h: Column, by: Column, scale: Column) -> Column:
    """struct(x, y, w, h) of a box grown by a distance and scaled back; origin not below 0, height not below MIN_SIDE."""
    at = lambda v: F.greatest(half_up((v - by) / scale), F.lit(0)).cast("int")
    size = lambda v: half_up((v + by * 2) / scale).cast("int")
    return F.struct(at(x).alias("x"), at(y).alias("y"), size(w).alias("w"), F.greatest(size(h), F.lit(MIN_SIDE)).alias("h"))


def worth_keeping(area: Column, perimeter: Column, score: Column, w: Column, h: Column, points: Column) -> Column:
    """The noise filter of contour boxes."""
    return (area >= MIN_AREA) & (perimeter >= MIN_PERIMETER) & (score >= MIN_SCORE) & (w > MIN_BOX) & (h > MIN_BOX) & (points >= 4)


def clamp_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h): origin not below 0, size within the image and at least 1."""
    cx, cy = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    return F.struct(cx.alias("x"), cy.alias("y"), F.greatest(F.least(w, width - cx), F.lit(1)).alias("w"), F.greatest(F.least(h, height - cy), F.lit(1)).alias("h"))


def bounding(points: DataFrame, *keys: str) -> DataFrame:
    """Bounding box of points (x, y) per key."""
    return points.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))


def ring_metrics(points: Column) -> Column:
    """struct(area, perimeter) of a closed ring of struct(x, y) in order; 0 for fewer than two points."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.aggregate(F.zip_with(points, nxt, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.aggregate(F.zip_with(points, nxt, lambda a, b: F.sqrt(F.pow((a["x"] - b["x"]).cast("double"), 2) + F.pow((a["y"] - b["y"]).cast("double"), 2))), F.lit(0.0), lambda s, v: s + v)
    return F.struct((F.abs(cross) / 2).alias("area"), length.alias("perimeter"))


def group_lines(regions: DataFrame, share: float = 0.45) -> DataFrame:
    """(img, line, pos, region_id): regions in reading order join the first line whose leftmost member overlaps them in
    height by at least share of the smaller height; a line is re-ordered by x after each addition."""
    item = "struct<x:int,y:int,id:bigint,h:int>"
    one = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("region_id").cast("bigint").alias("id"), F.col("h").cast("int").alias("h"))
    rows = regions.groupBy("img").agg(F.array_sort(F.collect_list(one)).alias("rs"))
    pct = round(share * 100)

    def fits(line: Column, r: Column) -> Column:
        first = line[0]
        return overlap(first["y"], first["y"] + first["h"], r["y"], r["y"] + r["h"]) * 100 >= F.greatest(F.least(first["h"], r["h"]), F.lit(1)) * pct

    def step(acc: Column, r: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda ln: fits(ln, r)), True)
        new = F.array(F.struct(r["x"].alias("x"), r["y"].alias("y"), r["id"].alias("id"), r["h"].alias("h"))).cast(f"array<{item}>")
        return F.when(at == 0, F.concat(acc, F.array(new))).otherwise(F.transform(acc, lambda ln, k: F.when(k == at - 1, F.array_sort(F.concat(ln, new))).otherwise(ln)))

    lines = F.aggregate("rs", F.array().cast(f"array<array<{item}>>"), step)
    out = rows.select("img", F.posexplode(lines).alias("line", "members"))
    return out.select("img", "line", F.posexplode("members").alias("pos", "m")).select("img", "line", "pos", F.col("m.id").alias("region_id"))


def layout_text(regions: DataFrame) -> DataFrame:
    """(img, text): lines joined by newlines, members by blanks, formulas between $$ marks on lines of their own.

    Texts are trimmed and empty ones left out (a null text is empty); a formula has a blank behind it beside the one
    between members. The only region of an image comes out as it is.
    """
    text = F.coalesce("text", F.lit(""))
    formula = F.coalesce(F.col("type") == "formula", F.lit(False))
    marked = F.concat(F.lit("$$\n"), text, F.lit("\n$$"))
    alone = F.when(formula, marked).otherwise(text)
    body = F.when(formula, F.concat(marked, F.lit(" "))).otherwise(F.nullif(trim_controls(text), F.lit("")))
    placed = group_lines(regions).join(regions.select("region_id", "img", body.alias("body"), alone.alias("alone")), ["img", "region_id"])
    members = F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda s: s["body"])
    line = placed.groupBy("img", "line").agg(trim_controls(F.array_join(members, " ")).alias("t"), F.count("*").alias("n"), F.min("alone").alias("alone"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n")
    return line.groupBy("img").agg(F.when(F.sum("n") == 1, F.min("alone")).otherwise(lines).alias("text"))


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(img, box_id, w, h, px): the pixels of boxes (img, box_id, x, y, w, h) that lie within flat rasters (img, w, h, px)."""
    at = boxes.groupBy("img").agg(F.collect_list(F.struct("box_id", "x", "y", "w", "h")).alias("boxes"))
    one = images.join(at, "img").select("img", F.col("w").alias("wide"), "px", F.col("h").alias("tall"), F.inline("boxes"))
    kept = one.select("img", "box_id", "wide", "px", F.inline(F.array(clamp_crop(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("wide"), F.col("tall")))))
    rows = F.transform(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1), lambda r: F.slice("px", (r * F.col("wide") + F.col("x") + 1).cast("int"), F.col("w")))
    return kept.select("img", "box_id", "w", "h", F.flatten(rows).alias("px"))


def padded_bounds(points: DataFrame, sizes: DataFrame, pad: int = 20) -> DataFrame:
    """(img, x, y, w, h): bounds of the inked points (img, x, y) with a margin, within the canvas (img, w, h); none where nothing is inked."""
    b = points.groupBy("img").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).join(sizes.select("img", F.col("w").alias("wide"), F.col("h").alias("tall")), "img")
    low = lambda c: F.greatest(F.lit(0), F.col(c) - pad)
    side = lambda a, z, most: F.least(F.col(most), F.col(z) - F.col(a) + 2 * pad)
    return b.select("img", low("x0").alias("x"), low("y0").alias("y"), side("x0", "x1", "wide").alias("w"), side("y0", "y1", "tall").alias("h"))


#: Least sizes of blocks (width, height), of lines (height) and of chunks (width).
LEAST_BLOCK, LEAST_LINE, LEAST_CHUNK = (40, 15), 15, 20
#: Blocks below this width or height are fragments; gaps are bridged up to so many rows, from this common share and so many columns on.
FRAGMENT, BRIDGED, SHARED, COLUMNS = (300, 20), 80, 0.3, 2


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """(img, x, y, w, h): blocks (img, x, y, w, h, cols) of the least size, in order of y and x, each united with the block
    united so far if they touch and share columns, or if a narrow gap lies between, one of them is a fragment, they share
    enough columns, and cols, the columns of content through the gap above a block, are enough."""
    item = "struct<x:int,y:int,w:int,h:int>"
    big = blocks.where((F.col("w") >= LEAST_BLOCK[0]) & (F.col("h") >= LEAST_BLOCK[1]))
    one = F.struct(*(F.col(c).cast("int").alias(c) for c in ("y", "x", "w", "h", "cols")))
    seq = big.groupBy("img").agg(F.array_sort(F.collect_list(one)).alias("bs"))

    def step(acc: Column, b: Column) -> Column:
        p = F.element_at(acc, -1)
        gap = b["y"] - (p["y"] + p["h"])
        apart = (b["x"] + b["w"] < p["x"]) | (p["x"] + p["w"] < b["x"])
        common = F.greatest(F.least(p["x"] + p["w"], b["x"] + b["w"]) - F.greatest(p["x"], b["x"]), F.lit(0))
        small_one = (p["w"] < FRAGMENT[0]) | (p["h"] < FRAGMENT[1]) | (b["w"] < FRAGMENT[0]) | (b["h"] < FRAGMENT[1])
        bridge = (common * 100 >= F.least(p["w"], b["w"]) * round(SHARED * 100)) & (common > 0) & small_one & (b["cols"] >= COLUMNS)
        unite = F.when(gap <= 0, ~apart).otherwise((gap <= BRIDGED) & bridge)
        x = F.least(p["x"], b["x"])
        both = F.struct(x.alias("x"), p["y"].alias("y"), (F.greatest(p["x"] + p["w"], b["x"] + b["w"]) - x).alias("w"), (F.greatest(p["y"] + p["h"], b["y"] + b["h"]) - p["y"]).alias("h"))
        new = F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))
        return F.when(unite, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both).cast(f"array<{item}>"))).otherwise(F.concat(acc, F.array(new).cast(f"array<{item}>")))

    first = F.transform(F.slice("bs", 1, 1), lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))).cast(f"array<{item}>")
    return seq.select("img", F.inline(F.aggregate(F.slice("bs", 2, F.greatest(F.size("bs") - 1, F.lit(0))), first, step)))


def pieces(found: DataFrame, extents: DataFrame, least: int) -> DataFrame:
    """(img, lo, size): what lies between gaps (img, lo, hi; ends included) along an extent (img, size), if at least so long;
    the whole extent where nothing is."""
    from pyspark.sql import Window

    w = Window.partitionBy("img").orderBy("lo")
    within = found.join(extents, "img").select("img", "lo", F.col("hi") + 1, "size").toDF("img", "lo", "end", "all")
    before = within.select("img", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("at"), F.col("lo").alias("to"))
    rest = within.groupBy("img", F.col("all").alias("to")).agg(F.max("end").alias("at")).select("img", "at", "to")
    some = before.unionByName(rest).select("img", F.col("at").cast("int").alias("lo"), (F.col("to") - F.col("at")).cast("int").alias("size")).where(F.col("size") >= least)
    whole = extents.join(some.select("img").distinct(), "img", "left_anti").select("img", F.lit(0).alias("lo"), F.col("size").cast("int").alias("size"))
    return some.unionByName(whole)


def capture_size(w: Column, h: Column, screen_w: Column, screen_h: Column) -> Column:
    """struct(w, h, degrees) of a camera picture: turned by a quarter if the screen stands and the picture lies."""
    turn = (screen_h > screen_w) & (w > h)
    return F.struct(F.when(turn, h).otherwise(w).alias("w"), F.when(turn, w).otherwise(h).alias("h"), F.when(turn, 90).otherwise(0).alias("degrees"))
