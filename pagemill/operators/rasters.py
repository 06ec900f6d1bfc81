"""Rasters as pixel rows (img, y, x, v): thresholds, histograms, projections, bands, dilation, contours.

Statistics are ordinary aggregations and windows over pixel rows; only tracing a contour and
resampling, which go from pixel to pixel, run in Python per image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.boxes import half_up

# Fixed values of the image steps.
PROBABILITY, INK_BELOW, WHITE = 0.3, 200, 255
DARK_SUM, INK_ROW, BAND_GAP = 30_000, 3, 5
CONTENT_ROW = 5
MAX_TRACE, MIN_TRACE = 50_000, 6
TEXT_SIDE, TEXT_STEP = 960, 32
LINE_HEIGHT, LINE_WIDTH = 48, 320
FORMULA_SIDE = 384
ORIENT_SHORT, ORIENT_CROP = 256, 224
PATCH, PATCH_STRIDE = 64, 32
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def channels(argb: Column) -> Column:
    """struct(r, g, b) of a packed colour."""
    return F.struct(F.shiftright(argb, 16).bitwiseAND(255).alias("r"), F.shiftright(argb, 8).bitwiseAND(255).alias("g"), argb.bitwiseAND(255).alias("b"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def gray_sum(r: Column, g: Column, b: Column) -> Column:
    """Thousandfold brightness in integers."""
    return r * 299 + g * 587 + b * 114


def ink(r: Column, g: Column, b: Column) -> Column:
    """0 where any channel is dark, else white."""
    return F.when(F.least(r, g, b) < INK_BELOW, 0).otherwise(WHITE)


def binarise(p: Column, limit: float = PROBABILITY) -> Column:
    return (p > limit).cast("int")


# Sizes of the inputs of the models.


def limit_side(w: Column, h: Column, side: int = TEXT_SIDE, step: int = TEXT_STEP) -> Column:
    """struct(scale, new_w, new_h, pad_w, pad_h): longest side at most side, padded up to multiples of step."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(w, h))
    nw, nh = F.greatest(half_up(w * scale), F.lit(1)), F.greatest(half_up(h * scale), F.lit(1))
    up = lambda n: (F.ceil(n / step) * step).cast("int")
    return F.struct(scale.alias("scale"), nw.cast("int").alias("new_w"), nh.cast("int").alias("new_h"), up(nw).alias("pad_w"), up(nh).alias("pad_h"))


def line_width(w: Column, h: Column) -> Column:
    """Width of a text line at LINE_HEIGHT, from 4 to LINE_WIDTH."""
    return F.greatest(F.least(F.ceil(F.lit(float(LINE_HEIGHT)) * w / h), F.lit(LINE_WIDTH)), F.lit(4)).cast("int")


def short_side_crop(w: Column, h: Column) -> Column:
    """struct(new_w, new_h, left, top): short side ORIENT_SHORT, then the middle ORIENT_CROP square."""
    scale = F.lit(float(ORIENT_SHORT)) / F.least(w, h)
    nw, nh = half_up(w * scale).cast("int"), half_up(h * scale).cast("int")
    mid = lambda n: F.floor((n - ORIENT_CROP) / 2).cast("int")
    return F.struct(nw.alias("new_w"), nh.alias("new_h"), mid(nw).alias("left"), mid(nh).alias("top"))


def patch_fit(w: Column, h: Column, side: int = PATCH) -> Column:
    """struct(scale, new_w, new_h) of a crop fitted into a white patch."""
    scale = F.least(F.lit(float(side)) / w, F.lit(float(side)) / h)
    return F.struct(scale.alias("scale"), half_up(w * scale).cast("int").alias("new_w"), half_up(h * scale).cast("int").alias("new_h"))


def resampled(px: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear resampling of an (h, w[, c]) raster."""
    H, W = px.shape[:2]
    y, x = np.clip((np.arange(h) + 0.5) * H / h - 0.5, 0, H - 1), np.clip((np.arange(w) + 0.5) * W / w - 0.5, 0, W - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, H - 1), np.minimum(x0 + 1, W - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if px.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    p = px.astype(float)
    return (p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx) * (1 - fy) + (p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx) * fy


def tensors(images: DataFrame, side: int, mean: tuple[float, ...], std: tuple[float, ...], order: str = "rgb") -> DataFrame:
    """(img, shape, data): each image (img, w, h, px of packed colours) stretched to a square, normalised, channel-major."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, h, px in zip(b["w"], b["h"], b["px"]):
                a = np.asarray(px, np.int64).reshape(h, w)
                rgb = np.stack([(a >> 16) & 255, (a >> 8) & 255, a & 255], -1)
                t = resampled(rgb if order == "rgb" else rgb[..., ::-1], side, side) / 255.0
                out.append(((t - mean) / std).transpose(2, 0, 1).astype(np.float32).ravel())
            yield pd.DataFrame({"img": b["img"], "shape": [[1, 3, side, side]] * len(b), "data": out})

    return images.select("img", "w", "h", "px").mapInPandas(run, "img bigint, shape array<bigint>, data array<float>")


# Histograms and thresholds.


def histogram(pixels: DataFrame) -> DataFrame:
    """(img, v, n): counts of all 256 levels of every image."""
    counts = pixels.groupBy("img", "v").agg(F.count("*").alias("n"))
    levels = pixels.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return levels.join(counts, ["img", "v"], "left").select("img", "v", F.coalesce("n", F.lit(0)).alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(img, threshold): the level of the greatest variance between the classes; the least of several; 128 if there is none."""
    up = Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img")
    h = histogram(pixels).withColumns({"nb": F.sum("n").over(up), "sb": F.sum(F.col("n") * F.col("v")).over(up), "n_all": F.sum("n").over(whole), "s_all": F.sum(F.col("n") * F.col("v")).over(whole)})
    nf = F.col("n_all") - F.col("nb")
    between = F.when((F.col("nb") > 0) & (nf > 0), F.col("nb").cast("double") * nf * F.pow(F.col("sb").cast("double") / F.col("nb") - (F.col("s_all") - F.col("sb")).cast("double") / nf, 2))
    best = h.withColumn("between", F.round(between, 6)).where("between > 0")
    top = best.groupBy("img").agg(F.max(F.struct("between", (-F.col("v")).alias("m"))).alias("b"))
    return pixels.select("img").distinct().join(top, "img", "left").select("img", F.coalesce(-F.col("b.m"), F.lit(128)).alias("threshold"))


def clahe_maps(pixels: DataFrame, tile: int, clip: float) -> DataFrame:
    """(img, ty, tx, cy, cx, v, share): per tile its centre and, for each level, the share of its pixels up to that level after
    clipping. What is clipped is spread evenly over all levels in whole pixels, so a share may end below 1."""
    t = pixels.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    n = t.groupBy("img", "ty", "tx", "v").agg(F.count("*").alias("n"))
    middle = lambda axis, k: ((F.col(k) * tile + F.max(axis) + 1) / 2.0).alias(f"c{axis}")
    tiles = t.groupBy("img", "ty", "tx").agg(F.count("*").alias("size"), middle("y", "ty"), middle("x", "tx"))
    full = tiles.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255)))).join(n, ["img", "ty", "tx", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.floor(F.col("size") * clip / 256) if clip > 0 else F.col("size")
    whole = Window.partitionBy("img", "ty", "tx")
    excess = F.sum(F.greatest(F.col("n") - most, F.lit(0))).over(whole)
    even = full.withColumn("m", F.least(F.col("n"), most) + F.floor(excess / 256))
    up = F.sum("m").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return even.select("img", "ty", "tx", "cy", "cx", "v", (up / F.col("size")).alias("share"))


def clahe(pixels: DataFrame, tile: int = 4, clip: float = 40.0) -> DataFrame:
    """(img, y, x, v): local equalisation; a pixel blends the shares of its tile and the tiles around it by inverse distance to their centres (1 at least)."""
    maps = clahe_maps(pixels, tile, clip)
    near = pixels.withColumn("o", F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))))
    near = near.withColumns({"ty": (F.floor(F.col("y") / tile) + F.col("o.dy")).cast("int"), "tx": (F.floor(F.col("x") / tile) + F.col("o.dx")).cast("int")})
    both = near.join(maps, ["img", "ty", "tx", "v"]).withColumn("d", 1 / F.greatest(F.sqrt(F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("x") - F.col("cx"), 2)), F.lit(1.0)))
    level = F.sum(F.col("share") * F.col("d")) / F.sum("d") * 255
    return both.groupBy("img", "y", "x").agg(F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), level)), 6).alias("v"))


def looks_handwritten(pixels: DataFrame) -> DataFrame:
    """(img, handwritten): bright on the whole, with a small share of dark pixels."""
    dark = F.avg((F.col("v") < 128).cast("double"))
    return pixels.groupBy("img").agg(((F.avg("v") > 200) & (dark > 0.002) & (dark < 0.15)).alias("handwritten"))


def background(samples: Column) -> Column:
    """Level of the background from eight border samples: the mean of the two in the middle, in integers."""
    s = F.sort_array(samples)
    return F.floor((F.element_at(s, 4) + F.element_at(s, 5)) / 2).cast("int")


# Projections, bands and gaps.


def projection(pixels: DataFrame, axis: str, hit: Column) -> DataFrame:
    """(img, axis, n): hits per row or column."""
    return pixels.groupBy("img", axis).agg(F.sum(hit.cast("int")).cast("bigint").alias("n"))


def runs(rows: DataFrame, axis: str, hit: Column, *keys: str) -> DataFrame:
    """(keys, lo, hi): maximal runs of consecutive places where hit holds (ends included)."""
    w = Window.partitionBy(*keys).orderBy(axis)
    held = rows.where(hit).withColumn("island", F.col(axis) - F.row_number().over(w))
    return held.groupBy(*keys, "island").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")).drop("island")


def content_bands(pixels: DataFrame, hit: Column, least: int = CONTENT_ROW) -> DataFrame:
    """(img, lo, hi): runs of rows with at least so many content pixels; the whole height where there is none."""
    rows = projection(pixels, "y", hit)
    found = runs(rows, "y", F.col("n") >= least, "img")
    empty = rows.groupBy("img").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).join(found.select("img").distinct(), "img", "left_anti")
    return found.unionByName(empty)


def gaps(rows: DataFrame, axis: str, below: int, least: int) -> DataFrame:
    """(img, lo, hi): runs of at least `least` places with fewer than `below` hits. rows: img, axis, n."""
    return runs(rows, axis, F.col("n") < below, "img").where(F.col("hi") - F.col("lo") + 1 >= least)


def uncrossed_gaps(found: DataFrame, pixels: DataFrame, hit: Column) -> DataFrame:
    """The line gaps without those that a column crosses with a third of their height in hits (at least one)."""
    inside = pixels.where(hit).select(F.col("img").alias("i"), "y", "x").join(found, (F.col("i") == F.col("img")) & (F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi")))
    tall = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo") + 1) * 3 / 10))
    crossed = inside.groupBy("img", "lo", "hi", "x").count().where(F.col("count") >= tall).select("img", "lo", "hi").distinct()
    return found.join(crossed, ["img", "lo", "hi"], "left_anti")


def ink_bands(rows: DataFrame, least: int = INK_ROW, patience: int = BAND_GAP) -> DataFrame:
    """(img, lo, hi): text bands from row counts (img, y, n). Low rows add up over a band and are not forgotten when ink
    returns; the band closes at the fifth and ends that many rows earlier. A band open at the end closes with the last row."""
    seq = rows.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("rows"))
    state = "struct<lo:int,low:int,bands:array<struct<lo:int,hi:int>>>"
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def make(lo: Column, low: Column, bands: Column) -> Column:
        return F.struct(lo.cast("int").alias("lo"), low.cast("int").alias("low"), bands.alias("bands")).cast(state)

    def step(s: Column, r: Column) -> Column:
        y = r["y"].cast("int")
        inked = r["n"] >= least
        full = s["low"] + 1 >= patience
        closed = F.concat(s["bands"], F.array(F.struct(s["lo"].alias("lo"), (y - (s["low"] + 1)).cast("int").alias("hi"))))
        return (
            F.when((s["lo"] < 0) & inked, make(y, F.lit(0), s["bands"]))
            .when((s["lo"] < 0) | inked, s)
            .when(full, make(F.lit(-1), F.lit(0), closed))
            .otherwise(make(s["lo"], s["low"] + 1, s["bands"]))
        )

    end = F.element_at(F.col("rows"), -1)["y"].cast("int")
    done = lambda s: F.when(s["lo"] >= 0, F.concat(s["bands"], F.array(F.struct(s["lo"].alias("lo"), end.alias("hi"))))).otherwise(s["bands"])
    return seq.select("img", F.inline(F.aggregate("rows", make(F.lit(-1), F.lit(0), none), step, done)))


def merge_bands(bands: DataFrame, most: int = 80) -> DataFrame:
    """(img, lo, hi): neighbouring bands united unless the gap is wider than `most` and they neither touch nor share columns.

    bands: img, lo, hi, cols (columns that cross the gap to the band before), share (their common part), fragment.
    """
    item = "struct<lo:int,hi:int>"
    one = F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "cols", "share", "fragment")
    seq = bands.groupBy("img").agg(F.array_sort(F.collect_list(one)).alias("bs"))

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = b["lo"] - last["hi"] - 1
        unite = (gap <= 0) | ((gap <= most) & (((b["share"] >= 0.3) & b["fragment"] & (b["cols"] >= 2)) | (b["cols"] >= 5)))
        new = F.array(F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"))).cast(f"array<{item}>")
        grown = F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], b["hi"]).alias("hi"))).cast(f"array<{item}>")
        return F.when(F.size(acc) == 0, new).when(unite, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), grown)).otherwise(F.concat(acc, new))

    # element_at of an empty array would fail, so the fold starts with the first band.
    first = F.array(F.struct(F.col("bs")[0]["lo"].alias("lo"), F.col("bs")[0]["hi"].alias("hi"))).cast(f"array<{item}>")
    return seq.select("img", F.inline(F.aggregate(F.slice("bs", 2, F.greatest(F.size("bs") - 1, F.lit(0))), first, step)))


# Labels along a line.


def fill_nulls(rows: DataFrame, value: str, *keys: str, order: str) -> DataFrame:
    """value with nulls taken from the nearest place to the left, else to the right, else 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    left = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(value, F.coalesce(left, right, F.lit(0)))


def remove_islands(labels: Column) -> Column:
    """An array of 0/1 labels without lone places (first pass) and lone pairs (second pass) between equal neighbours; left to right, in place."""

    def sweep(a: Column, width: int) -> Column:
        def step(acc: Column, k: Column) -> Column:
            at = lambda j: F.element_at(acc, (k + j).cast("int"))
            inner = F.lit(True)
            for j in range(1, width):
                inner = inner & (at(j) == at(0))
            lone = (at(-1) == at(width)) & (at(0) != at(-1)) & inner
            return F.when(lone, F.transform(acc, lambda v, i: F.when((i >= k - 1) & (i < k - 1 + width), at(-1)).otherwise(v))).otherwise(acc)

        # Places k = 2 .. size - width have a neighbour on both sides.
        return F.when(F.size(a) < width + 2, a).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(a) - width, F.lit(2))), a, step))

    return sweep(sweep(labels, 1), 2)


def label_runs(rows: DataFrame, label: str, order: str, *keys: str, least: int = 20) -> DataFrame:
    """(keys, label, lo, hi): runs of equal labels at least `least` wide."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    grouped = rows.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "run", label).agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where(F.col("hi") - F.col("lo") + 1 >= least).drop("run")


def relabel_narrow(parts: DataFrame) -> DataFrame:
    """parts (img, x, y, w, h, label) with narrow text (label 1, below 55) between two close formulas on its height as formula (0)."""
    w = Window.partitionBy("img").orderBy("x", "y")
    b = lambda c: F.lag(c).over(w)
    n = lambda c: F.lead(c).over(w)
    level = lambda other: F.abs(F.col("y") - other("y")) * 10 <= F.greatest(F.col("h"), other("h")) * 3
    flip = (F.col("label") == 1) & (F.col("w") < 55) & (b("label") == 0) & (n("label") == 0) & (F.col("x") - (b("x") + b("w")) <= 24) & (n("x") - (F.col("x") + F.col("w")) <= 24) & level(b) & level(n)
    return parts.withColumn("label", F.when(flip, 0).otherwise(F.col("label")))


def merge_adjacent(parts: DataFrame, gap: int = 28) -> DataFrame:
    """(img, x, y, w, h, label): neighbours of one label united if close, of like height and level with the part united so far."""
    item = "struct<x:int,y:int,w:int,h:int,label:int>"
    seq = parts.groupBy("img").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h", "label"))))).alias("ps"))

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        tall = F.greatest(last["h"], p["h"])
        near = (last["label"] == p["label"]) & (p["x"] - (last["x"] + last["w"]) <= gap) & (F.abs(last["y"] - p["y"]) * 10 <= tall * 3) & (F.abs(last["h"] - p["h"]) * 10 <= tall * 3)
        x, y = F.least(last["x"], p["x"]), F.least(last["y"], p["y"])
        both = F.struct(x.alias("x"), y.alias("y"), (F.greatest(last["x"] + last["w"], p["x"] + p["w"]) - x).alias("w"), (F.greatest(last["y"] + last["h"], p["y"] + p["h"]) - y).alias("h"), p["label"].alias("label"))
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both).cast(f"array<{item}>"))).otherwise(F.concat(acc, F.array(p)))

    return seq.select("img", F.inline(F.aggregate(F.slice("ps", 2, F.greatest(F.size("ps") - 1, F.lit(0))), F.slice("ps", 1, 1), step)))


def patches(w: Column, side: int = PATCH, stride: int = PATCH_STRIDE) -> Column:
    """Starts of the patches along a width; the middle one where none fits in full steps."""
    return F.when(w >= side, F.sequence(F.lit(0), (w - side).cast("int"), F.lit(stride))).otherwise(F.array(F.lit(0)))


def patch_vote(parts: DataFrame, votes: DataFrame, cell: int = 256) -> DataFrame:
    """(img, chunk, label): text (1) or formula (0) of chunks (chunk, x, w) by patches (px, pw, p): the overlap is the weight.

    The limit is .65 for chunks below 55 and .40 for others; a tie is text, no patch is formula. Chunks meet patches by
    cells of the width, so only what lies near is paired; a pair counts in the first cell both have.
    """
    cells = lambda x, w: F.sequence(F.floor(F.col(x) / cell), F.greatest(F.floor(F.col(x) / cell), F.floor((F.col(x) + F.col(w) - 1) / cell)))
    over = F.greatest(F.least(F.col("x") + F.col("w"), F.col("px") + F.col("pw")) - F.greatest("x", "px"), F.lit(0))
    limit = F.when(F.col("w") < 55, 0.65).otherwise(0.40)
    near = parts.select("img", "chunk", "x", "w", F.explode(cells("x", "w")).alias("cell")).join(votes.select("img", "px", "pw", "p", F.explode(cells("px", "pw")).alias("cell")), ["img", "cell"])
    hit = near.where(F.col("cell") == F.floor(F.greatest("x", "px") / cell)).withColumn("o", over).where("o > 0").withColumn("text", F.col("p") >= limit)
    sums = hit.groupBy("img", "chunk").agg(F.sum(F.when(F.col("text"), F.col("o")).otherwise(0)).alias("t"), F.sum(F.when(F.col("text"), 0).otherwise(F.col("o"))).alias("f"))
    return parts.join(sums, ["img", "chunk"], "left").select("img", "chunk", F.when(F.col("t").isNull(), 0).when(F.col("t") >= F.col("f"), 1).otherwise(0).alias("label"))


def slot_vote(votes: DataFrame, slot: int = 8, least: float = 0.25) -> DataFrame:
    """(img, slot, label): mean confidence of the patches over each slot of the width; text from `least` up."""
    s = votes.withColumn("slot", F.explode(F.sequence(F.floor(F.col("px") / slot), F.floor((F.col("px") + F.col("pw") - 1) / slot))))
    return s.groupBy("img", "slot").agg((F.round(F.avg("p"), 9) >= least).cast("int").alias("label"))


def half_split(votes: DataFrame) -> DataFrame:
    """(img, label): formula (0) if at least as many patches are at most .5 as above it."""
    return votes.groupBy("img").agg(F.when(F.count_if(F.col("p") <= 0.5) >= F.count_if(F.col("p") > 0.5), 0).otherwise(1).alias("label"))


# Neighbourhoods.


def dilate(mask: DataFrame) -> DataFrame:
    """(img, y, x): set pixels and the eight around each. mask: set pixels."""
    around = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    return mask.select("img", "y", "x", F.explode(around).alias("o")).select("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()


def box_scores(boxes: DataFrame, pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(img, box_id, score): mean probability p over the set pixels within each box; 0 where there are none."""
    on = pixels.join(mask, ["img", "y", "x"], "left_semi").select(F.col("img").alias("i"), F.col("y").alias("py"), F.col("x").alias("px"), "p")
    inside = (F.col("i") == F.col("img")) & F.col("px").between(F.col("x"), F.col("x") + F.col("w") - 1) & F.col("py").between(F.col("y"), F.col("y") + F.col("h") - 1)
    return boxes.join(on, inside, "left").groupBy("img", "box_id").agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("score"))


# The eight neighbours (x, y) in the order they are looked at, where the search begins, and the shortest outline.
AROUND, BEGIN, MIN_POINTS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)), 4, 4


def _trace(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Outlines of the set pixels: from every pixel not on one yet, from neighbour to neighbour, looking first beside the
    one it came from. Pixels inside a region are on no outline, so they begin further ones."""
    h, w = mask.shape
    on = mask.tolist()
    met = [[False] * w for _ in range(h)]
    out = []
    for sy, sx in np.argwhere(mask).tolist():
        if met[sy][sx]:
            continue
        points, x, y, back = [], sx, sy, BEGIN
        while len(points) < min(w * h, MAX_TRACE):
            points.append((x, y))
            met[y][x] = True
            ring = ((back + k) % 8 for k in range(1, 9))
            way = next((d for d in ring if 0 <= x + AROUND[d][0] < w and 0 <= y + AROUND[d][1] < h and on[y + AROUND[d][1]][x + AROUND[d][0]]), None)
            if way is None:
                break
            x, y, back = x + AROUND[way][0], y + AROUND[way][1], (way + 4) % 8
            if (x, y) == (sx, sy) and len(points) >= MIN_TRACE:
                break
        if len(points) >= MIN_POINTS:
            out.append(points)
    return out


def contours(masks: DataFrame) -> DataFrame:
    """(img, contour, points): outlines of four points or more in binary rasters (img, w, h, px). Going from pixel to pixel, it runs per image in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for img, w, h, px in zip(b["img"], b["w"], b["h"], b["px"]):
                for k, points in enumerate(_trace(np.asarray(px).reshape(h, w) > 0)):
                    rows.append((img, k, [{"x": x, "y": y} for x, y in points]))
            yield pd.DataFrame(rows, columns=["img", "contour", "points"])

    return masks.select("img", "w", "h", "px").mapInPandas(run, "img bigint, contour int, points array<struct<x:int,y:int>>")


def smooth_strokes(points: DataFrame) -> DataFrame:
    """Points (stroke, t, x, y) as midpoints with the point before; the first stays."""
    w = Window.partitionBy("stroke").orderBy("t")
    mid = lambda c: F.coalesce((F.lag(c).over(w) + F.col(c)) / 2.0, F.col(c).cast("double"))
    return points.select("stroke", "t", mid("x").alias("x"), mid("y").alias("y"))
