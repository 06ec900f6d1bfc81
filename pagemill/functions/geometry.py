"""Plane geometry of crops, strokes and rotations as column expressions, and the homography of a quad."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.boxes import half_up

# Fixed values.
CORNER_SHARE, CORNER_LEAST, CORNER_MOST = 5, 44, 80
PEN_BASE, PEN_FLOOR, PEN_RANGE = 3.0, 0.3, 0.7
ERASER_BASE = 24.0
GUARD = 1e-12
DOWNSCALE_BYTES, DOWNSCALE_SIDE = 500_000, 1920
MAX_WARP = 4_000_000
RAMP_TOP, RAMP_SHARE, RAMP_LEAST, WAIT_TOP, WAIT_RATE = 85, 0.12, 0.5, 90, 70.0
MIN_CROP = 10

# EXIF orientation: degrees clockwise, and whether mirrored first.
ORIENTATIONS = {1: (0, False), 2: (0, True), 3: (180, False), 4: (180, True), 5: (90, True), 6: (90, False), 7: (270, True), 8: (270, False)}


def rotated_canvas(w: Column, h: Column, degrees: Column) -> Column:
    """struct(w, h) of the canvas that holds a rotated image; sizes are rounded up from six places, so right angles are exact."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    up = lambda v: F.ceil(F.round(v, 6)).cast("int")
    return F.struct(up(w * c + h * s).alias("w"), up(w * s + h * c).alias("h"))


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Ray casting: whether a point lies in a ring of struct(x, y)."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        apart = (a["y"] > y) != (b["y"] > y)
        return F.when(apart, x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]).otherwise(False)

    return F.aggregate(F.zip_with(points, nxt, crosses), F.lit(False), lambda acc, c: acc != c)


def corner_hit(x: Column, y: Column, corners: Column, width: Column) -> Column:
    """Place (from 0) of the first corner nearer than a fifth of the width (within 44 and 80); -1 for none."""
    reach = F.greatest(F.least(width / CORNER_SHARE, F.lit(CORNER_MOST)), F.lit(CORNER_LEAST))
    near = F.transform(corners, lambda c: F.pow(c["x"] - x, 2) + F.pow(c["y"] - y, 2) < F.pow(reach, 2))
    return F.array_position(near, True).cast("int") - 1


def stroke_width(tool: Column, pen: Column, pressure: Column) -> Column:
    """Width of a stroke: erasers are wide, pens follow the pressure."""
    base = F.when(tool == "eraser", ERASER_BASE).otherwise(PEN_BASE)
    return F.when(pen, base * (PEN_FLOOR + PEN_RANGE * pressure)).otherwise(base)


def orientation(code: Column) -> Column:
    """struct(degrees, mirrored) of an EXIF orientation; unknown ones count as upright."""
    deg, mirrored = F.lit(0), F.lit(False)
    for k, (d, m) in ORIENTATIONS.items():
        deg, mirrored = F.when(code == k, d).otherwise(deg), F.when(code == k, m).otherwise(mirrored)
    return F.struct(deg.alias("degrees"), mirrored.alias("mirrored"))


def fit_scale(w: Column, h: Column, box_w: Column, box_h: Column) -> Column:
    return F.least(box_w / w, box_h / h)


def next_progress(percent: Column) -> Column:
    """The next value of a bar that creeps towards 85: an eighth of the way or so, half a percent at least."""
    step = F.greatest(F.lit(RAMP_LEAST), (F.lit(RAMP_TOP) - percent) * RAMP_SHARE)
    return F.least(F.lit(float(RAMP_TOP)), percent + step)


def wait_percent(elapsed_ms: Column, expected_ms: Column) -> Column:
    """Progress while waiting: 70 at the expected time, at most 90."""
    return F.least(half_up(elapsed_ms * WAIT_RATE / expected_ms), F.lit(WAIT_TOP)).cast("int")


def downscaled(size: Column, w: Column, h: Column) -> Column:
    """struct(w, h): images of many bytes are brought to at most 1920 on their longer side."""
    scale = F.lit(float(DOWNSCALE_SIDE)) / F.greatest(w, h)
    much = (size > DOWNSCALE_BYTES) & (F.greatest(w, h) > DOWNSCALE_SIDE)
    return F.struct(F.when(much, half_up(w * scale)).otherwise(w).cast("int").alias("w"), F.when(much, half_up(h * scale)).otherwise(h).cast("int").alias("h"))


def crop_bounds(points: Column, w: Column, h: Column) -> Column:
    """struct(x, y, w, h) of the crop around a path; the whole image for too few points or a crop below 10 pixels."""
    lo = lambda f: F.floor(F.greatest(F.array_min(F.transform(points, lambda p: p[f])), F.lit(0.0)))
    hi = lambda f, most: F.ceil(F.least(F.array_max(F.transform(points, lambda p: p[f])), most.cast("double")))
    x, y = lo("x"), lo("y")
    cw, ch = hi("x", w) - x, hi("y", h) - y
    ok = F.coalesce((F.size(points) >= 4) & (cw >= MIN_CROP) & (ch >= MIN_CROP), F.lit(False))
    pick = lambda a, b: F.when(ok, a).otherwise(b).cast("int")
    return F.struct(pick(x, F.lit(0)).alias("x"), pick(y, F.lit(0)).alias("y"), pick(cw, w).alias("w"), pick(ch, h).alias("h"))


def clipped(pixels: DataFrame, paths: DataFrame) -> DataFrame:
    """(img, x, y, v): pixels (img, x, y, v) within the bounds of their path (img, points), moved to its corner, white outside the path."""
    inside = pixels.join(paths, "img")
    low = lambda f: F.floor(F.array_min(F.transform("points", lambda p: p[f]))).cast("int")
    high = lambda f: F.ceil(F.array_max(F.transform("points", lambda p: p[f]))).cast("int")
    inside = inside.withColumns({"x0": low("x"), "y0": low("y"), "x1": high("x"), "y1": high("y")}).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    middle = lambda c: F.col(c) + 0.5
    # Judged before x and y get their new meaning: a lambda would take the aliases of its own select.
    inside = inside.withColumn("within", in_polygon(middle("x"), middle("y"), F.col("points")))
    return inside.select("img", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), F.when(F.col("within"), F.col("v")).otherwise(255).alias("v"))


def homography(src: np.ndarray, dst: np.ndarray, strict_compat: bool = False) -> np.ndarray | None:
    """The 3x3 matrix that takes four points to four others; None where no such matrix exists.

    With strict_compat rows of the system are never exchanged, and a vanishing pivot means None. As the second row begins
    with three zeros, that is so for every system; nothing in the original calls it, so here it is not the default.
    """
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    left, right = np.array(rows, float), np.array(right, float)
    if strict_compat:
        both = np.column_stack((left, right))
        for k in range(len(both)):
            if abs(both[k, k]) < GUARD:
                return None
            both[k + 1 :] -= np.outer(both[k + 1 :, k] / both[k, k], both[k])
        left, right = np.triu(both[:, :-1]), both[:, -1]
    try:
        return np.append(np.linalg.solve(left, right), 1.0).reshape(3, 3)
    except np.linalg.LinAlgError:
        return None


def homographies(quads: DataFrame) -> DataFrame:
    """(id, m): nine numbers for quads (id, corners as arrays of struct(x, y), w, h) onto their w by h rectangle; null for flat ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, w, h in zip(b["corners"], b["w"], b["h"]):
                m = homography(np.array([[p["x"], p["y"]] for p in c], float), np.array([[0, 0], [w, 0], [w, h], [0, h]], float))
                out.append(None if m is None else m.ravel().tolist())
            yield pd.DataFrame({"id": b["id"], "m": out})

    return quads.select("id", "corners", "w", "h").mapInPandas(run, "id bigint, m array<double>")


def apply_homography(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a matrix of nine numbers; null where the point goes to infinity."""
    d = m[6] * x + m[7] * y + m[8]
    ok = F.abs(d) > GUARD
    return F.struct(F.when(ok, (m[0] * x + m[1] * y + m[2]) / d).alias("x"), F.when(ok, (m[3] * x + m[4] * y + m[5]) / d).alias("y"))


def warp(px: np.ndarray, m: np.ndarray, w: int, h: int) -> np.ndarray:
    """A raster seen through the inverse of m, nearest sample, white outside; scaled down beyond MAX_WARP pixels."""
    scale = min(1.0, (MAX_WARP / (w * h)) ** 0.5)
    w, h = max(1, int(w * scale)), max(1, int(h * scale))
    inv = np.linalg.inv(m)
    y, x = np.mgrid[0:h, 0:w] / scale
    d = inv[2, 0] * x + inv[2, 1] * y + inv[2, 2]
    d = np.where(np.abs(d) < GUARD, GUARD, d)
    sx = np.floor((inv[0, 0] * x + inv[0, 1] * y + inv[0, 2]) / d + 0.5).astype(int)
    sy = np.floor((inv[1, 0] * x + inv[1, 1] * y + inv[1, 2]) / d + 0.5).astype(int)
    inside = (sx >= 0) & (sy >= 0) & (sx < px.shape[1]) & (sy < px.shape[0])
    out = np.full((h, w, *px.shape[2:]), 255, px.dtype)
    out[inside] = px[sy[inside], sx[inside]]
    return out
