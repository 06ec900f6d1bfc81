"""Inputs of the models as rasters, and places where the caller puts the models in.

Images are (img, w, h, px) with packed colours, row after row. A model is a function from a stack of arrays to a stack of
arrays, made once per task by the function the caller gives; nothing here loads weights. Images pass in batches, so a task
holds one batch of tensors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import rasters as R
from pagemill.operators.decode import argmax, softmax

Model = Callable[[np.ndarray], np.ndarray]

# Sides and fillings of the inputs.
DETECTOR_SIDE, DETECTOR_FILL, WHITE = 768, 114, 255
#: Images that a model gets at once; patches that the region classifier gets, and its answer where it fails.
BATCH, PATCHES, UNSURE = 16, 64, 0.5
ANGLES = (0, 90, 180, 270)


def _round(x: float) -> int:
    return int(np.floor(x + 0.5))


def colours(px: object, w: int, h: int) -> np.ndarray:
    """(h, w, 3) of packed colours."""
    a = np.asarray(px, np.int64).reshape(h, w)
    return np.stack([(a >> 16) & 255, (a >> 8) & 255, a & 255], -1)


def _placed(part: np.ndarray, w: int, h: int, left: int, top: int, fill: float) -> np.ndarray:
    """part on a canvas of one value; what lies outside the canvas is cut off."""
    out = np.full((h, w, 3), float(fill))
    y0, x0 = max(top, 0), max(left, 0)
    cut = part[max(-top, 0) : max(-top, 0) + h - y0, max(-left, 0) : max(-left, 0) + w - x0]
    out[y0 : y0 + cut.shape[0], x0 : x0 + cut.shape[1]] = cut
    return out


def letterboxed(px: np.ndarray, side: int = DETECTOR_SIDE) -> np.ndarray:
    """Formula detector: fitted into a square, filled with gray, 0 to 1."""
    h, w = px.shape[:2]
    scale = min(side / w, side / h)
    nw, nh = _round(w * scale), _round(h * scale)
    return _placed(R.resampled(px, nw, nh), side, side, _round((side - nw) / 2 - 0.1), _round((side - nh) / 2 - 0.1), DETECTOR_FILL) / 255


def _signed(px: np.ndarray) -> np.ndarray:
    """Blue first, -1 to 1."""
    return (px[..., ::-1] / 255 - 0.5) / 0.5


def text_input(px: np.ndarray, side: int = R.TEXT_SIDE, step: int = R.TEXT_STEP) -> np.ndarray:
    """Text detector: long side limited, padded with white at the right and below to full steps."""
    h, w = px.shape[:2]
    scale = min(1.0, side / max(w, h))
    nw, nh = max(1, _round(w * scale)), max(1, _round(h * scale))
    return _signed(_placed(R.resampled(px, nw, nh), -(-nw // step) * step, -(-nh // step) * step, 0, 0, WHITE))


def line_input(px: np.ndarray, height: int = R.LINE_HEIGHT, most: int = R.LINE_WIDTH) -> np.ndarray:
    """Text recogniser: one height, the width after the picture's, padded with black to the most."""
    h, w = px.shape[:2]
    nw = min(max(int(np.ceil(height * w / h)), 4), most)
    return _signed(_placed(R.resampled(px, nw, height), most, height, 0, 0, 0))


def stretched(px: np.ndarray, side: int = R.FORMULA_SIDE) -> np.ndarray:
    """Formula encoder: stretched to a square, -1 to 1."""
    return R.resampled(px, side, side) * 2 / 255 - 1


def _imagenet(px: np.ndarray) -> np.ndarray:
    return (px / 255 - R.IMAGENET_MEAN) / R.IMAGENET_STD


def oriented_input(px: np.ndarray, short: int = R.ORIENT_SHORT, crop: int = R.ORIENT_CROP) -> np.ndarray:
    """Orientation: short side to one length, then the middle square, white where there is none."""
    h, w = px.shape[:2]
    nw, nh = _round(w * short / min(w, h)), _round(h * short / min(w, h))
    return _imagenet(_placed(R.resampled(px, nw, nh), crop, crop, -((nw - crop) // 2), -((nh - crop) // 2), WHITE))


def patch_input(px: np.ndarray, side: int = R.PATCH) -> np.ndarray:
    """Region classifier: fitted into the middle of a white square."""
    h, w = px.shape[:2]
    scale = min(side / w, side / h)
    nw, nh = max(1, _round(w * scale)), max(1, _round(h * scale))
    return _imagenet(_placed(R.resampled(px, nw, nh), side, side, (side - nw) // 2, (side - nh) // 2, WHITE))


def composed(px: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """A drawing laid on white."""
    a = alpha[..., None] / 255
    return px * a + WHITE * (1 - a)


def on_white(v: Column, alpha: Column) -> Column:
    """A channel of a drawing (0 to 255) laid on white."""
    return F.floor(v * alpha / 255.0 + WHITE * (1 - alpha / 255.0) + 0.5).cast("int")


def inferred(images: DataFrame, prepare: Callable[[np.ndarray], np.ndarray], make_model: Callable[[], Model], batch: int = BATCH, failed: float | None = None) -> DataFrame:
    """(img, shape, data, error): the model's answer for each image (img, w, h, px), flat, with the shape of its input.

    prepare makes the input (h, w, 3) of an image; the model gets inputs of one shape channel-major, `batch` at most, and
    answers one row per input. An image without pixels, or one on which the model fails, comes out with the error and a null
    answer, or with `failed` in place of each value of the answer if that is given.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            rows: list[tuple] = []
            ready: dict[tuple[int, ...], list[tuple[int, np.ndarray]]] = {}

            def ask(shape: tuple[int, ...]) -> None:
                waiting = ready.pop(shape)
                try:
                    answers = np.asarray(model(np.stack([x for _, x in waiting])), np.float32)
                    rows.extend((i, list(shape), a.ravel(), None) for (i, _), a in zip(waiting, answers))
                except Exception as e:  # noqa: BLE001 - the caller's model may fail in any way; the row says so
                    rows.extend((i, list(shape), None if failed is None else np.float32([failed]), str(e)) for i, _ in waiting)

            for i, w, h, px in zip(frame["img"].tolist(), frame["w"], frame["h"], frame["px"]):
                if px is None or not len(px) or w * h != len(px):
                    rows.append((i, None, None if failed is None else np.float32([failed]), "no pixels"))
                    continue
                x = prepare(colours(px, int(w), int(h))).transpose(2, 0, 1).astype(np.float32)
                ready.setdefault(x.shape, []).append((i, x))
                if len(ready[x.shape]) >= batch:
                    ask(x.shape)
            for shape in list(ready):
                ask(shape)
            yield pd.DataFrame(rows, columns=["img", "shape", "data", "error"])

    return images.select("img", "w", "h", "px").mapInPandas(run, "img bigint, shape array<bigint>, data array<float>, error string")


def formula_detector(images: DataFrame, make_model: Callable[[], Model], side: int = DETECTOR_SIDE) -> DataFrame:
    """(img, data) for `boxes.anchor_rows`."""
    return inferred(images, lambda px: letterboxed(px, side), make_model).where("data is not null").select("img", "data")


def encoder(images: DataFrame, make_model: Callable[[], Model], side: int = R.FORMULA_SIDE) -> DataFrame:
    """(img, state) for `decode.decode_images`."""
    return inferred(images, lambda px: stretched(px, side), make_model).where("data is not null").select("img", F.col("data").alias("state"))


def text_detector(images: DataFrame, make_model: Callable[[], Model]) -> DataFrame:
    """(img, w, h, p): probabilities over the padded input."""
    return inferred(images, text_input, make_model).where("data is not null").select("img", F.col("shape")[2].cast("int").alias("w"), F.col("shape")[1].cast("int").alias("h"), F.col("data").alias("p"))


def recogniser(lines: DataFrame, make_model: Callable[[], Model], classes: int) -> DataFrame:
    """(box, t, id, v) for `decode.collapse`: the label of every time step of a line and its score. lines: images of lines."""
    out = inferred(lines, line_input, make_model).where("data is not null")
    steps = F.transform(F.sequence(F.lit(0), (F.size("data") / classes).cast("int") - 1), lambda t: F.slice("data", (t * classes + 1).cast("int"), classes))
    flat = out.where(F.size("data") >= classes).select(F.col("img").alias("box"), F.posexplode(steps).alias("t", "logits"))
    return flat.select("box", "t", argmax(F.col("logits")).alias("id"), F.array_max("logits").cast("double").alias("v"))


def region_classifier(patches: DataFrame, make_model: Callable[[], Model]) -> DataFrame:
    """(img, p): how likely a patch is text, UNSURE where the model fails; patches pass PATCHES at a time."""
    out = inferred(patches, patch_input, make_model, PATCHES, UNSURE)
    return out.select("img", F.when(F.col("error").isNotNull(), F.lit(UNSURE)).otherwise(F.get(softmax(F.col("data")), F.lit(1))).alias("p"))


def orientation(images: DataFrame, make_model: Callable[[], Model]) -> DataFrame:
    """(img, angle, confidence): the answer of the orientation model. Pictures are not turned by it; it is only told."""
    p = inferred(images, oriented_input, make_model).where("data is not null").select("img", softmax(F.col("data")).alias("p"))
    return p.select("img", F.element_at(F.array(*map(F.lit, ANGLES)), argmax(F.col("p")) + 1).alias("angle"), F.array_max("p").alias("confidence"))
