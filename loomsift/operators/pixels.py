"""Pictures as rows: binary RGBA with width and height; pixel work in numpy, one batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIDES = (8, 16, 32)
SCORE_FLOOR = 0.05
#: A rectangle that hides text is this much larger on each side, in pixels.
PADDING = 4


def _clip(rect: dict, width: int, height: int) -> tuple[int, int, int, int]:
    x0, y0 = max(0, int(np.floor(rect["x"]))), max(0, int(np.floor(rect["y"])))
    x1, y1 = min(width, int(np.ceil(rect["x"] + rect["width"]))), min(height, int(np.ceil(rect["y"] + rect["height"])))
    return x0, y0, x1, y1


def blackout(image: np.ndarray, rect: dict) -> None:
    x0, y0, x1, y1 = _clip(rect, image.shape[1], image.shape[0])
    image[y0:y1, x0:x1] = (0, 0, 0, 255)


def box_blur(image: np.ndarray, rect: dict, radius: int) -> None:
    """Mean over a square; at least an eighth of the shorter side wide, so that nothing stays legible."""
    x0, y0, x1, y1 = _clip(rect, image.shape[1], image.shape[0])
    if x1 <= x0 or y1 <= y0:
        return
    r = max(radius, -(-min(x1 - x0, y1 - y0) // 8), 1)
    part = np.pad(image[y0:y1, x0:x1].astype(np.float64), ((r, r), (r, r), (0, 0)), mode="edge")
    total = np.pad(part.cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
    k = 2 * r + 1
    image[y0:y1, x0:x1] = np.round((total[k:, k:] - total[:-k, k:] - total[k:, :-k] + total[:-k, :-k]) / (k * k)).astype(np.uint8)


def pixelate(image: np.ndarray, rect: dict, block: int) -> None:
    x0, y0, x1, y1 = _clip(rect, image.shape[1], image.shape[0])
    for y in range(y0, y1, max(1, block)):
        for x in range(x0, x1, max(1, block)):
            part = image[y : min(y + block, y1), x : min(x + block, x1)]
            part[...] = np.round(part.reshape(-1, part.shape[-1]).mean(0)).astype(np.uint8)


def apply_operations(images: DataFrame, radius: int = 8, block: int = 12) -> DataFrame:
    """image_id, width, height, data, ops (array of struct(op, rect)) to the data with all ops applied in order, and counters.

    requested, applied, outside (off the picture). An unknown op is a blackout: nothing sensitive stays by mistake.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, w, h, data, ops in zip(rows["image_id"], rows["width"], rows["height"], rows["data"], rows["ops"], strict=True):
                image = np.frombuffer(data, np.uint8).reshape(h, w, 4).copy()
                ops = [] if ops is None else list(ops)
                applied = 0
                for op in ops:
                    x0, y0, x1, y1 = _clip(op["rect"], w, h)
                    if x1 <= x0 or y1 <= y0:
                        continue
                    applied += 1
                    if op["op"] == "blur":
                        box_blur(image, op["rect"], radius)
                    elif op["op"] == "pixelate":
                        pixelate(image, op["rect"], block)
                    else:
                        blackout(image, op["rect"])
                out.append((i, w, h, image.tobytes(), len(ops), applied, len(ops) - applied))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "data", "requested", "applied", "outside"])

    return images.select("image_id", "width", "height", "data", "ops").mapInPandas(run, "image_id bigint, width int, height int, data binary, requested bigint, applied bigint, outside bigint")


def region_stats(images: DataFrame) -> DataFrame:
    """Mean and spread of brightness and distinct colours in `rect` of each picture."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, w, h, data, rect in zip(rows["image_id"], rows["width"], rows["height"], rows["data"], rows["rect"], strict=True):
                x0, y0, x1, y1 = _clip(rect, w, h)
                part = np.frombuffer(data, np.uint8).reshape(h, w, 4)[y0:y1, x0:x1]
                grey = part[..., :3].astype(float) @ (0.299, 0.587, 0.114)
                out.append((i, grey.mean() if grey.size else None, grey.std() if grey.size else None, len(np.unique(part.reshape(-1, 4), axis=0))))
            yield pd.DataFrame(out, columns=["image_id", "mean", "spread", "colours"])

    return images.select("image_id", "width", "height", "data", "rect").mapInPandas(run, "image_id bigint, mean double, spread double, colours bigint")


def unchanged_outside(before: np.ndarray, after: np.ndarray, rects: list[dict]) -> bool:
    """Do two pictures agree outside the rectangles?"""
    kept = np.ones(before.shape[:2], bool)
    for r in rects:
        x0, y0, x1, y1 = _clip(r, before.shape[1], before.shape[0])
        kept[y0:y1, x0:x1] = False
    return before.shape == after.shape and bool((before[kept] == after[kept]).all())


def to_bgr_planes(image: np.ndarray) -> np.ndarray:
    """RGBA rows to float planes of blue, green, red."""
    return image[..., 2::-1].transpose(2, 0, 1).astype(np.float32)


def letterboxed(image: np.ndarray, target: int) -> np.ndarray:
    """The picture bilinearly scaled into the middle of a black square."""
    h, w = image.shape[:2]
    scale = min(target / w, target / h)
    tw, th = max(1, round(w * scale)), max(1, round(h * scale))
    y, x = (np.arange(th) + 0.5) / th * h - 0.5, (np.arange(tw) + 0.5) / tw * w - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None, None], np.clip(x - x0, 0, 1)[None, :, None]
    src = image.astype(np.float64)
    mixed = (src[y0][:, x0] * (1 - fx) + src[y0][:, x1] * fx) * (1 - fy) + (src[y1][:, x0] * (1 - fx) + src[y1][:, x1] * fx) * fy
    out = np.zeros((target, target, image.shape[2]), np.uint8)
    out[..., 3:] = 255
    top, left = (target - th) // 2, (target - tw) // 2
    out[top : top + th, left : left + tw] = np.round(mixed).astype(np.uint8)
    return out


def decode_faces(outputs: DataFrame, size: int) -> DataFrame:
    """Boxes of a face detector's raw outputs: frame_id, stride, cls, obj (array<float>), bbox (array<float>, four a cell).

    A cell's score is the geometric mean of its two, and must reach 0.05. Centre and size come from the cell's place.
    """
    per_row = F.floor(F.lit(size) / F.col("stride"))
    unit: Column = F.col("stride").cast("double")
    fit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    cells = outputs.select("frame_id", "stride", "obj", "bbox", F.posexplode("cls").alias("i", "c"))
    cells = cells.withColumns({"score": F.sqrt(fit(F.col("c")) * fit(F.get("obj", F.col("i")))), "row": F.floor(F.col("i") / per_row), "col": F.col("i") % per_row}).where(F.col("score") >= SCORE_FLOOR)
    b = lambda k: F.get("bbox", F.col("i") * 4 + k).cast("double")
    w, h = F.exp(b(2)) * unit, F.exp(b(3)) * unit
    cx, cy = (F.col("col") + b(0)) * unit, (F.col("row") + b(1)) * unit
    return cells.select("frame_id", "stride", F.col("i").cast("int").alias("cell"), "score", F.struct((cx - w / 2).alias("x"), (cy - h / 2).alias("y"), w.alias("width"), h.alias("height")).alias("rect"))
