"""What a face detector returns, turned into faces: decoding its heads, suppression, alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prismlake.operators.clustering import kept_boxes

# fixed values: the detector's strides, least score and least side, what overlap suppresses, and the places of eyes, nose and mouth in an aligned face
STRIDES, LEAST_SCORE, LEAST_SIDE, OVERLAP = (8, 16, 32), 0.55, 2, 0.4
TARGET = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
SIDE, LEAST_DETERMINANT = 112, 1e-8


def decoded(heads: DataFrame) -> DataFrame:
    """(file_id, box_id, score, x1, y1, x2, y2, landmarks) of heads in image coordinates, before suppression.

    heads: (file_id, input_width, input_height, width, height, levels array<struct<scores, boxes, landmarks>>), flat arrays for strides 8, 16
    and 32. Two anchors sit on each cell of a stride's grid, row by row. A box is four distances from its anchor, to the left, top, right and
    bottom, a landmark an offset, both in strides. Arrays that are too short end a level; anchors of low score and boxes of under two pixels
    within the input are left out. box_id is in order of level and anchor. Only anchors of enough score become rows.
    """
    stride = F.get(F.array(*[F.lit(s) for s in STRIDES]), F.col("level"))
    rows = heads.select("file_id", "input_width", "input_height", "width", "height", F.posexplode("levels").alias("level", "head")).where(F.col("level") < len(STRIDES)).withColumn("stride", stride)
    head = lambda c: F.col("head")[c]
    columns, lines = F.floor(F.col("input_width") / F.col("stride")), F.floor(F.col("input_height") / F.col("stride"))
    n = F.least(F.size(head("scores")), F.floor(F.size(head("boxes")) / 4), F.floor(F.size(head("landmarks")) / 10), columns * lines * 2)
    good = F.filter(F.transform(head("scores"), lambda s, i: F.struct(s.cast("double").alias("score"), i.alias("anchor"))), lambda x: (x["score"] >= LEAST_SCORE) & (x["anchor"] < F.col("n")))
    rows = rows.withColumn("n", n).withColumn("columns", columns).select("*", F.explode(good).alias("a"))
    anchor, step = F.col("a.anchor"), F.col("stride").cast("double")
    cell = F.floor(anchor / 2)
    x, y = (cell % F.col("columns")) * step, F.floor(cell / F.col("columns")) * step
    box = [F.get(head("boxes"), anchor * 4 + k).cast("double") * step for k in range(4)]
    zero, sx, sy = F.lit(0.0), F.col("width") / F.col("input_width"), F.col("height") / F.col("input_height")
    sides = {"x1": F.greatest(zero, x - box[0]), "y1": F.greatest(zero, y - box[1]), "x2": F.least(F.col("input_width").cast("double"), x + box[2]), "y2": F.least(F.col("input_height").cast("double"), y + box[3])}
    mark = lambda k: F.get(head("landmarks"), anchor * 10 + k).cast("double") * step
    marks = F.array(*[F.struct(((x + mark(2 * k)) * sx).alias("x"), ((y + mark(2 * k + 1)) * sy).alias("y")) for k in range(5)])
    rows = rows.select("file_id", (F.col("level").cast("long") * (1 << 40) + anchor).alias("box_id"), F.col("a.score").alias("score"), *[c.alias(k) for k, c in sides.items()], marks.alias("landmarks"), sx.alias("sx"), sy.alias("sy"))
    rows = rows.where((F.col("x2") - F.col("x1") >= LEAST_SIDE) & (F.col("y2") - F.col("y1") >= LEAST_SIDE))
    return rows.select("file_id", "box_id", "score", (F.col("x1") * F.col("sx")).alias("x1"), (F.col("y1") * F.col("sy")).alias("y1"), (F.col("x2") * F.col("sx")).alias("x2"), (F.col("y2") * F.col("sy")).alias("y2"), "landmarks")


def recognition_quality() -> Column:
    """Score times size, full from 140 pixels on, times the distance of the eyes, full from 0.35 of the shorter side on."""
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    left, right = F.col("landmarks")[0], F.col("landmarks")[1]
    eyes = F.hypot(right["x"] - left["x"], right["y"] - left["y"]) / F.greatest(F.lit(1.0), side * 0.35)
    return F.col("score") * F.least(F.lit(1.0), side / 140) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), eyes))


def detected(heads: DataFrame) -> DataFrame:
    """`decoded` boxes that no better box of the image overlaps by 0.4 or more, with their quality."""
    boxes = decoded(heads)
    x, y = F.col("x1"), F.col("y1")
    kept = kept_boxes(boxes.select("file_id", "box_id", x.alias("x"), y.alias("y"), (F.col("x2") - x).alias("w"), (F.col("y2") - y).alias("h"), "score"), OVERLAP)
    return boxes.join(kept, ["file_id", "box_id"], "left_semi").withColumn("quality", recognition_quality())


def similarity(landmarks: Column, whole: bool = False) -> Column:
    """(a, b, tx, ty) of the least-squares map x' = a x - b y + tx, y' = b x + a y + ty of five points to their places in an aligned face.

    Null if there aren't five points, all are one, or the map would shrink everything to a point. With `whole` each map is as its sums
    give it: infinite or not a number where all points are one, and of the coordinates that are there where some are null.
    """
    points = [(F.get(landmarks, F.lit(k))["x"].cast("double"), F.get(landmarks, F.lit(k))["y"].cast("double"), *TARGET[k]) for k in range(5)]

    def total(terms: list[Column]) -> Column:
        """Their sum; with `whole` of those that aren't null, as SQL's sum() has it."""
        return F.when(F.coalesce(*terms).isNotNull(), sum(F.coalesce(c, F.lit(0.0)) for c in terms)) if whole else sum(terms)

    (x, y), (u, v) = (total([p[k] for p in points]) for k in (0, 1)), (sum(t[k] for t in TARGET) for k in (0, 1))
    square, along, across = total([x * x + y * y for x, y, _, _ in points]), total([x * u + y * v for x, y, u, v in points]), total([x * v - y * u for x, y, u, v in points])
    # whether points are apart is told from the middle, where nothing cancels; the map's sums are plain ones in the order of the points, as SQL has them
    spread = sum((p[0] - x / 5) * (p[0] - x / 5) + (p[1] - y / 5) * (p[1] - y / 5) for p in points)
    below = square - (x * x + y * y) / 5
    over = lambda c: F.when(below != 0, c / below).otherwise(c * float("inf"))  # noqa: E731 (Spark's own division by zero is an error)
    a, b = over(along - (x * u + y * v) / 5), over(across - (x * v - y * u) / 5)
    out = F.struct(a.alias("a"), b.alias("b"), ((F.lit(u) - a * x + b * y) / 5).alias("tx"), ((F.lit(v) - b * x - a * y) / 5).alias("ty"))
    if whole:
        return out
    return F.when((F.size(landmarks) >= 5) & (spread >= LEAST_DETERMINANT), F.when(a * a + b * b >= LEAST_DETERMINANT, out))


def _warp(raw: bytes, width: int, height: int, a: float, b: float, tx: float, ty: float) -> bytes | None:
    if width < 2 or height < 2 or len(raw) < 3 * width * height:
        return None
    image = np.frombuffer(raw, np.uint8, 3 * width * height).reshape(height, width, 3).astype(float)
    dx, dy = np.arange(SIDE)[None, :] - tx, np.arange(SIDE)[:, None] - ty
    x, y = (a * dx + b * dy) / (a * a + b * b), (a * dy - b * dx) / (a * a + b * b)
    inside = (x >= 0) & (y >= 0) & (x < width - 1) & (y < height - 1)
    left, top = np.floor(x[inside]).astype(int), np.floor(y[inside]).astype(int)
    fx, fy = (x[inside] - left)[:, None], (y[inside] - top)[:, None]
    above = image[top, left] * (1 - fx) + image[top, left + 1] * fx
    below = image[top + 1, left] * (1 - fx) + image[top + 1, left + 1] * fx
    out = np.zeros((SIDE, SIDE, 3), np.uint8)
    out[inside] = np.floor(above * (1 - fy) + below * fy + 0.5)
    return out.tobytes()


def warped(raw: Column, width: Column, height: Column, transform: Column) -> Column:
    """The aligned face, 112 by 112 pixels of three bytes, of an image (rows of pixels of three bytes) under a `similarity`.

    Bilinear samples; what lies outside the image is black. Null without an image, enough bytes or a transform.
    """

    def batch(raw: pa.Array, width: pa.Array, height: pa.Array, transform: pa.Array) -> pa.Array:
        rows = zip(raw, width.to_pylist(), height.to_pylist(), transform.to_pylist(), strict=True)
        return pa.array([_warp(r.as_buffer(), w, h, *[t[k] for k in ("a", "b", "tx", "ty")]) if t and r.is_valid and w is not None and h is not None else None for r, w, h, t in rows], pa.binary())

    batch.__annotations__ = dict.fromkeys(("raw", "width", "height", "transform", "return"), pa.Array)
    return F.arrow_udf(batch, "binary")(raw, width, height, transform)
