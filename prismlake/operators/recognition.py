"""What models return about text in images, turned into regions and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def ctc_text(classes: Column, scores: Column, alphabet: list[str]) -> Column:
    """(text, confidence) of a line from the best class and its score at each step: greedy decoding.

    Class 0 is blank, class n the n-th sign of the alphabet; a repeat of the step before is no new sign. confidence
    is the mean score of the steps that gave one, 0 if none did; a class beyond the alphabet counts but has no sign.
    """
    steps = F.transform(classes, lambda c, i: F.struct(c.alias("c"), F.when(i > 0, F.get(classes, i - 1)).alias("p"), F.get(scores, i).alias("s")))
    given = F.filter(steps, lambda x: (x["c"] != 0) & ~x["c"].eqNullSafe(x["p"]))
    signs = F.array(*[F.lit(a) for a in alphabet]).cast("array<string>")
    text = F.trim(F.array_join(F.transform(given, lambda x: F.coalesce(F.get(signs, x["c"] - 1), F.lit(""))), ""))
    total = F.aggregate(given, F.lit(0.0), lambda a, x: a + x["s"].cast("double"))
    return F.struct(text.alias("text"), F.when(F.size(given) > 0, total / F.size(given)).otherwise(0.0).alias("confidence"))


# fixed values
THRESHOLD, LEAST_PIXELS, LEAST_SPAN, PAD = 0.3, 8, 2, 2


def _regions(values: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) of each 4-connected area of a map at or above the threshold that is large enough, padded.

    Areas are unions of horizontal stretches that touch from row to row, so the work grows with their number however they wind.
    """
    h, w = values.shape
    edge = np.diff(np.pad(values >= THRESHOLD, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, left = np.nonzero(edge == 1)
    right = np.nonzero(edge == -1)[1] - 1
    # the stretches of the next row that lie under each one
    below = (row + 1) * (w + 1)
    first = np.searchsorted(row * (w + 1) + right, below + left)
    last = np.searchsorted(row * (w + 1) + left, below + right, "right")
    up = list(range(len(row)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        for other in range(a, b):
            x, y = top(k), top(other)
            up[max(x, y)] = min(x, y)
    own = np.unique([top(k) for k in up], return_inverse=True)[1] if up else np.zeros(0, int)
    n = int(own.max()) + 1 if up else 0
    pixels = np.bincount(own, right - left + 1, n)
    bounds = [np.full(n, big) for big in (w, h, -1, -1)]
    for out, fold, x in zip(bounds, (np.minimum, np.minimum, np.maximum, np.maximum), (left, row, right, row), strict=True):
        fold.at(out, own, x)
    x0, y0, x1, y1 = bounds
    large = (pixels >= LEAST_PIXELS) & (x1 - x0 >= LEAST_SPAN) & (y1 - y0 >= LEAST_SPAN)
    box = np.stack([np.maximum(x0 - PAD, 0), np.maximum(y0 - PAD, 0), np.minimum(x1 + PAD, w - 1), np.minimum(y1 + PAD, h - 1)], 1)
    return [tuple(b) for b in box[large].tolist()]


def text_regions(maps: DataFrame) -> DataFrame:
    """(file_id, place, left, top, width, height) of text in images, from the top and then from the left.

    maps: (file_id, map_width, map_height, values array<double> by rows, image_width, image_height), a small array for each image.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                boxes = []
                for a, b, c, d in _regions(np.asarray(r.values, float).reshape(r.map_height, r.map_width)):
                    sx, sy = r.image_width / r.map_width, r.image_height / r.map_height
                    boxes.append((int(np.floor(b * sy)), int(np.floor(a * sx)), max(1, int(np.ceil((c - a + 1) * sx))), max(1, int(np.ceil((d - b + 1) * sy)))))
                out += [(r.file_id, i, left, top, w, h) for i, (top, left, w, h) in enumerate(sorted(boxes))]
            yield pd.DataFrame(out, columns=["file_id", "place", "left", "top", "width", "height"])

    own = maps.select("file_id", "map_width", "map_height", F.col("values").cast("array<double>").alias("values"), "image_width", "image_height")
    return own.mapInPandas(find, "file_id long, place int, left int, top int, width int, height int")
