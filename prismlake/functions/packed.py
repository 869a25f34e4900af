"""Packed place data: lists of ids and multipolygons as bytes, decoded a batch at once.

Ids are ascending and stored as differences. A multipolygon is its number of polygons, each its number of rings, each its
number of points and then the differences of their x and y from the point before, a ring's first point from zero, in units
of 1/100,000 degree with the sign in the lowest bit. All numbers are variable-length bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from prismlake.functions import varints

#: Units of one degree.
SCALE = 100_000
POINT = "struct<lon: double, lat: double>"
GEOMETRY = f"array<array<array<{POINT}>>>"


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of all rows, where each row's begin and end, and which rows are whole: not null, not cut off, no value too long."""
    part = column.cast(pa.large_binary())
    _, offsets, data = part.buffers()
    at = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1] if len(part) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    whole = np.array(part.is_valid()) if len(part) else np.zeros(0, bool)
    size = np.diff(at)
    last = np.zeros(len(part), np.uint8)
    last[size > 0] = b[at[1:][size > 0] - 1]
    whole &= last < 128
    # ten bytes that all go on are a value too long
    on = np.concatenate([[0], np.cumsum(b >= 128)])
    far = np.flatnonzero(on[np.minimum(np.arange(len(b)) + 9, len(b))] - on[:-1] == 9) if len(b) > 8 else np.zeros(0, np.int64)
    whole[np.unique(np.searchsorted(at, far, "right") - 1)] = False
    size = np.where(whole, size, 0)
    mine = np.repeat(at[:-1] - np.cumsum(size) + size, size) + np.arange(size.sum())
    kept = b[mine]
    before = np.concatenate([[0], np.cumsum(kept < 128)])
    end = before[np.cumsum(size)]
    return varints.decode(kept), np.concatenate([[0], end[:-1]]) if len(end) else end, end


def _whole(column: pa.Array) -> np.ndarray:
    return np.array(column.is_valid()) if len(column) else np.zeros(0, bool)


def _lists(values: pa.Array, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Lists of given sizes over values."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    if null is None or not null.any():
        return pa.ListArray.from_arrays(offsets, values)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False)), values)


def ids_of(column: pa.Array) -> pa.Array:
    values, start, end = _values(column)
    size = end - start
    run = np.cumsum(values)
    before = np.concatenate([[0], run])[start]
    # a row that isn't null but has no values is broken, unless it has no bytes
    broken = ~_whole(column) | ((size == 0) & (np.array(pc.binary_length(column).fill_null(0)) > 0))
    return _lists(pa.array(run - np.repeat(before, size)), size, broken)


def _rings(values: list[int], at: int, end: int) -> tuple[list[int], list[int], list[int]] | None:
    """Rings of each polygon, points of each ring, and where each ring's points begin; None if the values end too early."""
    if at >= end:
        return None
    rings, points, begin = [], [], []
    polygons, at = values[at], at + 1
    for _ in range(polygons):
        if at >= end:
            return None
        n, at = values[at], at + 1
        rings.append(n)
        for _ in range(n):
            if at >= end or at + 1 + 2 * values[at] > end:
                return None
            points.append(values[at])
            begin.append(at + 1)
            at += 1 + 2 * values[at]
    return rings, points, begin


def geometry_of(column: pa.Array) -> pa.Array:
    values, start, end = _values(column)
    every, whole = values.tolist(), _whole(column)
    polygons, rings, points, begin, null = [], [], [], [], np.ones(len(column), bool)
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        found = _rings(every, a, b) if whole[i] else None
        null[i] = found is None
        r, p, s = found or ([], [], [])
        polygons.append(len(r))
        rings += r
        points += p
        begin += s
    points, begin = np.array(points, np.int64), np.array(begin, np.int64)
    n = points.sum()
    at = np.repeat(begin - 2 * (np.cumsum(points) - points), points) + 2 * np.arange(n)
    first = np.repeat(np.cumsum(points) - points, points)
    coordinates = []
    for k in (0, 1):
        d = varints.unzigzag(values[at + k]) if n else np.zeros(0, np.int64)
        run = np.concatenate([[0], np.cumsum(d)])
        coordinates.append(pa.array((run[1:] - run[first]) / SCALE))
    flat = pa.StructArray.from_arrays(coordinates, ["lon", "lat"])
    return _lists(_lists(_lists(flat, points), np.array(rings, np.int64)), np.array(polygons, np.int64), null)


def packed_ids(column: pa.Array) -> pa.Array:
    size = np.array(pc.list_value_length(column).fill_null(0)).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    ids, row = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), size)
    order = np.lexsort((ids, row))
    ids, row = ids[order], row[order]
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    new = first | np.concatenate([[True], ids[1:] != ids[:-1]]) if len(row) else first
    ids, row, first = ids[new], row[new], first[new]
    data, used = varints.encode(np.where(first, ids, np.diff(ids, prepend=0)))
    ends = np.cumsum(np.bincount(row, used, len(column)).astype(np.int64))
    offsets, null = np.concatenate([[0], ends]).astype(np.int32), pc.invert(column.is_valid()).to_numpy(zero_copy_only=False)
    validity = None if not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(column), [validity, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def packed_geometry(column: pa.Array) -> pa.Array:
    out = []
    for polygons in column.to_pylist():
        if polygons is None:
            out.append(None)
            continue
        parts = [np.array([len(polygons)])]
        for rings in polygons:
            parts.append(np.array([len(rings)]))
            for ring in rings:
                xy = np.rint(np.array([(p["lon"], p["lat"]) for p in ring], float).reshape(-1, 2) * SCALE).astype(np.int64)
                parts += [np.array([len(ring)]), varints.zigzag(np.diff(xy, axis=0, prepend=np.zeros((1, 2), np.int64)).ravel())]
        out.append(varints.encode(np.concatenate(parts))[0].tobytes())
    return pa.array(out, pa.binary())


def _udf(f, kind: str):
    def batch(column: pa.Array) -> pa.Array:
        return f(column)

    batch.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, kind)


def unpack_ids(c: Column) -> Column:
    """array<long> of packed ids; null for null and for bytes that end within a value."""
    return _udf(ids_of, "array<long>")(c)


def unpack_geometry(c: Column) -> Column:
    """Polygons of rings of points of a packed multipolygon; null for null and for bytes that end too early. What follows it is passed over."""
    return _udf(geometry_of, GEOMETRY)(c)


def pack_ids(c: Column) -> Column:
    """Distinct ids (0 or more) of a list in ascending order, packed."""
    return _udf(packed_ids, "binary")(c)


def pack_geometry(c: Column) -> Column:
    """Polygons of rings of points (lon, lat), rounded to 1/100,000 degree, packed."""
    return _udf(packed_geometry, "binary")(c)
