"""Packed ids and geometries against plain loops, smart choices case by case, Unicode forms over all code points."""

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from prismlake.functions import packed, varints
from prismlake.functions.unicode import normal_form, plain_name
from prismlake.operators import places

POINTS = st.tuples(st.integers(-180 * 10**5, 180 * 10**5), st.integers(-90 * 10**5, 90 * 10**5))
SHAPES = st.lists(st.lists(st.lists(POINTS, max_size=6), max_size=3), max_size=3)


def as_arrow(shapes):
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))))
    return pa.array([None if s is None else [[[{"lon": x / 1e5, "lat": y / 1e5} for x, y in ring] for ring in poly] for poly in s] for s in shapes], kind)


def plain_bytes(shape):
    out = []
    zig = lambda v: 2 * v if v >= 0 else -2 * v - 1
    out.append(len(shape))
    for poly in shape:
        out.append(len(poly))
        for ring in poly:
            out.append(len(ring))
            x = y = 0
            for a, b in ring:
                out += [zig(a - x), zig(b - y)]
                x, y = a, b
    return varints.encode(np.array(out, np.int64))[0].tobytes()


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), SHAPES), max_size=5))
def test_geometries_come_back_and_cut_ones_are_null(shapes):
    data = packed.packed_geometry(as_arrow(shapes))
    assert data.to_pylist() == [None if s is None else plain_bytes(s) for s in shapes]
    assert packed.geometry_of(data).to_pylist() == as_arrow(shapes).to_pylist()
    assert packed.geometry_of(data.slice(1)).to_pylist() == as_arrow(shapes).to_pylist()[1:]
    cut = pa.array([d and d[:-1] for d in data.to_pylist()] + [b"\xff" * 12 + b"\x01", b"", b"\x00rest"], pa.binary())
    assert packed.geometry_of(cut).to_pylist() == [None] * len(shapes) + [None, None, []]


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.integers(0, 2**40), max_size=9)), max_size=6))
def test_ids_come_back_and_cut_ones_are_null(lists):
    data = packed.packed_ids(pa.array(lists, pa.list_(pa.int64())))
    assert packed.ids_of(data).to_pylist() == [None if x is None else sorted(set(x)) for x in lists]
    broken = pa.array([None if d is None else d + b"\x80" for d in data.to_pylist()] + [b"\x80" * 11 + b"\x01", b"\x05\x03"], pa.binary())
    assert packed.ids_of(broken).to_pylist() == [None] * len(lists) + [None, [5, 8]]


def test_a_lookup_reads_through_packed_tables(spark):
    square = lambda a, b: [{"lon": a, "lat": a}, {"lon": b, "lat": a}, {"lon": b, "lat": b}, {"lon": a, "lat": b}]
    schema = "id long, local_name string, english_name string, country string, region string, subtype string, admin_level int, area double, min_lon double, max_lon double, min_lat double, max_lat double, geometry array<array<array<struct<lon: double, lat: double>>>>"
    loc = spark.createDataFrame([(1, "A", None, "NL", None, "locality", 3, 1.0, 0.0, 4.0, 0.0, 4.0, [[square(0.0, 4.0), square(1.0, 2.0)]]), (2, "B", None, "NL", None, "locality", 3, 2.0, 0.0, 4.0, 0.0, 4.0, None)], schema)
    grid, small = places.packed_tables(places.cells_of(loc), loc)
    assert dict(grid.dtypes)["locality_ids"] == dict(small.dtypes)["geometry"] == "binary"
    grid = grid.withColumn("locality_ids", F.when(F.col("cell_id") == F.lit(int(90.5 * 10) * 3600 + int(180.5 * 10)), F.lit(b"\xff")).otherwise(F.col("locality_ids")))
    pts = spark.createDataFrame([(1, 0.75, 0.75), (2, 1.5, 1.5), (3, 0.55, 0.55)], "file_id long, latitude double, longitude double")
    got = {r["file_id"]: r["i"] for r in places.resolve(pts, grid, small, "smallest").select("file_id", F.col("place.locality_id").alias("i")).collect()}
    assert got == {1: 1, 2: None, 3: None}


# (id, subtype, level, area, local name, English name) of what holds a point, and the id to choose
CASES = [
    ([(1, "locality", 3, 1.0, "Groot", None), (2, "locality", 3, 0.2, "Klein", "Small")], 2),
    ([(1, "neighborhood", 3, 0.2, "A", None), (2, "microhood", 3, 0.1, "B", None), (3, "country", 1, 9.0, "C", "C")], 2),
    ([(1, "localadmin", 3, 0.2, "A", None), (2, "region", 1, 5.0, "R", None)], 1),
    ([(1, "county", 2, 0.001, "São Pâulo", None), (2, "region", 1, 5.0, "Estado de Sao Paulo", None)], 1),
    ([(1, "county", 2, 0.001, "Fatih", None), (2, "region", 1, 5.0, "Istanbul", None)], 2),
    ([(1, "county", 2, 0.001, "Ab", None), (2, "region", 1, 5.0, "Abc", None)], 2),
    ([(1, "county", 2, 0.005, "Fatih", None), (2, "region", 1, 5.0, "Istanbul", None)], 1),
    ([(1, "borough", 3, 0.2, "A", None), (2, "county", 3, 0.5, "B", None)], 2),
    ([(1, "borough", 3, 0.2, "A", None), (2, "region", 1, 5.0, "R", None), (3, "region", 1, 6.0, "S", None)], 3),
    ([(1, "locality", 3, 1.0, None, None), (2, "county", 2, 5.0, "X", None)], 1),
    ([(1, "locality", 3, 1.0, None, None), (2, "county", 2, 10.0, "X", None), (3, "county", 2, 4.0, "X", "Eng")], 3),
    ([(1, "locality", 3, 1.0, "X", ""), (2, "county", 2, 10.0, "X", None), (3, "county", 2, 41.0, "Y", None)], 1),
    ([(1, "locality", 3, 1.0, "X", "Named"), (2, "county", 2, 40.0, "Y", "Eng")], 1),
    ([(3, "locality", 3, 1.0, "X", None), (2, "locality", 3, 1.0, "Y", None)], 2),
    ([(1, "country", 1, 9.0, "C", "C")], None),
    ([(1, None, None, 2.0, "C", "C"), (2, "region", None, 9.0, None, None)], 1),
]


def test_smart_choice_case_by_case(spark):
    schema = "id long, local_name string, english_name string, country string, region string, subtype string, admin_level int, area double, min_lon double, max_lon double, min_lat double, max_lat double, geometry array<array<array<struct<lon: double, lat: double>>>>"
    rows, pts = [], []
    for n, (held, _) in enumerate(CASES):
        x = float(n * 5)
        ring = [{"lon": a, "lat": b} for a, b in ((x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0))]
        rows += [(100 * n + i, local, english, "NL", None, kind, level, area, x, x + 1, 0.0, 1.0, [[ring]]) for i, kind, level, area, local, english in held]
        pts.append((n, 0.5, x + 0.5))
    loc = spark.createDataFrame(rows, schema)
    got = {r["file_id"]: r["i"] for r in places.resolve(spark.createDataFrame(pts, "file_id long, latitude double, longitude double"), places.cells_of(loc), loc).select("file_id", F.col("place.locality_id").alias("i")).collect()}
    assert got == {n: want and 100 * n + want for n, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_forms_equal_the_standard_library_over_all_code_points(spark, form):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(map(chr, points[i : i + 64])) + "́" for i in range(0, len(points), 64)] + [None, "", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", normal_form(F.col("t"), form).alias("n"))
    assert [r["n"] for r in sorted(df.collect())] == [t and unicodedata.normalize(form, t) for t in texts]


def test_plain_names(spark):
    rows = [("São Pâulo",), ("  İzmir--X ",), ("Groß",), (None,), ("Ångström",)]
    assert [r[0] for r in spark.createDataFrame(rows, "n string").select(plain_name(F.col("n"))).collect()] == ["sao paulo", "izmir x", "gro", "", "angstrom"]


def test_cells_of_points_and_spots(spark):
    """Cells with points only are those of the whole grid that hold one; points of one spot, also under one key, get the same place, others none."""
    from prismlake.functions.columns import grid_cell

    ring = lambda x, y, w, h: [[[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]]
    boxes = [(1, 0.0, 0.0, 40.0, 30.0), (2, 1.55, 1.55, 0.2, 0.2), (3, 170.0, 80.0, 10.0, 10.0), (4, -180.0, -90.0, 3.2, 1.6)]
    loc = spark.createDataFrame([(i, f"c{i}", w * h, x, x + w, y, y + h, ring(x, y, w, h)) for i, x, y, w, h in boxes], "id long, country string, area double, min_lon double, max_lon double, min_lat double, max_lat double, geometry array<array<array<struct<lon: double, lat: double>>>>")
    loc = loc.selectExpr("*", "'n' AS local_name", "CAST(NULL AS STRING) AS english_name", "CAST(NULL AS STRING) AS region", "'locality' AS subtype", "3 AS admin_level")
    spots = [(1.61, 1.61), (1.61, 1.61), (20.0, 20.0), (89.99, 179.99), (90.0, 180.0), (-89.0, -179.0), (50.0, -50.0), (0.0, 0.0), (-0.0, 0.0), (None, 1.0), (95.0, 1.0), (float("nan"), 1.0)]
    points = spark.createDataFrame([(k, *at) for k, at in enumerate(spots)], "file_id long, latitude double, longitude double")
    few = {tuple(r) for r in places.cells_of(loc, points).select("cell_id", "locality_id").collect()}
    held = {r[0] for r in points.where("latitude BETWEEN -90 AND 90").select(grid_cell(F.col("latitude"), F.col("longitude"))).collect()}
    assert few == {tuple(r) for r in places.cells_of(loc).select("cell_id", "locality_id").collect() if r[0] in held}
    plain = places.resolve(points, places.cells_of(loc), loc, "smallest")
    got = {r["file_id"]: r["i"] for r in places.resolve(points, places.cells_of(loc, points), loc, "smallest").select("file_id", F.col("place.locality_id").alias("i")).collect()}
    assert got == {r["file_id"]: r["i"] for r in plain.select("file_id", F.col("place.locality_id").alias("i")).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 5, 6, 9, 10, 11)] == [2, 2, 1, 3, 4, None, None, None, None] and len(got) == len(spots)
    assert got[7] == got[8]
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cell_id" in plan and "BroadcastHashJoin [cell_id" not in plan
