"""Reverse geocoding on a grid, and what is known by place."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prismlake.functions import packed
from prismlake.functions.columns import grid_cell, valid_coordinates
from prismlake.functions.unicode import plain_name


def _inside(x: np.ndarray, y: np.ndarray, polygons: list | None) -> np.ndarray:
    """Which points lie in a multipolygon: polygons of rings, of which all but the first are holes (even-odd rule)."""
    hit = np.zeros(len(x), bool)
    for rings in polygons if polygons is not None else ():
        inside = np.zeros(len(x), bool)
        for ring in rings:
            p = np.array([(q["lon"], q["lat"]) for q in ring], float)
            if len(p) < 3:
                continue
            for (ax, ay), (bx, by) in zip(p, np.roll(p, 1, axis=0), strict=True):
                if ay != by:
                    inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        hit |= inside
    return hit


def in_polygons(lon: pd.Series, lat: pd.Series, locality: pd.Series, geometry: pd.Series) -> pd.Series:
    """Whether each point lies in its locality's geometry; a batch decodes each geometry once and tests all its points together."""
    x, y, keep = lon.to_numpy(float), lat.to_numpy(float), np.zeros(len(lon), bool)
    for at in locality.groupby(locality).indices.values():
        keep[at] = _inside(x[at], y[at], geometry.iloc[at[0]])
    return pd.Series(keep)


def in_packed(lon: pd.Series, lat: pd.Series, locality: pd.Series, geometry: pd.Series) -> pd.Series:
    """`in_polygons` for packed geometries; of a batch's geometries each is unpacked once."""
    first = list(locality.groupby(locality).indices.values())
    found = packed.geometry_of(pa.array([geometry.iloc[at[0]] for at in first], pa.binary())).to_pylist()
    x, y, keep = lon.to_numpy(float), lat.to_numpy(float), np.zeros(len(lon), bool)
    for at, polygons in zip(first, found, strict=True):
        keep[at] = _inside(x[at], y[at], polygons)
    return pd.Series(keep)


def unpacked_cells(grid: DataFrame) -> DataFrame:
    """(cell_id, locality_id) of a grid table (cell_id, locality_ids), whose ids are packed; cells whose bytes are broken have none."""
    return grid.select("cell_id", F.explode(packed.unpack_ids(F.col("locality_ids"))).alias("locality_id"))


def packed_tables(cells: DataFrame, localities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grid and localities with packed ids and geometries, as a places database has them."""
    grid = cells.groupBy("cell_id").agg(F.collect_set("locality_id").alias("ids")).select("cell_id", packed.pack_ids(F.col("ids")).alias("locality_ids"))
    return grid, localities.withColumn("geometry", packed.pack_geometry(F.col("geometry")))


def candidates(points: DataFrame, cells: DataFrame, localities: DataFrame) -> DataFrame:
    """Points with every locality that holds them: equal grid cell, then bounding box, then polygon.

    cells: (cell_id, locality_id), or (cell_id, locality_ids) packed; geometries may be packed, and are unpacked after the boxes.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    at = points.where(valid_coordinates()).withColumn("cell_id", grid_cell(lat, lon))
    if "locality_ids" in cells.columns:
        cells = unpacked_cells(cells.join(at.select("cell_id").distinct(), "cell_id", "left_semi"))
    # estimates of exploded cells and of geometries are far too low, so that without hints they would be broadcast
    at = at.join(cells.hint("merge"), "cell_id")
    box = at.join(localities.hint("merge"), F.col("locality_id") == localities["id"]).where(lat.between(F.col("min_lat"), F.col("max_lat")) & lon.between(F.col("min_lon"), F.col("max_lon")))
    inside = F.pandas_udf(in_packed if dict(localities.dtypes)["geometry"] == "binary" else in_polygons, "boolean")
    return box.where(inside(lon, lat, F.col("locality_id"), F.col("geometry"))).drop("geometry", "cell_id")


def _spots(points: DataFrame) -> DataFrame:
    """(latitude, longitude) of points with valid coordinates, each once: however many points lie on a spot, it is looked up once."""
    return points.where(valid_coordinates()).select("latitude", "longitude").distinct()


def _of_spots(points: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column) of all points from found (latitude, longitude, column); points without valid coordinates are dealt by key, not to one task."""
    at = F.when(valid_coordinates(), F.col("latitude")).otherwise(F.pmod(F.xxhash64(key), F.lit(1 << 40)) + 1000.0)
    own = points.select(key, at.alias("_lat"), F.col("longitude").alias("_lon"))
    return own.join(found, (F.col("_lat") == F.col("latitude")) & (F.col("_lon") == F.col("longitude")), "left").select(key, column)


def countries_at(points: DataFrame, cells: DataFrame, localities: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, country): the codes of all countries that hold a point, sorted, with commas between; null where there is none."""
    found = candidates(_spots(points), cells, localities.withColumnRenamed("country", "code")).where("trim(code) <> ''")
    per = found.groupBy("latitude", "longitude").agg(F.array_join(F.sort_array(F.collect_set(F.upper(F.trim("code")))), ", ").alias("country"))
    return _of_spots(points, per, key, "country")


def smallest() -> Column:
    """The locality of least area, the smaller id among equals."""
    return F.min_by(_place(), F.struct("area", "locality_id"))


def _place() -> Column:
    return F.struct("locality_id", F.col("l_country").alias("country"), F.col("region").alias("subdivision"), "local_name", "english_name", "subtype", "admin_level", "area")


# fixed values: kinds of places below a town, the least area of a county that is like a city, and how much larger a county may be than a locality that it replaces
DETAIL = ("microhood", "neighborhood", "macrohood", "borough")
CITY_COUNTY, ENGLISH_TIMES, LOCAL_TIMES = 0.005, 4, (10, 40)


def _known(name: Column) -> Column:
    return F.coalesce(name != "", F.lit(False))


def resolve(points: DataFrame, cells: DataFrame, localities: DataFrame, mode: str = "smart", key: str = "file_id") -> DataFrame:
    """(key, place): the locality of each point, null where none holds it or coordinates are invalid.

    `smallest` takes the least area. `smart` starts from the largest locality with an English name, else the largest locality; only
    if that has no English name, a county of admin level 2 of at least four times its area with an English name, or of
    ten to forty times with another local name, may take its place, the smallest such one. Without a locality: the largest admin-2
    county if there is no region, its area is at least 0.005 or its name (three letters or more, without accents and case) is part of a
    region's; else the largest region. Without such a county: the smallest that is neither country, region nor below a town, else
    the largest region, else the smallest below a town. A country alone is no place. Among equal areas the smaller id counts.
    """
    if mode not in ("smart", "smallest"):
        raise ValueError(f"no such mode: {mode}")
    own = localities if mode == "smallest" else localities.withColumn("_names", F.when(F.col("subtype").isin("county", "region"), F.array(plain_name(F.col("local_name")), plain_name(F.col("english_name")))))
    found = candidates(_spots(points), cells, own.withColumnRenamed("country", "l_country"))
    if mode == "smallest":
        return _of_spots(points, found.groupBy("latitude", "longitude").agg(smallest().alias("place")), key, "place")
    kind = F.coalesce("subtype", F.lit(""))
    county = (kind == "county") & F.coalesce(F.col("admin_level") == 2, F.lit(False))
    local, region, detail = kind == "locality", kind == "region", kind.isin(*DETAIL)
    first = lambda cond, order, what=None: F.max_by(F.when(cond, _place() if what is None else what), F.when(cond, order))
    large, small = F.struct("area", -F.col("locality_id")), F.struct(-F.col("area"), -F.col("locality_id"))
    per = found.groupBy("latitude", "longitude").agg(
        first(local & _known(F.col("english_name")), large).alias("named"),
        first(local, large).alias("local"),
        F.collect_list(F.when(county, _place())).alias("counties"),
        first(county, large).alias("county"),
        first(county, large, F.col("_names")).alias("county_names"),
        first(region, large).alias("region"),
        F.flatten(F.collect_list(F.when(region, F.col("_names")))).alias("region_names"),
        first((kind != "country") & ~region & ~county & ~detail, small).alias("rest"),
        first(detail, small).alias("detail"),
    ).withColumn("base", F.coalesce("named", "local"))
    base = F.col("base")
    times = lambda p, n: p["area"] >= base["area"] * n
    other = lambda p: _known(p["local_name"]) & ~p["local_name"].eqNullSafe(base["local_name"])
    over = F.filter("counties", lambda p: (_known(p["english_name"]) & times(p, ENGLISH_TIMES)) | (other(p) & times(p, LOCAL_TIMES[0]) & (p["area"] <= base["area"] * LOCAL_TIMES[1])))
    over = F.array_sort(F.transform(over, lambda p: F.struct(p["area"].alias("a"), p["locality_id"].alias("i"), p.alias("p"))))
    replaced = F.when(~_known(base["english_name"]), F.get(over, F.lit(0))["p"])
    called = F.exists("county_names", lambda c: (F.length(c) >= 3) & F.exists("region_names", lambda r: F.contains(r, c)))
    as_county = F.when(F.col("region").isNull() | (F.col("county")["area"] >= CITY_COUNTY) | F.coalesce(called, F.lit(False)), F.col("county")).otherwise(F.col("region"))
    without = F.when(F.col("county").isNotNull(), as_county).otherwise(F.coalesce("rest", "region", "detail"))
    place = F.when(base.isNotNull(), F.coalesce(replaced, base)).otherwise(without)
    return _of_spots(points, per.select("latitude", "longitude", place.alias("place")), key, "place")


#: Cells on a side of a block, by which boxes meet the cells of points.
BLOCK = 16


def cells_of(localities: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(cell_id, locality_id): every grid cell that a locality's bounding box touches; with points only cells that hold one.

    A box of several degrees touches thousands of cells. With points it is laid on blocks of cells instead, which it meets
    the points' cells in.
    """
    x1, x2 = F.floor((F.col("min_lon") + 180) * 10), F.least(F.floor((F.col("max_lon") + 180) * 10), F.lit(3599))
    y1, y2 = F.floor((F.col("min_lat") + 90) * 10), F.least(F.floor((F.col("max_lat") + 90) * 10), F.lit(1799))
    if points is not None:
        of = lambda c: F.floor(c / BLOCK)
        asked = points.where(valid_coordinates()).select(grid_cell(F.col("latitude"), F.col("longitude")).alias("cell_id")).distinct()
        asked = asked.withColumns({"x": F.col("cell_id") % 3600, "y": F.floor(F.col("cell_id") / 3600)}).withColumns({"bx": of(F.col("x")), "by": of(F.col("y"))})
        boxes = localities.select(F.col("id").alias("locality_id"), x1.alias("x1"), x2.alias("x2"), y1.alias("y1"), y2.alias("y2"))
        boxes = boxes.select("*", F.explode(F.sequence(of(F.col("x1")), of(F.col("x2")))).alias("bx")).select("*", F.explode(F.sequence(of(F.col("y1")), of(F.col("y2")))).alias("by"))
        both = asked.join(boxes.hint("merge"), ["bx", "by"])
        return both.where(F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))).select("cell_id", "locality_id")
    x, y = F.sequence(x1, x2), F.sequence(y1, y2)
    return localities.select(F.col("id").alias("locality_id"), F.explode(x).alias("x"), y.alias("ys")).select("locality_id", "x", F.explode("ys").alias("y")).select((F.col("y") * 3600 + F.col("x")).alias("cell_id"), "locality_id")


def rollup(rows: DataFrame, keys: list[str], order: str = "count", min_count: int = 1, ids: bool = False) -> DataFrame:
    """(keys, n, last_visit, last_thumbnail) of rows (keys, create_date, file_type, thumbnail_path), ordered by `count`, `last_visit` or `alphabetical`.

    last_thumbnail is the newest image's thumbnail. With ids there is an array of each place's ids too, which is as long as
    the place is large; `lookups` and semi-joins on the keys do without it.
    """
    more = [F.array_sort(F.collect_list("id")).alias("ids")] if ids else []
    thumb = (F.col("file_type") == "image") & F.col("thumbnail_path").isNotNull()
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("create_date").alias("last_visit"), F.max_by(F.when(thumb, F.col("thumbnail_path")), F.when(thumb, F.struct(F.coalesce("create_date", F.lit(0)), "id"))).alias("last_thumbnail"), *more)
    out = out.where(F.col("n") >= min_count)
    by = {"count": [F.desc("n"), *keys], "last_visit": [F.col("last_visit").desc_nulls_last(), *keys], "alphabetical": [F.collate(F.col(keys[-1]), "UNICODE"), *keys]}
    return out.orderBy(*by[order])


def with_population(countries: DataFrame, population: DataFrame) -> DataFrame:
    """Countries by population of a code table (code, population), the largest first; unknown codes count as 0."""
    joined = countries.join(F.broadcast(population), F.col("country") == F.col("code"), "left")
    return joined.withColumn("population", F.coalesce("population", F.lit(0))).drop("code").orderBy(F.desc("population"), "country")


def subdivision_code(country: Column, subdivision: Column) -> Column:
    """`NL-NH` of NL and NH; a code with its country's prefix stays."""
    return F.when(F.startswith(subdivision, F.concat(country, F.lit("-"))), subdivision).otherwise(F.concat(country, F.lit("-"), subdivision))


def english_part(name: Column) -> Column:
    """The part in brackets of `name (English name)`, else the name."""
    inner = F.regexp_extract(name, r"\(([^)]+)\)\s*$", 1)
    return F.when(inner != "", inner).otherwise(name)


def _pixels(zoom: int) -> tuple[Column, Column]:
    """Where a file is on a Web Mercator map at a zoom."""
    lat = F.least(F.greatest(F.col("latitude"), F.lit(-85.05112878)), F.lit(85.05112878))
    world = 256 * 2**zoom
    rad = F.radians(lat)
    return (F.col("longitude") + 180) / 360 * world, (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / 3.141592653589793) / 2 * world


def map_grid(files: DataFrame, zoom: int, pixels: int = 90) -> DataFrame:
    """(x, y, n, latitude, longitude): files in cells of so many pixels of a Web Mercator map at a zoom."""
    px, py = _pixels(zoom)
    return files.where(valid_coordinates()).groupBy(F.floor(px / pixels).alias("x"), F.floor(py / pixels).alias("y")).agg(F.count("*").alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def map_pyramid(files: DataFrame, finest: int = 16, coarsest: int = 0, pixels: int = 90) -> DataFrame:
    """(zoom, x, y, n, latitude, longitude): the cells of `map_grid` for all zooms, from the finest upwards.

    Files are read once, for the finest cells; each cell then counts, with its sums, in the one above it of every zoom, so that
    counts agree on all levels. Levels are one aggregation over cells, of which there are no more than files.
    """
    px, py = _pixels(finest)
    cells = files.where(valid_coordinates()).groupBy(F.floor(px / pixels).alias("x"), F.floor(py / pixels).alias("y")).agg(F.count("*").alias("n"), F.sum("latitude").alias("a"), F.sum("longitude").alias("o"))
    every = cells.select("*", F.explode(F.sequence(F.lit(coarsest), F.lit(finest))).alias("zoom"))
    up = lambda c: F.expr(f"shiftright({c}, {finest} - zoom)").alias(c)
    levels = every.select("zoom", up("x"), up("y"), "n", "a", "o").groupBy("zoom", "x", "y").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("o").alias("o"))
    return levels.select("zoom", "x", "y", "n", (F.col("a") / F.col("n")).alias("latitude"), (F.col("o") / F.col("n")).alias("longitude"))
