"""Single items, overviews and the map: what a view asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismlake.functions.columns import countries, display_name
from prismlake.operators.filters import FilterSpec, ViewOptions, apply_filters
from prismlake.operators.sessions import route_lines, visits

#: Columns that each view of the map reads.
MAP_COLUMNS = {
    "cluster": ["latitude", "longitude", "altitude", "country", "create_date", "filename", "device_model", "media_id", "id", "thumbnail_path"],
    "line": ["latitude", "longitude", "altitude", "country", "create_date", "id"],
    "countries": ["latitude", "longitude", "country", "id"],
    "heatmap": ["latitude", "longitude"],
}


def item(files: DataFrame, id: int) -> DataFrame:
    return files.where(F.col("id") == id)


def overview(files: DataFrame) -> DataFrame:
    """(id, thumbnail_path) of shown files, greatest number first."""
    return files.select("id", "thumbnail_path", "media_id").orderBy(F.desc("media_id"), F.desc("id")).select("id", "thumbnail_path")


def located_files(locations: DataFrame, ids: DataFrame | None = None, prefer: str = "english") -> DataFrame:
    """Places of files (ids: id), or of all; city is the name as preferred."""
    rows = locations if ids is None else locations.join(ids.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_semi")
    return rows.select("file_id", "country", "subdivision", display_name(prefer == "english").alias("city"), "local_name", "english_name", "subtype", "admin_level", "area")


def has_row(rows: DataFrame, file: int, key: str = "file_id") -> DataFrame:
    """(found): whether a derived table, such as embeddings, has a row for a file."""
    return rows.where(F.col(key) == file).agg((F.count("*") > 0).alias("found"))


def processed(scans: DataFrame, file: int, version: str) -> DataFrame:
    """(processed): whether a file's scan is complete in the current version."""
    done = scans.where((F.col("file_id") == file) & (F.col("pipeline_version") == version) & (F.col("status") == "completed"))
    return done.agg((F.count("*") > 0).alias("processed"))


def on_map(files: DataFrame, spec: FilterSpec, options: ViewOptions = ViewOptions()) -> DataFrame:
    """Shown files with coordinates."""
    return apply_filters(files, spec, options).where("latitude IS NOT NULL AND longitude IS NOT NULL")


def map_shown(files: DataFrame, spec: FilterSpec, options: ViewOptions = ViewOptions()) -> DataFrame:
    """(filtered, total): files on the map, and those that would be on it without filters but for hidden folders."""
    all_ = ViewOptions(allow_undated=True, hidden_folders=options.hidden_folders)
    shown = on_map(files, spec, options).agg(F.count("*").alias("filtered"))
    return shown.crossJoin(F.broadcast(on_map(files, FilterSpec(), all_).agg(F.count("*").alias("total"))))  # one row each


def map_view(files: DataFrame, view: str = "cluster", spec: FilterSpec = FilterSpec(), options: ViewOptions = ViewOptions()) -> DataFrame:
    """What a view of the map draws.

    cluster: (lat, lng, popup); line: (line, id, latitude, longitude); heatmap: (latitude, longitude);
    countries: (country, latitude, longitude), one row for each of a file's countries, whose counts are `stats.map_counts`.
    """
    rows = on_map(files, spec, options).select(*MAP_COLUMNS.get(view, MAP_COLUMNS["heatmap"]))
    if view == "cluster":
        popup = F.struct("filename", F.col("create_date").alias("date"), F.col("device_model").alias("device"), "country", "altitude", F.col("id").alias("item_id"), F.col("media_id").alias("id"), "thumbnail_path")
        return rows.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), popup.alias("popup"))
    if view == "line":
        return route_lines(rows)
    if view == "countries":
        return rows.select(F.explode(countries()).alias("country"), "latitude", "longitude")
    return rows


def place_visit_files(rows: DataFrame, places, segment: int, place, order: list[str], run) -> DataFrame:
    """(id) of the files of one stretch of visits to a place; see `sessions.visits` for rows, places, order and run."""
    found = visits(rows, places, order, run).where((F.col("place") == place) & (F.col("segment") == segment))
    span = found.select(*[F.col(f"first.{c}").alias(f"_a{i}") for i, c in enumerate(order)], *[F.col(f"last.{c}").alias(f"_b{i}") for i, c in enumerate(order)])
    at = F.struct(*order)
    low, high = (F.struct(*[F.col(f"_{x}{i}").alias(c) for i, c in enumerate(order)]) for x in "ab")
    inside = rows.crossJoin(F.broadcast(span)).where((at >= low) & (at <= high))  # one row of span
    return inside.where(F.array_contains(places, place)).select("id").distinct()


def memory_cards(custom: DataFrame, years: DataFrame, months: DataFrame, trips: DataFrame) -> DataFrame:
    """(kind, key, at) of cards of all kinds, newest first: memories (id, created), years (year), months (year, month) and trips (trip_id, last_ts).

    A year stands at its last second, a month at its last, a trip at its end.
    """
    second = lambda c: F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), c)
    end = lambda y, m: second(F.make_timestamp_ntz(y, m, F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    one = custom.select(F.lit("custom").alias("kind"), F.col("id").cast("string").alias("key"), F.col("created").cast("long").alias("at"))
    two = years.select(F.lit("year"), F.col("year").cast("string"), end(F.col("year") + 1, F.lit(1)) - 1)
    three = months.select(F.lit("month"), F.format_string("%04d-%02d", "year", "month"), end(F.col("year") + F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1) - 1)
    four = trips.select(F.lit("trip"), "trip_id", second(F.col("last_ts").cast("timestamp_ntz")))
    return one.union(two).union(three).union(four).orderBy(F.col("at").desc_nulls_last(), "kind", "key")
