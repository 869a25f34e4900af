"""Sessions, islands and routes over ordered events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prismlake.functions.columns import capture_ts, countries, haversine, to_epoch
from prismlake.sources.tables import cut


def even_runs(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `_run`, which grows with the order (nulls first), in runs of about equal size.

    A range sort by the whole order cuts the rows, so a day or a second that holds a third of them is spread over many
    runs as long as the last column of the order tells its rows apart. The sorted rows are written, as runs must not change afterwards.
    """
    return cut(rows.sort(*order).withColumn("_run", F.spark_partition_id()))


def carried(rows: DataFrame, order: list[str], columns: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """rows with the value that each column had in the row before, without one task that sees all rows.

    Rows are cut into runs of `bucket` (which grows with the order), or of equal size without it; within a run the previous row is
    found by a window, and the first row of a run takes what the last row of an earlier run had, from a
    table with one row for each run.
    """
    own = W.partitionBy("_run").orderBy(*order)
    out = even_runs(rows, order) if bucket is None else rows.withColumn("_run", bucket)
    for name, value in columns.items():
        out = out.withColumn(f"_v_{name}", value)
    named = F.struct(*[F.col(f"_v_{n}").alias(n) for n in columns])
    out = out.withColumn("_lag", F.lag(named).over(own)).withColumn("_first", F.row_number().over(own) == 1)
    last = out.groupBy("_run").agg(F.max_by(named, F.struct(*order)).alias("_last"))
    ends = last.withColumn("_prev", F.lag("_last").over(W.orderBy("_run"))).select("_run", "_prev")
    out = out.join(ends, "_run", "left").withColumn("_before", F.when(F.col("_first"), F.col("_prev")).otherwise(F.col("_lag")))
    for name in columns:
        out = out.withColumn(f"prev_{name}", F.col(f"_before.{name}")).drop(f"_v_{name}")
    return out.drop("_lag", "_first", "_prev", "_before")


def running(rows: DataFrame, order: list[str], flag: Column, out: str) -> DataFrame:
    """Running number of flagged rows; rows has `_run` from `carried`. Sums of runs come from one row for each run."""
    own = W.partitionBy("_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_flag", flag.cast("int"))
    sums = rows.groupBy("_run").agg(F.sum("_flag").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_base", before).drop("_s")
    return rows.withColumn("_own", F.sum("_flag").over(own)).join(starts, "_run").withColumn(out, F.col("_own") + F.col("_base")).drop("_flag", "_own", "_base")


def gap_sessions(events: DataFrame, time: str, gap_seconds: float, tie: str, run_seconds: int | None = None) -> DataFrame:
    """events with `session`, numbered from 1: a new one begins more than the gap after the event before. time is epoch seconds.

    Runs are of equal size, or of so many seconds, which saves writing the sorted events where no such span is crowded.
    """
    order = [time, tie]
    rows = carried(events.where(F.col(time).isNotNull()), order, {"t": F.col(time)}, None if run_seconds is None else F.floor(F.col(time) / run_seconds))
    new = F.col("prev_t").isNull() | ((F.col(time) - F.col("prev_t")) > gap_seconds)
    return running(rows, order, new, "session").drop("_run", "prev_t")


@dataclass(frozen=True)
class TripOptions:
    max_gap_days: float = 4
    min_items: int = 500
    main_share: float = 0.2
    total_share: float = 0.5


def home_country(files: DataFrame) -> DataFrame:
    """(country): the most frequent country string as a whole; ties go to the first by name."""
    return files.where("country IS NOT NULL AND country <> ''").groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(1).select("country")


def trips(files: DataFrame, options: TripOptions = TripOptions(), zone: str = "UTC", run_seconds: int | None = None) -> DataFrame:
    """Trips abroad: sessions of files whose country string isn't home's, with enough files in few main countries.

    (trip_id, first_ts, last_ts, n, main_countries, title), latest first.
    """
    away = files.where("country IS NOT NULL AND country <> ''").join(F.broadcast(home_country(files)), "country", "left_anti")
    timed = away.select("id", capture_ts(zone).alias("ts"), F.array_distinct(countries()).alias("codes")).withColumn("epoch", to_epoch("ts")).where("epoch IS NOT NULL")
    gap = F.lit(options.max_gap_days * 86400)
    # stretches without a gap within a run, with their counts by country: small, and the only thing that outlives one pass over files
    own = W.partitionBy("run").orderBy("epoch", "id")
    broken = F.coalesce((F.col("epoch") - F.lag("epoch").over(own)) > gap, F.lit(True))
    runs = even_runs(timed, ["epoch", "id"]).withColumnRenamed("_run", "run") if run_seconds is None else timed.withColumn("run", F.floor(F.col("epoch") / run_seconds))
    rows = runs.withColumn("broken", broken.cast("int"))
    rows = rows.withColumn("part", F.sum("broken").over(own.rowsBetween(W.unboundedPreceding, 0)))
    one = rows.select("run", "part", "ts", "epoch", F.explode(F.array_append("codes", F.lit("").cast("string"))).alias("code"))
    per = one.groupBy("run", "part", "code").agg(F.count("*").alias("c"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("epoch").alias("a"), F.max("epoch").alias("b"))
    every = F.col("code") == ""
    pick = lambda c: F.max(F.when(every, F.col(c))).alias(c)
    parts = per.groupBy("run", "part").agg(*map(pick, ("c", "first_ts", "last_ts", "a", "b")), F.collect_list(F.when(~every, F.struct("code", "c"))).alias("codes"))
    order = W.orderBy("run", "part")  # stretches are at least a gap or a run apart
    new = F.coalesce((F.col("a") - F.lag("b").over(order)) > gap, F.lit(True)).cast("int")
    parts = parts.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    over = W.partitionBy("session")
    parts = parts.select("session", "codes", F.min("first_ts").over(over).alias("first_ts"), F.max("last_ts").over(over).alias("last_ts"), F.sum("c").over(over).alias("n"))
    parts = parts.where(F.col("n") >= options.min_items)
    ends = ["session", "first_ts", "last_ts", "n"]
    shares = parts.select(*ends, F.explode("codes").alias("k")).groupBy(*ends, "k.code").agg(F.sum("k.c").alias("c"))
    shares = shares.withColumn("share", F.col("c") / F.col("n")).where(F.col("share") >= options.main_share)
    main = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "code")))
    out = shares.groupBy(*ends).agg(F.transform(main, lambda x: x["code"]).alias("main_countries"), F.sum("share").alias("share")).where(F.col("share") >= options.total_share)
    label = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    title = F.concat(F.array_join("main_countries", " – "), F.lit(" "), F.year("first_ts").cast("string"))
    return out.select(F.concat_ws("-", label("first_ts"), label("last_ts")).alias("trip_id"), "first_ts", "last_ts", "n", "main_countries", title.alias("title")).orderBy(F.desc("first_ts"))


def visits(rows: DataFrame, places: Column, order: list[str], run: Column | None = None) -> DataFrame:
    """(place, segment, n, first, last): stretches of consecutive rows at a place.

    A place goes on if the row just before had it too; rows at several places keep several stretches
    open. run is a value that grows with the order and cuts rows into parts for the tasks; without it parts are of equal size.
    """
    here = F.array_distinct(places)
    before = carried(rows, order, {"places": here}, run)
    one = before.withColumn("place", F.explode(here))
    fresh = F.coalesce(~F.array_contains("prev_places", F.col("place")), F.lit(True))
    own = W.partitionBy("place", "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    one = one.withColumn("_new", fresh.cast("int"))
    sums = one.groupBy("place", "_run").agg(F.sum("_new").alias("_s"))
    base = F.coalesce(F.sum("_s").over(W.partitionBy("place").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("_o", F.sum("_new").over(own)).join(sums.withColumn("_b", base).drop("_s"), ["place", "_run"])
    one = one.withColumn("segment", F.col("_o") + F.col("_b"))
    return one.groupBy("place", "segment").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))


def merge_adjacent(segments: DataFrame, label: list[str], order: str, run: Column | None = None) -> DataFrame:
    """Neighbouring segments of equal label as one: (label, stretch, n, segments, last_visit).

    run is a value that grows with the order and cuts segments into parts for the tasks; a part's numbers go on
    from one row for each earlier part. Without it all segments are one part, which suits short lists.
    """
    rows = segments.withColumn("_run", run if run is not None else F.lit(0))

    def numbered(keys: list[str]) -> tuple[Column, DataFrame]:
        own = F.row_number().over(W.partitionBy(*keys, "_run").orderBy(order))
        before = W.partitionBy(*keys) if keys else W.partitionBy()
        counts = rows.groupBy(*keys, "_run").agg(F.count("*").alias("_c"))
        base = F.coalesce(F.sum("_c").over(before.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return own, counts.withColumn(f"_b{len(keys)}", base).drop("_c")

    (a, all_), (b, same) = numbered([]), numbered(label)
    rows = rows.withColumn("_a", a).withColumn("_b", b).join(all_, "_run").join(same, [*label, "_run"])
    rows = rows.withColumn("stretch", (F.col("_a") + F.col("_b0") - F.col("_b") - F.col(f"_b{len(label)}")).cast("int"))
    return rows.groupBy(*label, "stretch").agg(F.sum("n").alias("n"), F.count("*").alias("segments"), F.max("last_visit").alias("last_visit"))


def route_lines(files: DataFrame, max_altitude: float = 1500, max_km: float = 200, run: Column | None = None) -> DataFrame:
    """(line, id, latitude, longitude): points of routes, in order of id.

    Rows without country, without altitude or above max_altitude are skipped; a line breaks where the next
    kept point is over max_km away; lines of one point are left out.
    """
    kept = files.where("country IS NOT NULL AND country <> '' AND latitude IS NOT NULL AND longitude IS NOT NULL").where(F.col("altitude") <= max_altitude).select("id", "latitude", "longitude")
    rows = carried(kept, ["id"], {"lat": F.col("latitude"), "lon": F.col("longitude")}, F.floor(F.col("id") / 65_536) if run is None else run)
    far = haversine(F.col("prev_lat"), F.col("prev_lon"), F.col("latitude"), F.col("longitude")) > max_km
    rows = running(rows, ["id"], F.col("prev_lat").isNull() | far, "line")
    long = rows.groupBy("line").agg(F.count("*").alias("_n")).where("_n > 1").select("line")
    return rows.join(long, "line").select("line", "id", "latitude", "longitude")
