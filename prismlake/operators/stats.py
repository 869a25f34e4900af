"""Counts, timelines, facets, streaks and milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prismlake.functions.columns import age_on, aspect_distance, capture_date, capture_ts, countries, dated, thumbnail_score, to_epoch
from prismlake.operators.filters import milestone_capture
from prismlake.operators.ordering import top_per_group

WEEK = 7 * 86400


def thumbnail_order() -> list[Column]:
    """Best pictures first: most is known, pleasant shape, most pixels; the id breaks ties."""
    return [thumbnail_score().desc(), aspect_distance().asc_nulls_first(), F.col("megapixels").desc_nulls_last(), F.col("id")]


def by_year(files: DataFrame, zone: str = "UTC") -> DataFrame:
    return files.groupBy(F.year(capture_date(zone)).alias("year")).agg(F.count("*").alias("n")).where("year IS NOT NULL")


def by_month(files: DataFrame, zone: str = "UTC") -> DataFrame:
    day = capture_date(zone)
    return files.groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg(F.count("*").alias("n")).where("year IS NOT NULL")


def best_of(files: DataFrame, group: dict[str, Column], n: int = 20) -> DataFrame:
    """The n best images of each group. Only images dated by capture qualify, though counts take all."""
    shown = files.where((F.col("file_type") == "image") & (F.col("create_date_local").isNotNull() | F.col("create_date").isNotNull()))
    return top_per_group(shown.withColumns(group), list(group), thumbnail_order(), n)


def on_this_day(files: DataFrame, today: str, zone: str = "UTC") -> DataFrame:
    """(year, n) of files of the same month and day in earlier years."""
    day = capture_date(zone)
    same = (F.date_format(day, "MM-dd") == today[5:10]) & (F.year(day) < int(today[:4]))
    return files.where(same).groupBy(F.year(day).alias("year")).agg(F.count("*").alias("n"))


def by_value(files: DataFrame, column: str) -> DataFrame:
    return files.groupBy(F.coalesce(F.col(column), F.lit("Unknown")).alias("value")).agg(F.count("*").alias("n"))


def by_country(files: DataFrame) -> DataFrame:
    """A file in several countries counts in each."""
    return files.select(F.explode(countries()).alias("country")).groupBy("country").agg(F.count("*").alias("n"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def spans(files: DataFrame, column: str, zone: str = "UTC") -> DataFrame:
    """First day, last day and number of files of each value of a column."""
    day = capture_date(zone)
    return files.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


def by_age(files: DataFrame, birth: str, zone: str = "UTC") -> DataFrame:
    day = capture_date(zone)
    days = files.where(day.isNotNull()).groupBy(day.alias("day")).agg(F.count("*").alias("c"))
    return days.groupBy(age_on(F.col("day"), birth).alias("age")).agg(F.sum("c").alias("n"))


def by_day(files: DataFrame, zone: str = "UTC") -> DataFrame:
    return files.groupBy(capture_date(zone).alias("day")).agg(F.count("*").alias("n")).where("day IS NOT NULL")


def top_days(files: DataFrame, n: int = 10, zone: str = "UTC") -> DataFrame:
    return by_day(files, zone).orderBy(F.desc("n"), "day").limit(n)


def year_heat(files: DataFrame, year: int, zone: str = "UTC") -> DataFrame:
    """Least and greatest daily count of one year."""
    return by_day(files, zone).where(F.year("day") == year).agg(F.min("n").alias("least"), F.max("n").alias("most"))


def facets(files: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): distinct non-blank values of each column, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns]))
    return files.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL AND trim(value) <> ''").distinct()


def year_range(files: DataFrame, zone: str = "UTC") -> DataFrame:
    """(year): every year from the last capture down to the first. Files without a capture date don't count."""
    day = F.coalesce(F.col("create_date_local"), F.when(F.col("create_date").isNotNull(), capture_ts(zone)))
    ends = files.agg(F.year(F.min(day)).alias("a"), F.year(F.max(day)).alias("b"))
    return ends.where("a IS NOT NULL").select(F.explode(F.sequence("b", "a")).alias("year"))


def age_range(files: DataFrame, birth: str, zone: str = "UTC") -> DataFrame:
    """(age): every age from the first capture to the last. Files without a capture date don't count."""
    day = F.coalesce(F.col("create_date_local"), F.when(F.col("create_date").isNotNull(), capture_ts(zone))).cast("date")
    ends = files.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence(age_on(F.col("a"), birth), age_on(F.col("b"), birth))).alias("age"))


def chart_order(values: DataFrame, numeric: bool = False) -> DataFrame:
    """Rows (value, n) for a chart: in the order of numbers, or most first; `Unknown` is last."""
    unknown = (F.col("value") == "Unknown").cast("int")
    return values.orderBy(unknown, *([F.col("value").try_cast("double").asc_nulls_last()] if numeric else [F.desc("n")]), "value")


def map_counts(files: DataFrame) -> DataFrame:
    """(country, n) over files with coordinates."""
    return by_country(files.where("latitude IS NOT NULL AND longitude IS NOT NULL"))


def timeline_prefix(months: DataFrame) -> DataFrame:
    """Months, newest first, with the number of files before each. months has a row for each month only."""
    order = W.orderBy(F.desc("year"), F.desc("month")).rowsBetween(W.unboundedPreceding, -1)
    return months.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def streaks(days: DataFrame) -> DataFrame:
    """(first_day, last_day, length) of runs of consecutive days, longest first. days has a row for each day only."""
    island = F.date_sub("day", F.row_number().over(W.orderBy("day")))
    runs = days.select("day").distinct().withColumn("island", island)
    return runs.groupBy("island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("length")).drop("island").orderBy(F.desc("length"), "first_day")


# fixed values: the first milestones
FIRST_STEPS = [1_000, 10_000, 25_000, 50_000, 75_000, 100_000, 150_000]


def ladder(n: int, ahead: int = 8) -> list[int]:
    """Milestones: the fixed first ones, then every 50,000 to a million and every 100,000 to three times n, at least to two million and so far that `ahead` lie above n."""
    return [*FIRST_STEPS, *range(200_000, 1_000_001, 50_000), *range(1_100_000, max(3 * n, 2_000_000, n + ahead * 100_000) + 1, 100_000)]


def milestones(files: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """(milestone, id): the file at which the count reached each step, in order of media_id.

    Counting ranks through blocks: files are counted by block of media_id, and only blocks that hold a
    step are numbered, so no task sorts all files.
    """
    spark = files.sparkSession
    rows = files.select("id", "media_id").where("media_id IS NOT NULL")
    width = 1 << 16
    block = F.floor(F.col("media_id") / width)
    counts = rows.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before)  # one row for 65,536 ids
    total = rows.count()
    wanted = spark.createDataFrame([(m,) for m in (steps or ladder(total)) if m <= total], "milestone long")
    # each step lies in the last block with fewer files before it: one sorted pass over blocks and steps
    null = F.lit(None).cast("long")
    both = starts.select(F.col("before").alias("at"), F.struct("block", "before").alias("s"), null.alias("milestone"))
    both = both.union(wanted.select((F.col("milestone") - 1).alias("at"), F.struct(null.alias("block"), null.alias("before")).alias("s"), "milestone"))
    last = F.last(F.when(F.col("milestone").isNull(), F.col("s")), True).over(W.orderBy("at", F.col("milestone").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    hit = both.withColumn("s", last).where("milestone IS NOT NULL").select("s.block", "s.before", "milestone")
    some = rows.withColumn("block", block).join(hit.select("block", "before").distinct(), "block")
    place = F.col("before") + F.row_number().over(W.partitionBy("block").orderBy("media_id", "id"))
    return some.select("block", "id", place.alias("milestone")).join(hit, ["block", "milestone"]).select("milestone", "id")


def weekly(times: DataFrame, now: int) -> DataFrame:
    """(week, n): events in each seven days since 1970, with empty weeks, from the first to now or the last, if that is later. times has `epoch`."""
    seen = times.where(F.col("epoch").isNotNull()).groupBy(F.floor(F.col("epoch") / WEEK).alias("week")).agg(F.count("*").alias("n"))
    ends = seen.agg(F.min("week").alias("a"), F.max("week").alias("b"))
    every = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", F.greatest(F.lit(now // WEEK).cast("bigint"), "b"))).alias("week"))
    return every.join(seen, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))


def growth(weeks: DataFrame, alpha: float = 0.2, cap: float = 3.0) -> DataFrame:
    """(weekly, daily): exponentially weighted mean of weekly counts, each week capped at a multiple of the mean so far.

    weeks has a row for each week, so the ordered fold is over a short list. daily is null under 0.02.
    """
    counts = F.transform(F.array_sort(F.collect_list(F.struct("week", "n"))), lambda x: x["n"].cast("double"))
    fold = lambda m, x: F.when(m.isNull(), x).otherwise(m * (1 - alpha) + alpha * F.when(m > 0, F.least(x, m * cap)).otherwise(x))
    mean = weeks.agg(F.aggregate(counts, F.lit(None).cast("double"), fold).alias("weekly"))
    return mean.withColumn("daily", F.when(F.col("weekly") / 7 >= 0.02, F.col("weekly") / 7))


def upcoming(n: int, daily: float | None, now: int, many: int = 8) -> list[tuple[int, int | None]]:
    """The next milestones and the epoch second at which growth reaches each."""
    return [(m, None if not daily else int(now + (m - n) / daily * 86400)) for m in ladder(n, many) if m > n][:many]


def milestone_report(files: DataFrame, now: int, skip_screens: bool = False, ahead: int = 8, zone: str = "UTC", steps: list[int] | None = None) -> DataFrame:
    """(milestone, base, reached, id, ts, predicted): milestones behind, with the file that reached each, and the next ones with the second at which growth reaches them.

    base is the greatest media_id, and a milestone's file the one that has it as media_id (none, if it is gone; of several the least id). With
    `skip_screens` only camera files and those of unknown kind count: base is their number, a milestone's file is the one at that place by media_id
    (files without one have no place). Milestones are those of `ladder` for base, or the given steps. predicted is null where growth is under 0.02 files a day or fewer than two files are dated. No rows where base is 0.
    """
    own = files.where(milestone_capture()) if skip_screens else files
    size = F.count("*") if skip_screens else F.coalesce(F.max("media_id"), F.lit(0)).cast("bigint")
    known = own.agg(size.alias("base"), F.count_if(dated()).alias("dated")).where("base > 0")
    longs = lambda *x: [F.lit(v).cast("bigint") for v in x]
    middle = F.sequence(*longs(200_000, 1_000_000, 50_000))
    high = F.sequence(*longs(1_100_000), F.greatest(3 * F.col("base"), *longs(2_000_000), F.col("base") + ahead * 100_000), *longs(100_000))
    every = F.concat(F.array(*longs(*FIRST_STEPS)), middle, high) if steps is None else F.array(*longs(*steps))
    rungs = known.select("base", "dated", F.explode(every).alias("milestone"))
    behind = rungs.where("milestone <= base").select("milestone", "base")
    dates = own.select("id", "media_id", capture_ts(zone).alias("ts"))
    if skip_screens:
        item = milestones(own, steps).join(dates.drop("media_id"), "id").select("milestone", "id", "ts")
    else:
        at = dates.join(behind.select(F.col("milestone").alias("media_id")), "media_id")
        item = at.groupBy(F.col("media_id").alias("milestone")).agg(F.min("id").alias("id"), F.min_by("ts", "id").alias("ts"))
    behind = behind.join(item, "milestone", "left").select("milestone", "base", F.lit(True).alias("reached"), "id", "ts", F.lit(None).cast("bigint").alias("predicted"))
    daily = growth(weekly(dates.select(to_epoch("ts").alias("epoch")), now)).select("daily")
    days = (F.col("milestone") - F.col("base")) / F.when(F.col("dated") > 1, F.col("daily"))
    coming = rungs.where("milestone > base").orderBy("milestone").limit(ahead).crossJoin(F.broadcast(daily))  # one row
    none = F.lit(None)
    coming = coming.select("milestone", "base", F.lit(False).alias("reached"), none.cast("bigint").alias("id"), none.cast("timestamp_ntz").alias("ts"), F.floor(now + days * 86400).alias("predicted"))
    return behind.unionByName(coming)


def progress(total: DataFrame, done: DataFrame, key: str = "id", done_key: str = "file_id", version: str | None = None) -> DataFrame:
    """(total, done, percent): rows of total with a row of done, of the current version if one is given."""
    from prismlake.functions.columns import percent

    ready = done if version is None else done.where(F.col("model_version") == version)
    both = total.select(key).join(ready.select(F.col(done_key).alias(key), F.lit(1).alias("hit")).distinct(), key, "left")
    return both.agg(F.count("*").alias("total"), F.count("hit").alias("done")).withColumn("percent", percent(F.col("done"), F.col("total")))


def storage(listing: DataFrame, features: dict[str, str]) -> DataFrame:
    """(feature, files, bytes) of a listing (path, length): each path belongs to the first feature whose pattern it matches."""
    name = F.lit("other")
    for feature, pattern in reversed(features.items()):
        name = F.when(F.col("path").rlike(pattern), feature).otherwise(name)
    return listing.groupBy(name.alias("feature")).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
