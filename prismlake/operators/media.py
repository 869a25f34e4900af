"""From files on disk to rows of the index: metadata, capture kind, numbering, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prismlake.functions.columns import filename_datetime, least2
from prismlake.operators.sessions import even_runs

# Endings by kind.
IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif", "avif", "dng", "cr2", "nef", "arw")
VIDEOS = ("mp4", "mov", "avi", "mkv", "webm", "m4v", "3gp", "mts")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_type(path: Column) -> Column:
    return F.when(extension(path).isin(*IMAGES), "image").when(extension(path).isin(*VIDEOS), "video").otherwise("other")


def capture_dates(rows: DataFrame) -> DataFrame:
    """create_date_local and create_date from raw tags, by priority.

    Original time, then creation date, then a time in the file's name are local; a plain create date is
    UTC and leaves the local time null. rows: path, date_time_original, creation_date, create_date_raw, all strings.
    """
    parse = lambda c: F.coalesce(*[F.try_to_timestamp(F.substring(c, 1, 19), F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")]).cast("timestamp_ntz")
    local = F.coalesce(parse(F.col("date_time_original")), parse(F.col("creation_date")), parse(filename_datetime("path")))
    utc = parse(F.col("create_date_raw"))
    epoch = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.coalesce(local, utc))
    return rows.withColumn("create_date_local", local).withColumn("create_date", epoch)


# What speaks for a camera or a screen, and by how many points.
RECORDING_NAMES = ("screen recording", "screenrecording", "screen recorder", "screenrecorder", "screen capture", "screencast")
PHOTO_FORMATS = ("heic", "heif", "jpg", "jpeg", "dng", "raw")
IMAGE_SIGNALS = ("camera_make", "camera_model", "lens_model", "focal_length", "focal_length_35mm", "aperture", "exposure_time", "iso", "flash")
VIDEO_SIGNALS = ("camera_make", "camera_model", "device_model", "lens_model", "focal_length", "focal_length_35mm", "aperture", "latitude", "longitude", "flash")
SOURCE, FORMAT, SOFTWARE, MIXED, CAMERA_SOURCE, PHOTO, TAGS = 5, 5, 5, 1, 2, 2, 4
SHOT_SOFTWARE = r"screenshot|snipping tool"
RECORD_SOFTWARE = r"screen recording|screen recorder|screenrecord"


def reclassified(files: DataFrame) -> DataFrame:
    """files with capture_type anew: `screenshot`, `screen_recording`, `camera` or `unknown`; tags that aren't among the columns are unknown.

    Path, format, software and tags give points for a screen and for a camera; more for the screen make a
    screenshot or recording, else two for the camera make a camera. A folder for both camera and
    screenshots is a weak sign only. The path is read once: its form and the points are columns of their own before they are used.
    """
    columns, video, image = files.columns, F.col("file_type") == "video", F.col("file_type") == "image"
    place = F.coalesce(F.col("path"), F.lit(""))
    source = F.regexp_replace(F.lower(F.concat(place, F.lit(" "), F.regexp_replace(place, r"(?s)^.*[/\\]", ""))), r"[\\/_&-]+", " ")
    rows = files.withColumns({"_source": source, "_end": extension(place)})
    source, end = F.col("_source"), F.col("_end")
    points = lambda n, c: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    of_screen = source.rlike("|".join(RECORDING_NAMES)) | (image & F.contains(source, F.lit("screenshot")))
    mixed = source.rlike(r"\bcamera\s+(and\s+)?screenshots?\b")
    screen = F.when(F.coalesce(of_screen, F.lit(False)), F.when(mixed, MIXED).otherwise(SOURCE)).otherwise(0) + points(FORMAT, image & (end == "png"))
    camera = points(CAMERA_SOURCE, source.rlike(r"\b(dcim|camera)\b")) + points(PHOTO, image & end.isin(*PHOTO_FORMATS))
    known = lambda names: sum(points(1, F.col(c).cast("string") != "") for c in names if c in columns) + F.lit(0)
    if "software" in columns:
        by = F.lower("software")
        screen = screen + points(SOFTWARE, F.when(video, by.rlike(RECORD_SOFTWARE)).otherwise(by.rlike(SHOT_SOFTWARE)))
    rows = rows.withColumns({"_screen": screen, "_camera": camera, "_tags": F.when(video, known(VIDEO_SIGNALS)).otherwise(known(IMAGE_SIGNALS))})
    rows = rows.withColumn("_camera", F.col("_camera") + F.when(F.col("_tags") >= 2, TAGS).otherwise(F.col("_tags")))
    kind = F.when(F.col("_screen") > F.col("_camera"), F.when(video, "screen_recording").otherwise("screenshot")).when(F.col("_camera") >= 2, "camera").otherwise("unknown")
    return rows.withColumn("capture_type", F.when(video | image, kind).otherwise("unknown")).drop("_source", "_end", "_screen", "_camera", "_tags")


def capture_counts(files: DataFrame) -> DataFrame:
    kinds = ("camera", "screenshot", "screen_recording", "unknown")
    return files.agg(*[F.count_if(F.col("capture_type") == k).alias(k) for k in kinds])


def renumbered(files: DataFrame) -> DataFrame:
    """(id, media_id): numbers from 1 without gaps by capture time (unknown first), then id.

    Rows are numbered within runs of a range sort, after the rows of earlier runs, so no task sorts them all, however
    many share a day or have no time.
    """
    rows = even_runs(files.select(F.coalesce(F.col("create_date"), least2("created", "modified")).alias("at"), "id"), ["at", "id"])
    counts = rows.groupBy("_run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("_run").orderBy("at", "id"))
    return rows.withColumn("own", own).join(counts.withColumn("before", before).drop("n"), "_run").select("id", (F.col("before") + F.col("own")).alias("media_id"))


def next_number(files: DataFrame, column: str = "media_id") -> DataFrame:
    return files.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next"))


def pending_paths(listing: DataFrame, files: DataFrame, removed: DataFrame) -> DataFrame:
    """Listed paths that are neither indexed nor removed by the user."""
    return listing.join(files.select("path").union(removed.select("path")), "path", "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: Column | str) -> DataFrame:
    """old and new with one row for each key: the one of greatest version, new before old among equals."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    v = F.col(version) if isinstance(version, str) else version
    turn = F.row_number().over(W.partitionBy(*key).orderBy(v.desc_nulls_last(), F.desc("_new"), *[F.col(c) for c in sorted(set(old.columns) - set(key))]))
    return both.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_new")


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new whose key it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


#: Columns that a partial refresh replaces, by group.
GROUPS = {
    "dates": ("create_date", "create_date_local", "offset_time_original"),
    "camera": ("camera_make", "camera_model", "device_model", "lens_model", "software"),
    "exposure": ("iso", "exposure_time", "aperture", "focal_length", "focal_length_35mm", "flash", "color_space"),
    "place": ("latitude", "longitude", "altitude", "country"),
    "image": ("width", "height", "orientation", "megapixels"),
}


def refreshed(files: DataFrame, fresh: DataFrame, groups: list[str]) -> DataFrame:
    """files with the columns of the named groups from fresh, by id; files that fresh lacks stay as they are."""
    changed = [c for g in groups for c in GROUPS[g] if c in files.columns and c in fresh.columns]
    new = fresh.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changed])
    both = files.join(new, "id", "left")
    return both.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in files.columns])


def quality_of_face(score: Column, side: Column, landmarks: Column) -> Column:
    """A face's worth for recognition: detection, size up to 140 pixels and landmarks."""
    return score * F.least(F.lit(1.0), side / 140.0) * landmarks


def ocr_summary(words: DataFrame) -> DataFrame:
    """(file_id, text, mean_confidence, box_count) of recognised words (file_id, position, text, confidence); words of one sign or less are dropped."""
    kept = words.where(F.length(F.trim("text")) > 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    return kept.groupBy("file_id").agg(F.array_join(ordered, "\n").alias("text"), F.avg("confidence").alias("mean_confidence"), F.count("*").alias("box_count"))


def stale_thumbnails(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed thumbnails (path) that no file refers to."""
    return listing.join(files.where("thumbnail_path IS NOT NULL").select(F.col("thumbnail_path").alias("path")), "path", "left_anti")


def face_is_usable(side: Column, quality: Column) -> Column:
    """Whether a detected face is good enough for recognition."""
    # fixed values
    return F.coalesce((side >= 48) & (quality >= 0.2), F.lit(False))


def missing_thumbnails(files: DataFrame) -> DataFrame:
    return files.where("thumbnail_path IS NULL OR thumbnail_path = ''").select("id", "path", "file_type")


def backfill_local(files: DataFrame) -> DataFrame:
    """(id, create_date_local) that names give to files without a local time."""
    local = F.try_to_timestamp(filename_datetime("path"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return files.where("create_date_local IS NULL").select("id", local.alias("create_date_local")).where("create_date_local IS NOT NULL")
