"""Column builders shared by the operators; all stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
EARTH_KM = 6371.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def least2(a: Column | str, b: Column | str) -> Column:
    """The lesser of two values; null if either is null."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def from_epoch(seconds: Column | str, zone: str = "UTC") -> Column:
    """Wall-clock time without zone of epoch seconds, in a zone that doesn't depend on the session."""
    utc = F.timestamp_add("SECOND", col(seconds), F.expr(EPOCH))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def to_epoch(wall: Column | str) -> Column:
    """Seconds since 1970 of a wall-clock time taken as UTC."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH), col(wall))


def capture_ts(zone: str = "UTC") -> Column:
    """When a file was captured: its local time, else its capture epoch, else the lesser of created and modified."""
    return F.coalesce(F.col("create_date_local"), from_epoch("create_date", zone), from_epoch(least2("created", "modified"), zone))


def capture_date(zone: str = "UTC") -> Column:
    return capture_ts(zone).cast("date")


def dated() -> Column:
    """Any of the four dates is there."""
    return F.col("create_date_local").isNotNull() | F.coalesce("create_date", "created", "modified").isNotNull()


def age_on(day: Column, birth: str) -> Column:
    """Whole years from a birth date (YYYY-MM-DD): the year's difference, less one before the birthday."""
    return F.year(day) - int(birth[:4]) - F.when(F.date_format(day, "MM-dd") < birth[5:10], 1).otherwise(0)


def countries(c: Column | str = "country") -> Column:
    """A comma-separated list as an array of trimmed upper-case codes."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def id_array(c: Column | str) -> Column:
    """Ids in a JSON array."""
    return F.from_json(col(c), "array<bigint>")


def thumbnail_score() -> Column:
    """How much is known about a picture: the more, the better it represents its group."""
    # fixed values: weight of each column that is not null
    weights = {"camera_make": 4, "camera_model": 3, "lens_model": 2, "focal_length": 2, "iso": 1, "aperture": 1, "latitude": 2, "longitude": 2}
    out = F.lit(0)
    for name, w in weights.items():
        out = out + F.when(F.col(name).isNotNull(), w).otherwise(0)
    return out


def aspect_distance(to: float = 1.3) -> Column:
    """How far width / height is from a pleasant shape; null for height 0."""
    return F.abs(F.try_divide(F.col("width").cast("double"), F.col("height").cast("double")) - to)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres along a great circle."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def valid_coordinates(lat: str = "latitude", lon: str = "longitude") -> Column:
    return F.coalesce(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180), F.lit(False))


def grid_cell(lat: Column, lon: Column) -> Column:
    """Number of the 0.1 degree cell, row by row from the south-west, the last row and column holding the upper edges."""
    x = F.least(F.greatest(F.floor((lon + 180) * 10), F.lit(0)), F.lit(3599))
    y = F.least(F.greatest(F.floor((lat + 90) * 10), F.lit(0)), F.lit(1799))
    return (y * 3600 + x).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero norm counts as 1."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def filename_datetime(path: Column | str) -> Column:
    """`YYYY-MM-DD HH:MM:SS` from a name that holds YYYYMMDD_HHMMSS with month 1-12, day 1-31, hour to 23, minute and second to 59.

    The day is not held against the month's length.
    """
    pattern = r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})"
    part = [F.regexp_extract(col(path), pattern, i) for i in range(1, 7)]
    n = [F.expr("0") + F.coalesce(p.try_cast("int"), F.lit(-1)) for p in part]
    fine = n[1].between(1, 12) & n[2].between(1, 31) & n[3].between(0, 23) & n[4].between(0, 59) & n[5].between(0, 59)
    return F.when((part[0] != "") & fine, F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit(" "), part[3], F.lit(":"), part[4], F.lit(":"), part[5]))


def display_name(english_first: bool = True) -> Column:
    """A place's name: the preferred of its two names that isn't empty, else the other, else its city."""
    a, b = ("english_name", "local_name") if english_first else ("local_name", "english_name")
    return F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")), F.col("city"))


def remap_prefix(path: Column | str, prefixes: dict[str, str]) -> Column:
    """Replace the first matching prefix, compared without case and with backslashes as slashes."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    out = col(path)
    for old, new in reversed(prefixes.items()):
        o = old.replace("\\", "/")
        out = F.when(F.lower(F.substring(p, 1, len(o))) == o.lower(), F.concat(F.lit(new), F.substr(p, F.lit(len(o) + 1)))).otherwise(out)
    return out


def percent(done: Column, total: Column) -> Column:
    """Rounded share in percent; 0 of nothing is 0."""
    return F.when(total > 0, F.round(done / total * 100)).otherwise(0).cast("int")


def ocr_boxes(boxes: Column | str, text: Column | str) -> Column:
    """Boxes, each eight values of 0 to 65535, as points of unit size beside the lines of the text; missing lines are empty."""
    lines = F.split(col(text), "\n")
    point = lambda b, i: F.struct((F.get(b, F.lit(2 * i)) / 65535.0).alias("x"), (F.get(b, F.lit(2 * i + 1)) / 65535.0).alias("y"))
    return F.transform(col(boxes), lambda b, i: F.struct(F.array(*[point(b, j) for j in range(4)]).alias("points"), F.coalesce(F.get(lines, i), F.lit("")).alias("text")))


def box_values(boxes: Column | str) -> Column:
    """The other way: points of unit size of each box as eight whole values of 0 to 65535; what lies outside goes to the edge."""
    value = lambda v: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 65535).cast("int")
    return F.transform(col(boxes), lambda b: F.flatten(F.transform(b["points"], lambda p: F.array(value(p["x"]), value(p["y"])))))


def avatar_crop(left: Column, top: Column, width: Column, height: Column, image_w: Column, image_h: Column, orientation: Column) -> Column:
    """A square of 1.75 times the face's longer side around its middle, inside the upright image."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    w, h = F.when(turned, image_h).otherwise(image_w), F.when(turned, image_w).otherwise(image_h)
    side = F.least(F.greatest(width * w, height * h) * 1.75, w, h)
    x = F.greatest(F.lit(0.0), F.least((left + width / 2) * w - side / 2, w - side))
    y = F.greatest(F.lit(0.0), F.least((top + height / 2) * h - side / 2, h - side))
    return F.struct(F.floor(x).alias("x"), F.floor(y).alias("y"), F.floor(side).alias("side"))
