"""One filter language for explorer, counts, timelines, maps and searches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from prismlake.functions.columns import age_on, capture_date, countries, dated, id_array

SCREEN_CAPTURES = ("screenshot", "screen_recording")


def values(x: object) -> list:
    """A scalar or list as a list without empty values."""
    many = list(x) if isinstance(x, Iterable) and not isinstance(x, str) else [x]
    return [v for v in many if v is not None and v != ""]


@dataclass(frozen=True)
class FilterSpec:
    """What to show; all given filters must hold, and of each filter's values any.

    `ids` ranks results: None or an empty list is no filter, [-1] shows nothing.
    """

    ids: tuple[int, ...] | None = None
    person_id: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    date_exact: str | None = None
    device: object = None
    folder: object = None
    filetype: object = None
    media_type: object = None
    capture_type: object = None
    lens: object = None
    year: object = None
    country: object = None
    tag_id: object = None
    tag_match: str = "or"
    age: object = None
    search_by: str | None = None
    search_term: str | None = None


@dataclass(frozen=True)
class ViewOptions:
    birth_date: str | None = None
    exclude_screen_captures: bool = False
    hidden_folders: tuple[str, ...] = ()
    allow_undated: bool = False
    zone: str = "UTC"


@dataclass(frozen=True)
class Related:
    """Tables that some filters look into."""

    tags: DataFrame | None = None
    locations: DataFrame | None = None
    person_files: DataFrame | None = field(default=None)


def for_search(spec: FilterSpec, by_relevance: bool = True) -> FilterSpec:
    """The spec that a vector or text search starts from: no text search, and no ids if they are the relevance to replace."""
    return replace(spec, search_by=None, search_term=None, ids=None if by_relevance else spec.ids)


def merged(base: FilterSpec, **changes: object) -> FilterSpec:
    """base with changed filters; a value None clears one."""
    return replace(base, **changes)


def plain_predicate(spec: FilterSpec, options: ViewOptions = ViewOptions()) -> Column:
    """What needs no other table, as one condition that reaches the scan where its columns are plain."""
    day, out = capture_date(options.zone), F.lit(True)
    for op, v in (("ge", spec.date_from), ("le", spec.date_to), ("eq", spec.date_exact)):
        if v:
            limit = F.lit(v).cast("date")
            out &= day >= limit if op == "ge" else day <= limit if op == "le" else day == limit
    plain = {"device_model": spec.device, "folder_path": spec.folder, "extension": spec.filetype, "file_type": spec.media_type, "capture_type": spec.capture_type, "lens_model": spec.lens}
    for name, v in plain.items():
        if values(v):
            out &= F.col(name).isin(values(v))
    if values(spec.year):
        out &= F.year(day).isin([int(y) for y in values(spec.year)])
    if values(spec.country):
        out &= F.arrays_overlap(countries(F.replace(F.col("country"), F.lit(" "), F.lit(""))), F.array(*[F.lit(str(c).upper()) for c in values(spec.country)]))
    if values(spec.age) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", (options.birth_date or "")[:10]):
        out &= age_on(day, options.birth_date[:10]).isin([int(a) for a in values(spec.age)])
    if spec.search_by and spec.search_term:
        if spec.search_by == "media_id":
            out &= F.col("media_id") == F.lit(spec.search_term).try_cast("bigint")
        elif spec.search_by == "name":
            out &= F.col("filename").ilike(f"%{spec.search_term}%")
    if options.exclude_screen_captures:
        out &= ~F.coalesce("capture_type", F.lit("")).isin(*SCREEN_CAPTURES)
    hidden = [f for f in options.hidden_folders if f]
    if hidden:
        out &= ~F.col("folder_path").isin(hidden)
    return out if options.allow_undated else out & dated()


def tagged(tags: DataFrame, ids: list[int], match: str = "or") -> DataFrame:
    """(id) of files with any of the tags, or with all of them. A tag asked for twice can't be matched twice."""
    rows = tags.where(F.col("id").isin(ids)).select(F.col("id").alias("tag"), F.explode(id_array("media_ids")).alias("id"))
    if match == "and":
        return rows.groupBy("id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(ids)).select("id")
    return rows.select("id").distinct()


def located(locations: DataFrame, term: str) -> DataFrame:
    like = [F.col(c).ilike(f"%{term}%") for c in ("country", "subdivision", "city", "local_name", "english_name")]
    return locations.where(F.coalesce(like[0], F.lit(False)) | F.coalesce(like[1], F.lit(False)) | F.coalesce(like[2], F.lit(False)) | F.coalesce(like[3], F.lit(False)) | F.coalesce(like[4], F.lit(False))).select(F.col("file_id").alias("id")).distinct()


def ranked_ids(files: DataFrame, ids: Iterable[int]) -> DataFrame:
    """(id, rank) from a list in order of relevance; the list is the caller's own and so of its size."""
    return files.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(ids)], "id long, rank int")


def apply_filters(files: DataFrame, spec: FilterSpec = FilterSpec(), options: ViewOptions = ViewOptions(), related: Related = Related()) -> DataFrame:
    """The files that a spec shows. Filters that look into other tables are semi-joins."""
    out = files.where(plain_predicate(spec, options))
    if spec.ids:
        out = out.join(ranked_ids(files, spec.ids), "id", "left_semi")
    if spec.person_id is not None:
        if related.person_files is None:
            return out.where(F.lit(False))
        out = out.join(related.person_files.where(F.col("person_id") == spec.person_id).select(F.col("file_id").alias("id")), "id", "left_semi")
    if values(spec.tag_id) and related.tags is not None:
        out = out.join(tagged(related.tags, [int(t) for t in values(spec.tag_id)], spec.tag_match), "id", "left_semi")
    if spec.search_by == "location" and spec.search_term and related.locations is not None:
        out = out.join(located(related.locations, spec.search_term), "id", "left_semi")
    return out


def without_flights(altitude: Column) -> Column:
    """Not taken from an aeroplane: no altitude, or none above 9000 m."""
    return altitude.isNull() | (altitude <= 9000)


def milestone_capture() -> Column:
    return F.coalesce(F.nullif(F.trim("capture_type"), F.lit("")), F.lit("unknown")).isin("camera", "unknown")


def person_query(q: str) -> Column:
    """Everyone for an empty query; else part of the name without case, or the id."""
    return F.lit(True) if q == "" else F.coalesce(F.col("name").ilike(f"%{q}%"), F.lit(False)) | (F.col("id").cast("string") == q)


def path_prefix(prefix: str) -> Column:
    """Paths that begin with a prefix, without ASCII case; wildcards in it are taken literally."""
    return F.lower(F.col("path")).startswith(prefix.lower())


def _bases() -> tuple[str, str]:
    """Lower-case Latin letters whose canonical decomposition begins with an ASCII letter, and those letters; then combining marks, which have none."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()]
    pairs = [(x, d[0]) for x in letters if len(d := unicodedata.normalize("NFD", x)) > 1 and d[0].isascii()]
    pairs.append(("ł", "l"))  # has no decomposition, but is searched for as l
    return "".join(x for x, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(y for _, y in pairs)


def folded(c: Column) -> Column:
    """Lower case without the accents of Latin letters and without combining marks, for searches that ignore both."""
    return F.translate(F.lower(c), *_bases())


def place_search(term: str, columns: Iterable[str]) -> Column:
    t = folded(F.lit(term.strip()))
    out = F.lit(term.strip() == "")
    for c in columns:
        out = out | F.contains(folded(F.coalesce(F.col(c), F.lit(""))), t)
    return out
