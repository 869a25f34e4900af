"""Tags, memories, selections, removals and clean-up. Every change gives a new table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prismlake.functions.columns import capture_date, capture_ts, id_array
from prismlake.operators.filters import path_prefix, without_flights


def _ids(change) -> Column:
    return F.to_json(change(F.coalesce(id_array("media_ids"), F.array().cast("array<bigint>"))))


def with_item(tags: DataFrame, tag: int, item: int, now_ms: int | None = None) -> DataFrame:
    """The item at the end of a tag's list, unless it is there."""
    add = _ids(lambda a: F.when(F.array_contains(a, F.lit(item)), a).otherwise(F.array_append(a, F.lit(item).cast("bigint"))))
    return _changed(tags, tag, add, now_ms)


def without_item(tags: DataFrame, tag: int, item: int, now_ms: int | None = None) -> DataFrame:
    return _changed(tags, tag, _ids(lambda a: F.array_remove(a, F.lit(item).cast("bigint"))), now_ms)


def with_items(tags: DataFrame, tag: int, items: list[int], now_ms: int | None = None) -> DataFrame:
    return _changed(tags, tag, F.to_json(F.array(*[F.lit(int(i)).cast("bigint") for i in items]).cast("array<bigint>")), now_ms)


def _changed(tags: DataFrame, tag: int, ids: Column, now_ms: int | None) -> DataFrame:
    here = F.col("id") == tag
    out = tags.withColumn("media_ids", F.when(here, ids).otherwise(F.col("media_ids")))
    return out if now_ms is None or "last_used" not in tags.columns else out.withColumn("last_used", F.when(here, F.lit(now_ms)).otherwise(F.col("last_used")))


def used_tags(tags: DataFrame) -> DataFrame:
    """Tags with anything in them; counts are list lengths, whether or not the files exist."""
    return tags.where(F.json_array_length("media_ids") > 0).select("id", "name", F.json_array_length("media_ids").cast("bigint").alias("n")).orderBy("name", "id")


def memories_in_order(memories: DataFrame) -> DataFrame:
    return memories.orderBy(F.col("sort_order").desc_nulls_last(), F.col("created").desc_nulls_last(), "id")


def reordered(memories: DataFrame, order: list[int]) -> DataFrame:
    """The first id gets the greatest sort_order; memories not named keep theirs."""
    new = memories.sparkSession.createDataFrame([(int(i), len(order) - k) for k, i in enumerate(order)], "id long, _o int")
    return memories.join(F.broadcast(new), "id", "left").withColumn("sort_order", F.coalesce("_o", "sort_order")).drop("_o").select(*memories.columns)


def memory_files(files: DataFrame, start: int | None = None, end: int | None = None, id_from: int | None = None, id_to: int | None = None, prefix: str | None = None) -> DataFrame:
    """(id) of files of a new memory: by capture seconds, else by ids, else by path.

    Capture seconds are create_date, else created if it isn't after modified, else modified (also where created is unknown).
    """
    at = F.coalesce("create_date", F.when(F.col("created") <= F.col("modified"), F.col("created")).otherwise(F.col("modified")))
    if start is not None or end is not None:
        rows = files.where(at.between(start if start is not None else -(1 << 62), end if end is not None else 1 << 62))
    elif id_from is not None or id_to is not None:
        rows = files.where(F.col("media_id").between(id_from if id_from is not None else 0, id_to if id_to is not None else 1 << 62))
    elif prefix:
        rows = files.where(path_prefix(prefix))
    else:
        rows = files.where(F.lit(False))
    return rows.select("id")


@dataclass(frozen=True)
class Selection:
    """A named result set: kind `year`, `month`, `on_this_day`, `trip`, `custom` or `place`."""

    kind: str
    year: int | None = None
    month: int | None = None
    today: str | None = None
    start: str | None = None
    end: str | None = None
    ids: tuple[int, ...] = ()
    country: str | None = None
    skip_flights: bool = False


def resolved(files: DataFrame, selections: list[Selection], zone: str = "UTC") -> DataFrame:
    """(id) of all files in any of the selections, each once."""
    day, ts, any_ = capture_date(zone), capture_ts(zone), F.lit(False)
    for s in selections:
        if s.kind == "year":
            hit = F.year(day) == s.year
        elif s.kind == "month":
            hit = (F.year(day) == s.year) & (F.month(day) == s.month)
        elif s.kind == "on_this_day":
            hit = (F.date_format(day, "MM-dd") == s.today[5:10]) & (F.year(day) < int(s.today[:4]) if s.year is None else F.year(day) == s.year)
        elif s.kind == "trip":
            hit = ts.between(F.lit(s.start).cast("timestamp_ntz"), F.lit(s.end).cast("timestamp_ntz"))
        elif s.kind == "custom":
            hit = F.col("id").isin(list(s.ids)) if s.ids else F.lit(False)
        elif s.kind == "place":
            from prismlake.functions.columns import countries

            hit = F.array_contains(countries(), s.country.upper())
        else:
            raise ValueError(f"no such selection: {s.kind}")
        hit = hit & without_flights(F.col("altitude")) if s.skip_flights else hit
        any_ = any_ | F.coalesce(hit, F.lit(False))
    return files.where(any_).select("id").distinct()


#: Places of a list that are put together at once.
STRETCH = 4096


def removed(files: DataFrame, gone: DataFrame, lists: dict[str, DataFrame], derived: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after files (gone: id) are removed: `files`, new `tombstones`, lists without their ids, derived tables without their rows.

    lists have media_ids in JSON; ids are taken out by exploding them, so however many files go, no list of them is a literal. What is
    left of a list is put together in stretches of its places, so that a task holds texts of lists and not all their items.
    """
    out = {"files": files.join(gone, "id", "left_anti"), "tombstones": files.join(gone, "id", "left_semi").select("path", "folder_path")}
    for name, t in lists.items():
        items = t.select("id", F.posexplode(id_array("media_ids")).alias("at", "item"))
        kept = items.join(gone.select(F.col("id").alias("item")), "item", "left_anti")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: F.coalesce(x["item"].cast("string"), F.lit("null"))), ",")
        kept = kept.groupBy("id", F.floor(F.col("at") / STRETCH).alias("stretch")).agg(text.alias("text"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "text"))), lambda x: x["text"]), ",")
        kept = kept.groupBy("id").agg(F.concat(F.lit("["), text, F.lit("]")).alias("_kept"))
        out[name] = t.join(kept, "id", "left").withColumn("media_ids", F.coalesce("_kept", F.lit("[]"))).drop("_kept").select(*t.columns)
    for name, t in derived.items():
        out[name] = t.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return out


def faces_removed(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables of faces and people after files (gone: id) are removed, in one cascade; tables that aren't given are left out.

    faces (id, file_id, recognition_quality) and what hangs on them go: assignments, representatives, members and ignored (face_id), suggestions
    (face_id, candidate_face_id) on either side, scans and items (file_id). Of people (id, cover_face_id) those without
    an assigned face go; a cover that is null or no face any more becomes the person's face of best quality (null last), then least id.
    """
    ids = gone.select(F.col("id").alias("file_id")).distinct()
    lost = tables["faces"].join(ids, "file_id", "left_semi").select("id").distinct()
    without = lambda t, c: t.join(lost.select(F.col("id").alias(c)), c, "left_anti").select(*t.columns)
    out = {n: without(tables[n], "id" if n == "faces" else "face_id") for n in ("faces", "assignments", "representatives", "members", "ignored", "suggestions") if n in tables}
    if "suggestions" in out:
        out["suggestions"] = without(out["suggestions"], "candidate_face_id")
    out |= {n: tables[n].join(ids, "file_id", "left_anti").select(*tables[n].columns) for n in ("scans", "items") if n in tables}
    if "people" in tables:
        faces, people = out["faces"], tables["people"]
        own = out["assignments"].select("face_id", F.col("person_id").alias("_person")).join(faces.select(F.col("id").alias("face_id"), F.col("recognition_quality").alias("_quality"), F.lit(True).alias("_known")), "face_id", "left")
        # an assignment whose face is unknown keeps its person, but is no cover
        best = F.max_by(F.when(F.col("_known"), F.col("face_id")), F.when(F.col("_known"), F.struct("_quality", -F.col("face_id"))))
        own = own.groupBy("_person").agg(best.alias("_best"))
        there = faces.select(F.col("id").alias("cover_face_id"), F.lit(True).alias("_there"))
        both = people.join(own, F.col("id") == F.col("_person")).join(there, "cover_face_id", "left")
        cover = F.when(F.col("_there"), F.col("cover_face_id")).otherwise(F.col("_best")).alias("cover_face_id")
        out["people"] = both.select(*[cover if c == "cover_face_id" else F.col(c) for c in people.columns])
    return out


def folder_files(files: DataFrame, folder: str) -> DataFrame:
    """(id) of files in a folder or below."""
    return files.where((F.col("folder_path") == folder) | F.col("folder_path").startswith(folder.rstrip("/") + "/")).select("id")


def orphans(derived: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """(name, n): rows of derived tables whose file is gone."""
    out = None
    for name, t in derived.items():
        n = t.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


def merged_groups(memberships: DataFrame, exclusions: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """Must-link groups merged into the least id: memberships (manual_person_id, face_id) and exclusions, re-pointed and each once.

    An exclusion within the merged group goes.
    """
    to = lambda c: F.when(F.col(c).isin(ids), F.lit(min(ids))).otherwise(F.col(c)).cast("bigint")
    members = memberships.select(to("manual_person_id").alias("manual_person_id"), "face_id").distinct()
    a, b = to("left_manual_person_id"), to("right_manual_person_id")
    apart = exclusions.select(F.least(a, b).alias("left_manual_person_id"), F.greatest(a, b).alias("right_manual_person_id")).where("left_manual_person_id <> right_manual_person_id").distinct()
    return members, apart


def split_group(memberships: DataFrame, group: int) -> DataFrame:
    """Each face of a group its own group, numbered after the greatest."""
    from pyspark.sql import Window as W

    top = memberships.agg(F.max("manual_person_id").alias("top"))
    inner = memberships.where(F.col("manual_person_id") == group).crossJoin(F.broadcast(top))
    alone = inner.select((F.col("top") + F.row_number().over(W.partitionBy("manual_person_id").orderBy("face_id"))).cast("bigint").alias("manual_person_id"), "face_id")
    return memberships.where(F.col("manual_person_id") != group).select("manual_person_id", "face_id").union(alone)
