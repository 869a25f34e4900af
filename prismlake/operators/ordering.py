"""Order, pages and positions of shown files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prismlake.functions.columns import from_epoch
from prismlake.operators.filters import ranked_ids

#: Sort keys that a caller may name, and their columns.
SORTS = {"media_id": "media_id", "name": "filename", "create_date_local": None, "created": "created", "size": "size"}


@dataclass(frozen=True)
class SortSpec:
    by: str = "media_id"
    descending: bool = True
    seed: int | None = None


def sort_columns(sort: SortSpec, default: str = "media_id", zone: str = "UTC") -> list[Column]:
    """Columns to order by, the id last; an unknown key falls back to the default. Dates fall back to create_date only."""
    if sort.by == "random":
        return [F.rand(sort.seed), F.col("id")]
    name = sort.by if sort.by in SORTS else default if default in SORTS else "media_id"
    key = F.coalesce(F.col("create_date_local"), from_epoch("create_date", zone)) if name == "create_date_local" else F.col(SORTS[name])
    return [key.desc() if sort.descending else key.asc(), F.col("id").desc() if sort.descending else F.col("id").asc()]


def page(files: DataFrame, sort: SortSpec = SortSpec(), offset: int = 0, limit: int = 200, default: str = "media_id") -> DataFrame:
    """Rows offset to offset + limit; Spark keeps only so many per task."""
    out = files.orderBy(*sort_columns(sort, default))
    return (out.offset(offset) if offset > 0 else out).limit(limit)


def by_relevance(files: DataFrame, ids: list[int]) -> DataFrame:
    """Files of a ranked list with their rank, best first."""
    return files.join(F.broadcast(ranked_ids(files, ids)) if len(ids) <= 100_000 else ranked_ids(files, ids), "id").orderBy("rank", "id")


def position(files: DataFrame, item_id: int) -> DataFrame:
    """(position): how many shown files stand before an item in descending media_id; null if it isn't shown."""
    at = F.max(F.when(F.col("id") == item_id, F.col("media_id")))
    one = files.agg(at.alias("at"))
    return files.crossJoin(F.broadcast(one)).agg(F.when(F.max("at").isNotNull(), F.count_if(F.col("media_id") > F.col("at"))).alias("position"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int = 20) -> DataFrame:
    """The first n rows of each group, numbered from 1; tasks drop what can't be among them before the shuffle."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)
