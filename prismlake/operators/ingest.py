"""From a listing to numbered rows of the index, in one commit for each batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from prismlake.operators.clustering import cut
from prismlake.operators.media import pending_paths
from prismlake.sources.tablesets import Snapshot, TableSet


def numbered(rows: DataFrame, last: int, column: str = "media_id") -> DataFrame:
    """rows with numbers last + 1, last + 2, ... without a gap, in no order that matters; nothing is sorted or shuffled.

    Rows are written once; a partition's numbers begin after those of the partitions before it, of which there is one count each.
    """
    at = cut(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * (1 << 33)}))
    counts = sorted((r["_part"], r["n"]) for r in at.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row for each partition
    before, starts = last, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    first = rows.sparkSession.createDataFrame(starts, "_part int, _before long")
    return at.join(F.broadcast(first), "_part").withColumn(column, F.col("_before") + F.col("_row") + 1).select(*rows.columns, column)


def indexed(s: Snapshot) -> DataFrame | None:
    """All files of a snapshot; None before the first batch."""
    parts = [s.table(n) for n in sorted(s.tables) if n.startswith("files_")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def ingest(tables: TableSet, listing: DataFrame, extract: Callable[[DataFrame], DataFrame], batch: int, removed: DataFrame | None = None) -> Snapshot:
    """Commit what a numbered batch of listed paths adds: paths that are neither indexed nor removed by the user, each once.

    extract: from listed rows to rows with path and metadata; rows that it leaves out (unreadable files) are listed again next time. New files
    get the media_ids after the last one given, and the batch's number, the last media_id and the files are one commit: a batch that is committed
    already changes nothing, one that crashed gets the same range of numbers again.
    """
    s = tables.latest()
    if s.notes.get("ingest_batch", -1) >= batch:
        return s
    known, last = indexed(s), s.notes.get("last_media_id", 0)
    none = listing.select("path").limit(0)
    fresh = pending_paths(listing.where("path IS NOT NULL").dropDuplicates(["path"]), none if known is None else known, none if removed is None else removed)
    rows = numbered(extract(fresh), last)
    told = lambda new: {"ingest_batch": batch, "last_media_id": last + new.table(f"files_{batch:06d}").count()}
    return tables.commit(s, {f"files_{batch:06d}": rows}, notes=told)
