"""Work that fails: attempts, errors and the next time of each item, kept with what succeeded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from prismlake.sources.tablesets import Snapshot, TableSet

#: One row for each item and version that was tried: state is `done`, `failed` (may be tried again), `given_up` or `offline`.
ATTEMPTS = "file_id long, model_version string, state string, attempts int, error string, next_at long"
STATES = ("done", "failed", "given_up", "offline")


def due(rows: DataFrame, attempts: DataFrame, version: str, now: int, key: str = "id") -> DataFrame:
    """Rows that have never been tried in this version, or failed or were offline and whose next time has come."""
    mine = attempts.where(F.col("model_version") == version).select(F.col("file_id").alias(key), "state", "next_at")
    waiting = F.col("state").isin("done", "given_up") | (F.col("next_at") > now)
    # attempts are small on disk and large in memory, so their size must not decide on a broadcast; so below
    return rows.join(mine.where(waiting).hint("merge"), key, "left_anti")


def recorded(attempts: DataFrame, results: DataFrame, version: str, now: int, most: int = 3, delay: int = 60, defer: int = 600) -> DataFrame:
    """attempts after results (file_id, outcome, error): outcome `ok`, `failed`, `permanent` or `offline`.

    A failure counts, waits delay, then twice as long each time, and is given up after `most`; a permanent error at once. An
    offline source waits `defer` without counting. Unknown and null outcomes are failures. Of several results for an item a success counts most, then the order above.
    """
    rank = F.when(F.col("outcome") == "ok", 0).when(F.col("outcome") == "permanent", 2).when(F.col("outcome") == "offline", 3).otherwise(1)
    new = results.groupBy("file_id").agg(F.min_by(F.struct(rank.alias("rank"), "error"), F.struct(rank, "error")).alias("r"))
    old = attempts.where(F.col("model_version") == version).select("file_id", F.col("attempts").alias("before"))
    tried = new.join(old.hint("merge"), "file_id", "left").withColumn("n", F.coalesce("before", F.lit(0)) + F.when(F.col("r.rank") == 3, 0).otherwise(1))
    state = F.when(F.col("r.rank") == 0, "done").when(F.col("r.rank") == 3, "offline").when((F.col("r.rank") == 2) | (F.col("n") >= most), "given_up").otherwise("failed")
    rows = tried.withColumn("state", state)
    wait = F.when(F.col("state") == "failed", F.lit(delay) * F.pow(F.lit(2), F.least(F.col("n") - 1, F.lit(20)))).when(F.col("state") == "offline", F.lit(defer))
    rows = rows.select("file_id", F.lit(version).alias("model_version"), "state", F.col("n").cast("int").alias("attempts"), F.when(F.col("state") != "done", F.col("r.error")).alias("error"), (F.lit(now) + wait).cast("long").alias("next_at"))
    kept = attempts.join(rows.select("file_id", "model_version").hint("merge"), ["file_id", "model_version"], "left_anti").select(*rows.columns)
    return kept.unionByName(rows)


def work_once(tables: TableSet, rows: DataFrame, work: Callable[[DataFrame], DataFrame], version: str, now: int, result: str, key: str = "id", **limits: int) -> Snapshot:
    """Try what is due and commit results and attempts together; what a crash leaves undone is due again.

    work: from due rows to (file_id, outcome, error) and the columns of the table `result`, which gets the rows of outcome `ok`, in the place of older ones
    of their files. Rows that work leaves out have failed. Nothing due: nothing is committed.
    """
    base = tables.latest()
    attempts = base.table("attempts") if "attempts" in base else rows.sparkSession.createDataFrame([], ATTEMPTS)
    todo = due(rows, attempts, version, now, key)
    if not todo.take(1):
        return base
    # written first, so that the work is done once for both tables
    got = tables.commit(base, {"tried": work(todo).withColumn("_version", F.lit(version))}, notes={"tried_from": base.version})
    tried = got.table("tried")
    silent = todo.select(F.col(key).alias("file_id")).join(tried.select("file_id").hint("merge"), "file_id", "left_anti").select("file_id", F.lit("failed").alias("outcome"), F.lit("no result").alias("error"))
    new = recorded(attempts, tried.select("file_id", "outcome", "error").unionByName(silent), version, now, **limits)
    good = tried.where("outcome = 'ok'").drop("outcome", "error").withColumnRenamed("_version", "model_version")
    old = base.table(result).join(good.select("file_id").hint("merge"), "file_id", "left_anti").unionByName(good, allowMissingColumns=True) if result in base else good
    return tables.commit(got, {"attempts": new, result: old}, removed=("tried",))
