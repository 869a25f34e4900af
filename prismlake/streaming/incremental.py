"""Enrichment of what isn't enriched yet, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(rows: DataFrame, done: DataFrame, key: str = "id", done_key: str = "file_id", version: str | None = None, version_column: str = "model_version") -> DataFrame:
    """Rows without a row of done; with a version only rows of that version count as done."""
    ready = done if version is None else done.where(F.col(version_column) == version)
    return rows.join(ready.select(F.col(done_key).alias(key)), key, "left_anti")


def current(done: DataFrame, version: str, version_column: str = "model_version") -> DataFrame:
    """What stays of derived rows when the pipeline's version changes."""
    return done.where(F.col(version_column) == version)


def enriched(rows: DataFrame, done: DataFrame, enrich: Callable[[DataFrame], DataFrame], version: str, key: str = "id", done_key: str = "file_id") -> DataFrame:
    """done with new rows for all that is pending. A row that enrich leaves out gets a row of nulls, so it isn't tried for ever."""
    todo = pending(rows, done, key, done_key, version)
    fresh = enrich(todo).withColumn("model_version", F.lit(version))
    failed = todo.select(F.col(key).alias(done_key)).join(fresh.select(done_key), done_key, "left_anti").withColumn("model_version", F.lit(version))
    kept = current(done, version)
    return kept.unionByName(fresh, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True).select(*done.columns)


def follow(spark: SparkSession, source: str, schema, enrich: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, done: Callable[[], DataFrame] | None = None, done_key: str = "file_id", key: str = "id") -> StreamingQuery:
    """Enrich Parquet files that arrive in a folder and add the results to a table; each file once, across restarts.

    Runs over all that is there and stops; start it again to go on from the checkpoint. Each batch is a
    partition `batch=<id>` of the sink and replaces it, so a batch that is replayed after a crash isn't there twice. A
    row that an earlier batch enriched (done) isn't enriched again.
    """

    def batch(df: DataFrame, number: int) -> None:
        todo = df if done is None else df.join(done().select(F.col(done_key).alias(key)), key, "left_anti")
        enrich(todo).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reworked(rows: DataFrame, done: DataFrame, enrich: Callable[[DataFrame], DataFrame], mode: str, key: str = "id", done_key: str = "file_id", mode_column: str = "mode") -> DataFrame:
    """done for a mode: rows of that mode stay, all others are enriched anew, also those that were done in another mode."""
    kept = done.where(F.col(mode_column) == mode)
    fresh = enrich(rows.join(kept.select(F.col(done_key).alias(key)), key, "left_anti")).withColumn(mode_column, F.lit(mode))
    return kept.unionByName(fresh, allowMissingColumns=True).select(*done.columns)


def session_stream(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(keys, first, last, n): sessions of a stream or table by gap; events later than `late` are left out of a stream."""
    stream = events.withWatermark(time, late) if events.isStreaming else events
    return stream.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).drop("w")


def weekly_stream(events: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """(week, n): events in seven-day windows since 1970."""
    stream = events.withWatermark(time, late) if events.isStreaming else events
    return stream.groupBy(F.window(time, "7 days").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "n")
