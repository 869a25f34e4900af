"""Faces to people batch by batch: people, assignments, known faces and suggestions change in one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from prismlake.operators.clustering import leaders
from prismlake.sources.tables import cut
from prismlake.sources.tablesets import Snapshot, TableSet

# fixed values: the tables of people and their columns
TABLES = {
    "people": "person_id long, cover_face_id long, cover_quality double, hidden boolean",
    "assignments": "face_id long, person_id long, score double, assigned_by string",
    "representatives": "person_id long, face_id long, place int, embedding array<double>",
    "suggestions": "face_id long, candidate_face_id long, score double",
}


def state(snapshot: Snapshot) -> dict[str, DataFrame]:
    """The tables of a snapshot, empty ones where there is none yet."""
    return {n: snapshot.table(n) if n in snapshot else snapshot.spark.createDataFrame([], schema) for n, schema in TABLES.items()}


def assigned(tables: dict[str, DataFrame], faces: DataFrame, ignored: DataFrame | None = None, order: list[Column] | None = None) -> dict[str, DataFrame]:
    """`state` tables after new faces (face_id, quality, embedding), taken in order (face_id unless given), face_id last.

    Each face joins the visible person of best score, whose known faces it resembles enough, or opens a person called by
    its own face_id; the first six faces of a person become known. A face that opens one near a known face gets a suggestion of that face. A person's cover
    is the face of best quality, the earlier of equal ones. Faces that are assigned already, ignored or without vector are left alone.
    """
    people, done, known, suggested = (tables[n] for n in TABLES)
    fresh = faces.join(done.select("face_id"), "face_id", "left_anti").dropDuplicates(["face_id"]).withColumn("group_id", F.lit(None).cast("long"))
    shown = known.join(people.where("hidden").select("person_id"), "person_id", "left_anti")
    got = cut(leaders(fresh, shown, ignored, order=order or [F.col("face_id")]))  # four tables read it
    new = got.join(faces.select(F.col("face_id").cast("long").alias("face_id"), F.col("quality").cast("double").alias("quality"), F.col("embedding").cast("array<double>").alias("embedding"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order or [])], "face_id").alias("at")).dropDuplicates(["face_id"]), "face_id")
    opened = new.where("leader = face_id")
    best = new.groupBy(F.col("leader").alias("person_id")).agg(F.min_by("face_id", F.struct(-F.coalesce("quality", F.lit(-1.0)), "at")).alias("face"), F.max("quality").alias("quality"))
    all_people = people.unionByName(opened.select(F.col("face_id").alias("person_id"), F.lit(False).alias("hidden")), allowMissingColumns=True).join(best, "person_id", "left")
    better = F.col("face").isNotNull() & (F.col("cover_face_id").isNull() | (F.coalesce("quality", F.lit(-1.0)) > F.coalesce("cover_quality", F.lit(-1.0))))
    return {
        "people": all_people.select("person_id", F.when(better, F.col("face")).otherwise(F.col("cover_face_id")).alias("cover_face_id"), F.when(better, F.col("quality")).otherwise(F.col("cover_quality")).alias("cover_quality"), "hidden"),
        "assignments": done.unionByName(new.select("face_id", F.col("leader").alias("person_id"), F.when(F.col("leader") != F.col("face_id"), F.col("score")).alias("score"), F.lit("auto").alias("assigned_by"))),
        "representatives": known.unionByName(new.where("place IS NOT NULL").select(F.col("leader").alias("person_id"), "face_id", F.col("place").cast("int").alias("place"), "embedding")),
        "suggestions": suggested.unionByName(new.where("suggested IS NOT NULL").select("face_id", F.col("suggested").alias("candidate_face_id"), F.col("suggested_score").alias("score"))),
    }


def assign_batch(tables: TableSet, faces: DataFrame, batch: int, ignored: DataFrame | None = None, order: list[Column] | None = None) -> Snapshot:
    """Commit what a numbered batch of faces changes; a batch that is committed already changes nothing."""
    base = tables.latest()
    if base.notes.get("faces_batch", -1) >= batch:
        return base
    return tables.commit(base, assigned(state(base), faces, ignored, order), notes={"faces_batch": batch})


def follow_faces(spark: SparkSession, source: str, schema: str, tables: TableSet, checkpoint: str, order: list[Column] | None = None, files: int | None = None) -> StreamingQuery:
    """Assign faces of Parquet files that arrive in a folder, each file once across restarts; `files` of them make a batch.

    A batch that is run again after a crash between its commit and the stream's own is known by its number and left alone.
    """
    stream = spark.readStream.schema(schema)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: assign_batch(tables, df, n, order=order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
