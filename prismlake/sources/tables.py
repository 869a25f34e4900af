"""Reading tables, dimensions and listings."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LISTING = "path string, modificationTime timestamp, length bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, the warehouse, or in local mode a folder for temporary files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.gettempdir()}/checkpoints" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, which ends its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def listing(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of all files below a folder that aren't empty; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root).drop("content")


def populations(spark: SparkSession, path: str) -> DataFrame:
    """(code, population) from a semicolon-separated table with a header; code is iso2, else id; what isn't a number is 0."""
    rows = spark.read.option("sep", ";").option("header", True).csv(path)
    bom = [c for c in rows.columns if c.startswith("﻿")]
    for c in bom:
        rows = rows.withColumnRenamed(c, c.lstrip("﻿"))
    code = F.upper(F.coalesce(F.nullif(F.trim("iso2"), F.lit("")), F.trim("id")))
    return rows.select(code.alias("code"), F.coalesce(F.trim("population").try_cast("bigint"), F.lit(0)).alias("population")).where("code IS NOT NULL AND code <> ''")


def code_names(names: dict[str, str], code: Column) -> Column:
    """The name of a code from a short mapping, compared in upper case."""
    pairs = [F.lit(x) for k, v in names.items() for x in (k.upper(), v)]
    return F.create_map(*pairs)[F.upper(code)] if pairs else F.lit(None).cast("string")


def write_swapped(df: DataFrame, path: str) -> None:
    """Replace a Parquet table, reading from the old one allowed: written beside it, then both are renamed.

    The old table is deleted only after the new one stands in its place; if a rename fails, the old one goes back and an
    error is raised. A crash between the renames leaves the old table whole under `path.old`, from where the next call restores it.
    """
    spark = df.sparkSession
    conf, fs_path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, now, old = (fs_path(path + x) for x in (".new", "", ".old"))
    fs = now.getFileSystem(conf)
    if fs.exists(old):
        if fs.exists(now):
            fs.delete(old, True)
        elif not fs.rename(old, now):
            raise OSError(f"can't restore {path}")
    df.write.mode("overwrite").parquet(path + ".new")
    had = fs.exists(now)
    if had and not fs.rename(now, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, now):
        if had:
            fs.rename(old, now)
        raise OSError(f"can't put the new table at {path}")
    if had:
        fs.delete(old, True)
