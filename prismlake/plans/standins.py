"""The driver's tables seen as a media index, in Spark and in DuckDB.

Every column of `files` is derived from an order's own columns, with nulls, lists and edge values in
fixed places, so that each operator meets its odd cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismlake.sources.tables import table

_FILES = """
SELECT o_orderkey AS id, o_orderkey AS media_id,
  'IMG_' || CAST(20200000 + o_orderkey % 1400 AS STRING) || '_' || lpad(CAST(o_orderkey % 26 AS STRING), 2, '0') || lpad(CAST(o_orderkey % 61 AS STRING), 2, '0') || '07.jpg' AS filename,
  '/lib/' || o_orderpriority || '/IMG_' || CAST(20200000 + o_orderkey % 1400 AS STRING) || '_' || lpad(CAST(o_orderkey % 26 AS STRING), 2, '0') || lpad(CAST(o_orderkey % 61 AS STRING), 2, '0') || '07.jpg' AS path,
  '/lib/' || o_orderpriority AS folder_path,
  CASE WHEN o_orderkey % 10 < 7 THEN 'jpg' WHEN o_orderkey % 10 = 7 THEN 'png' WHEN o_orderkey % 10 = 8 THEN 'mp4' ELSE 'heic' END AS extension,
  CASE WHEN o_orderkey % 10 = 8 THEN 'video' ELSE 'image' END AS file_type,
  CAST(round(o_totalprice) AS BIGINT) AS size,
  CASE WHEN o_orderkey % 19 <> 0 THEN {epoch} + 86400 END AS created,
  CASE WHEN o_orderkey % 23 <> 0 THEN {epoch} + 43200 END AS modified,
  CASE WHEN o_orderkey % 6 <> 0 THEN {epoch} + o_orderkey % 86400 END AS create_date,
  CASE WHEN o_orderkey % 3 <> 0 THEN {local} END AS create_date_local,
  CASE WHEN o_orderkey % 13 = 0 THEN 'screenshot' WHEN o_orderkey % 13 = 1 THEN 'screen_recording' WHEN o_orderkey % 13 = 2 THEN NULL WHEN o_orderkey % 13 = 3 THEN ' ' ELSE 'camera' END AS capture_type,
  CASE WHEN o_orderkey % 17 <> 0 THEN c_mktsegment END AS device_model,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Make' || CAST(c_nationkey % 4 AS STRING) END AS camera_make,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Model' || CAST(c_nationkey AS STRING) END AS camera_model,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Lens' || CAST(o_custkey % 5 AS STRING) END AS lens_model,
  CASE WHEN o_orderkey % 7 = 0 THEN 50.0 END AS focal_length,
  CASE WHEN o_orderkey % 8 = 0 THEN 100 END AS iso,
  CASE WHEN o_orderkey % 9 = 0 THEN 2.8 END AS aperture,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 4000 END AS width,
  CAST((o_orderkey % 4) * 1000 AS INT) AS height,
  CAST(o_orderkey % 48 AS DOUBLE) / 2 AS megapixels,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST((o_orderkey * 37) % 1800 AS DOUBLE) / 10 - 90 END AS latitude,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST((o_orderkey * 91) % 3600 AS DOUBLE) / 10 - 180 END AS longitude,
  CASE WHEN o_orderkey % 9 <> 0 THEN CAST((o_orderkey * 13) % 12001 AS DOUBLE) END AS altitude,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 8 = 0 THEN lower(substring(n_name, 8, 2)) || ', ZZ' ELSE 'N' || substring(n_name, 8, 2) END AS country,
  CASE WHEN o_orderkey % 4 <> 0 THEN '/thumbs/' || CAST(o_orderkey AS STRING) END AS thumbnail_path,
  n_name, n_regionkey, o_orderstatus
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

SPARK = {"epoch": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)", "local": "CAST(timestampadd(SECOND, o_orderkey % 86400, o_orderdate) AS TIMESTAMP_NTZ)"}
DUCK = {"epoch": "CAST(epoch(o_orderdate) AS BIGINT)", "local": "(o_orderdate + to_seconds(o_orderkey % 86400))"}

FILES = "files AS (" + _FILES.format(**DUCK).replace("AS STRING", "AS VARCHAR") + ")"
#: The capture time of a file as DuckDB finds it.
TS = "CASE WHEN create_date_local IS NOT NULL THEN create_date_local WHEN create_date IS NOT NULL THEN make_timestamp(create_date * 1000000) WHEN created IS NOT NULL AND modified IS NOT NULL THEN make_timestamp(least(created, modified) * 1000000) END"
DATED = "(create_date_local IS NOT NULL OR create_date IS NOT NULL OR created IS NOT NULL OR modified IS NOT NULL)"
#: Country codes of a file as a list.
CODES = "list_filter(list_transform(string_split(country, ','), lambda x: upper(trim(x))), lambda x: x <> '')"
TAGS = "tags AS (SELECT CAST(dense_rank() OVER (ORDER BY p_brand) AS BIGINT) AS id, p_brand AS name, '[' || string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) || ']' AS media_ids FROM part GROUP BY p_brand)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("orders", "customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"standin_{name}")
    sql = _FILES.format(**SPARK)
    return spark.sql(sql.replace("FROM orders JOIN customer", "FROM standin_orders AS orders JOIN standin_customer AS customer").replace("JOIN nation", "JOIN standin_nation AS nation"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as tags of the parts that have them, as ids in a JSON array."""
    from pyspark.sql import Window as W, functions as F

    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    return rows.select(F.dense_rank().over(W.orderBy("p_brand")).cast("bigint").alias("id"), F.col("p_brand").alias("name"), F.to_json("ids").alias("media_ids"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.functions.columns import to_epoch

    return table(spark, sf_dir, "events").withColumn("epoch", to_epoch("ts"))


#: Faces: each vector with its label as further coordinates, so that those of one label are alike; every 40th is in a must-link group.
FACES = "faces AS (SELECT vec_id AS face_id, CAST((vec_id * 37) % 101 AS DOUBLE) / 101 AS quality, CASE WHEN vec_id % 40 = 0 THEN vec_id // 40 % 3 END AS group_id, list_concat(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(2)), list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 / sqrt(2) ELSE 0 END)) AS x FROM embeddings)"


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    k, side = F.col("vec_id"), F.lit(1) / F.sqrt(F.lit(2.0))
    own = F.transform(F.col("embedding").cast("array<double>"), lambda x: x / F.sqrt(F.lit(2.0)))
    label = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), side).otherwise(F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select(k.alias("face_id"), ((k * 37) % 101 / 101.0).alias("quality"), F.when(k % 40 == 0, (k / 40).cast("bigint") % 3).alias("group_id"), F.concat(own, label).alias("embedding"))
