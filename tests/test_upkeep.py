"""Items by hand, listings, code tables, searches with an embedder, seeded order."""

import functools
import json
import os

import numpy as np
import oracle
from pyspark.sql import functions as F

from prismlake.functions import columns as C
from prismlake.operators import decisions, ordering, people, search, stats
from prismlake.plans import registry, standins, upkeep
from prismlake.sources import tables
from prismlake.streaming import retries


def state(spark, assignments, members=(), items=()):
    return decisions.State(
        spark.createDataFrame([(i, None, None, False) for i in sorted({p for _, p in assignments})], "id long, name string, cover_face_id long, hidden boolean"),
        spark.createDataFrame([(f, p, "auto") for f, p in assignments], "face_id long, person_id long, assigned_by string"),
        spark.createDataFrame([(i, None, None if i != 5 else 30) for i in sorted({g for g, _ in members})], "id long, name string, avatar_face_id long"),
        spark.createDataFrame(list(members), "manual_person_id long, face_id long"),
        spark.createDataFrame([], "manual_person_id long"),
        spark.createDataFrame([], "left_manual_person_id long, right_manual_person_id long"),
        spark.createDataFrame(list(items), "manual_person_id long, file_id long"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_files_given_to_a_person_by_hand_and_taken_back(spark):
    # faces 10 and 11 are person 1's, in files 100 and 101; 20 and 21 are 2's in 200 and 201, 30 and 31 are 3's, both in 300
    faces = spark.createDataFrame([(10, 100), (11, 101), (20, 200), (21, 201), (30, 300), (31, 300)], "id long, file_id long")
    files = spark.createDataFrame([(f,) for f in (100, 101, 200, 201, 300, 400, 500)], "id long")
    s = state(spark, [(10, 1), (11, 1), (20, 2), (21, 2), (30, 3), (31, 3)], [(5, 30)])
    new = decisions.with_items(s, faces, files, 1, [100, 400, 400, 999, 200, 201], [20, 31, 30, 10])
    assert rows(new.assignments.select("face_id", "person_id")) == [(10, 1), (11, 1), (20, 1), (21, 2), (30, 3), (31, 1)]
    group = {f: g for g, f in rows(new.members.select("manual_person_id", "face_id"))}
    assert group[10] == group[11] == group[20] == group[31] == 6 and group[30] == 5 and 21 not in group
    assert rows(new.items) == [(6, 201), (6, 400)]
    assert rows(decisions.people_files(new, faces).where("person_id = 1").select("file_id")) == [(100,), (101,), (200,), (201,), (300,), (400,)]
    # the last face of a person takes the person along; an avatar that moves away is forgotten
    gone = decisions.with_items(new, faces.union(spark.createDataFrame([(30, 600)], faces.schema)).where("NOT (id = 30 AND file_id = 300)"), files, 2, [], [30])
    assert rows(gone.people.select("id")) == [(1,), (2,)] and rows(gone.groups.where("avatar_face_id IS NOT NULL")) == []
    back = decisions.without_items(new, 1, [400, 100, 200])
    assert rows(back.items) == [(6, 201)] and rows(decisions.without_items(new, 2, [400]).items) == rows(new.items)
    merged = decisions.merged(new, 3, 1)
    assert {g for g, _ in rows(merged.items)} == {5} and len(rows(merged.items)) == 2


def test_best_faces_with_many_targets(spark):
    g = np.random.default_rng(6)
    t, c = g.normal(size=(2500, 8)), g.normal(size=(40, 8))
    targets = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "face_id long, embedding array<double>")
    asked = spark.createDataFrame([(i % 7, i, v.tolist()) for i, v in enumerate(c)], "file_id long, face_id long, embedding array<double>")
    best = (c @ t.T).max(1)
    want = {f: max((round(float(best[i]), 6), -i) for i in range(40) if i % 7 == f) for f in range(7)}
    got = {r["file_id"]: (round(r["score"], 6), -r["face_id"]) for r in people.best_by_file(asked, targets).collect()}
    assert got == want
    assert [r["suggested"] for r in people.best_by_file(asked.limit(1), targets.limit(1)).collect()] == [False]
    assert people.best_by_file(asked, targets.limit(0)).count() == 0


def test_listing_and_code_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jpg").write_bytes(b"12345")
    (tmp_path / "y.txt").write_bytes(b"0")
    (tmp_path / "empty.txt").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: r["length"] for r in tables.listing(spark, str(tmp_path)).collect()}
    assert got == {"x.jpg": 5, "y.txt": 1} and tables.listing(spark, str(tmp_path), "*.jpg").count() == 1
    (tmp_path / "c.csv").write_text("﻿id;iso2;population\n1; nl ;17000000\nxx;;oops\n;;5\n", encoding="utf-8")
    assert rows(tables.populations(spark, str(tmp_path / "c.csv"))) == [("NL", 17000000), ("XX", 0)]
    names = spark.createDataFrame([("nl",), ("Zz",), (None,)], "c string").select(tables.code_names({"NL": "Nederland"}, F.col("c")))
    assert [r[0] for r in names.collect()] == ["Nederland", None, None]


def test_a_text_query_uses_the_embedder_and_an_order_by_chance_its_seed(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "file_id long, embedding array<double>")
    files = spark.createDataFrame([(1,), (3,)], "id long")
    got = search.text_query(vectors, files, "up", lambda t: [0.0, float(len(t))])
    assert [tuple(r) for r in got.collect()] == [(3, 0.8)]
    many = spark.range(200).withColumn("media_id", F.col("id"))
    order = lambda seed: [r["id"] for r in ordering.page(many, ordering.SortSpec("random", seed=seed)).collect()]
    assert order(1) == order(1) != order(2) and sorted(order(3)) == list(range(200))


def test_boxes_as_values(spark):
    df = spark.createDataFrame([([[0, 65535, 1, 2, 3, 4, 5, 6], [7] * 8], "a\nb"), ([], None), (None, "x")], "b array<array<int>>, t string")
    got = df.select(C.box_values(C.ocr_boxes("b", "t")).alias("v")).collect()
    assert [r["v"] for r in got] == [[[0, 65535, 1, 2, 3, 4, 5, 6], [7] * 8], [], None]


def _with_table(spark, sf, folder, name, rows):
    """The tables of sf with another one in the place of `name`."""
    for t in os.listdir(sf):
        if t != f"{name}.parquet":
            os.symlink(f"{sf}/{t}", f"{folder}/{t}")
    rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _same_as_sql(spark, folder, name):
    names, rows = oracle.rows_of_duck(oracle.connect(folder), registry.ORACLE[name])
    got = registry.QUERIES[name](spark, folder)
    assert names == sorted(got.columns) and rows and oracle.rows_of_spark(got) == rows


def test_ingest_pending_where_paths_of_orders_repeat(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey < 50")
    both = orders.unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + 1_110_200))
    _same_as_sql(spark, _with_table(spark, sf, tmp_path, "orders", both), "ingest_pending")


def test_milestone_report_beyond_two_million(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    far = orders.unionByName(orders.where("o_orderkey < 200").withColumn("o_orderkey", F.col("o_orderkey") * 1000 + 2_600_000))
    _same_as_sql(spark, _with_table(spark, sf, tmp_path, "orders", far), "milestone_report")


def test_milestone_report_goes_on_beyond_two_million(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey < 200")
    folder = _with_table(spark, sf, tmp_path, "orders", orders.withColumn("o_orderkey", F.col("o_orderkey") + 2_600_000))
    got = [(r["milestone"], r["reached"]) for r in registry.QUERIES["milestone_report"](spark, folder).orderBy("milestone").collect()]
    assert got[-16:] == [(m, m <= 2_600_000) for m in range(1_900_000, 3_400_001, 100_000)]
    _same_as_sql(spark, folder, "milestone_report")


def test_camera_milestones_go_on_beyond_two_million(spark, sf, tmp_path):
    """11 of 13 files count; each key is one file."""
    one = spark.read.parquet(f"{sf}/orders.parquet").limit(1)
    folder = _with_table(spark, sf, tmp_path, "orders", one.drop("o_orderkey").crossJoin(spark.range(2_600_000).withColumnRenamed("id", "o_orderkey")))
    got = [(r["milestone"], r["reached"]) for r in registry.QUERIES["milestone_report_camera"](spark, folder).orderBy("milestone").collect()]
    assert got[-11:] == [(m, m <= 2_200_000) for m in range(2_000_000, 3_000_001, 100_000)]
    _same_as_sql(spark, folder, "milestone_report_camera")


def test_as_many_milestones_as_asked_for_lie_ahead(spark, sf):
    for n in (0, 999, 1_000_000, 2_000_000):
        assert len(stats.upcoming(n, None, 0, 60)) == 60 and stats.upcoming(n, None, 0) == [(m, None) for m in stats.ladder(n) if m > n][:8]
    got = stats.milestone_report(standins.files(spark, sf), upkeep.NOW, ahead=60).where("NOT reached")
    assert got.count() == 60


def test_camera_milestones_by_given_steps(spark, sf):
    files = standins.files(spark, sf)
    got = stats.milestone_report(files, upkeep.NOW, skip_screens=True, steps=[10, 20, 30, 10**7]).orderBy("milestone").collect()
    assert [(r["milestone"], r["reached"], r["id"] is not None) for r in got] == [(10, True, True), (20, True, True), (30, True, True), (10**7, False, False)]
    assert [m for m in upkeep.STEPS if m > 1_000_000] == list(range(1_100_000, 2_000_001, 100_000))


def test_alignment_is_that_of_sql_where_points_are_one_and_zeros_have_a_sign(spark, sf, tmp_path):
    """A vector of equal numbers puts all points of a box at one place; the last one has a box whose a lies just below zero."""
    v = np.random.default_rng(18750).normal(size=64)
    rows = [(1, [0.2] * 64), (2, [0.125] * 64), (3, [1.0] * 64), (18750, (v / np.linalg.norm(v)).astype("float32").tolist())]
    vectors = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, label int")
    folder = _with_table(spark, sf, tmp_path, "embeddings", vectors)
    names, want = oracle.rows_of_duck(oracle.connect(folder), registry.ORACLE["face_alignment"])
    got = registry.QUERIES["face_alignment"](spark, folder)
    assert names == sorted(got.columns) and any("-0.0" in repr(r) for r in want) and any("inf" in repr(r) for r in want)
    assert repr(oracle.rows_of_spark(got)) == repr(want)


def test_alignment_is_that_of_sql_where_numbers_are_missing(spark, sf, tmp_path):
    """Sums are of the coordinates that are there; none is left where a vector has only its first numbers, and no box where it has none."""
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=64) / 8], 0) for i in range(1, 9)]
    rows = [(i, [None if i < 6 and k in (i, i * 7 % 64) else x for k, x in enumerate(v)][: 64 if i < 7 else 40 - 5 * (i - 7)], 0) for i, v, _ in rows] + [(9, None, 0), (10, [], 0), (11, [None] * 64, 0)]
    folder = _with_table(spark, sf, tmp_path, "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    _same_as_sql(spark, folder, "face_alignment")


def test_rounding_is_that_of_sql(spark):
    values = [-1e-9, 1e-9, -0.0, 0.0, -4.9e-7, -5e-7, 5e-7, 0.0000015, -0.0000025, 1.0000005, -2.5, 123456.7890125, 1e12 / 3, float("inf"), float("-inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(upkeep._rounded(F.col("x"), 6)).collect()]
    want = [oracle.duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in values]
    assert [repr(x) for x in got] == [repr(x) for x in want] and repr(got[0]) == "-0.0"


def test_sessions_by_whole_seconds(spark, sf, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00.2"), (2, 1, "2024-01-01 01:00:00.9"), (3, 1, "2024-01-01 02:00:00.1"), (4, 1, "2024-01-01 03:00:01.0"), (5, 2, "2024-01-01 00:00:00.9"), (6, 2, "2024-01-01 01:00:01.0")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    _same_as_sql(spark, _with_table(spark, sf, tmp_path, "events", events), "session_window_batch")


def test_retries_broadcast_no_attempts(spark):
    attempts = spark.range(1, 2).selectExpr("id AS file_id", "'v' AS model_version", "'done' AS state", "1 AS attempts", "CAST(NULL AS STRING) AS error", "CAST(NULL AS BIGINT) AS next_at")
    results = spark.range(1, 3).selectExpr("id AS file_id", "'ok' AS outcome", "CAST(NULL AS STRING) AS error")
    for df in (retries.due(spark.range(3), attempts, "v", 0), retries.recorded(attempts, results, "v", 0)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in retries.due(spark.range(3), attempts, "v", 0).collect()} == {0, 2}


def test_best_face_by_file_in_many_blocks(spark):
    """Blocks of few faces give what one loop over all pairs does: copies, faces of other lengths, without a vector or with no number in it."""
    rng = np.random.default_rng(3)
    vectors = [*rng.normal(size=(60, 7)).tolist(), *[[1.0, 0.5] * 3] * 25, [2.0, 1.0], None, [float("nan"), 0.0]]
    faces = [(200 - k, k % 9 if v and v[0] == v[0] else 20 + k % 2, v) for k, v in enumerate(vectors)]
    want: dict = {}
    targets = [(i, v) for i, _, v in faces if i % 3 == 1]
    for i, file, v in faces:
        scores = [functools.reduce(lambda s, p: s + p[0] * p[1], zip(v, w), 0.0) for _, w in targets if v and w]
        key = (1, 0.0) if scores and scores[0] != scores[0] else (0, max(scores)) if scores else (-1, 0.0)
        want[file] = max(want.get(file, ((-2, 0.0), 0)), (key, -i))
    df = spark.createDataFrame(faces, "face_id long, file_id long, embedding array<double>")
    for block in (10, None):
        got = {r["file_id"]: r for r in people.best_by_file(df, df.where("face_id % 3 = 1"), block=block).collect()}
        assert {f: r["face_id"] for f, r in got.items()} == {f: -i for f, (_, i) in want.items()}
        assert all(got[f]["score"] == key[1] for f, (key, _) in want.items() if key[0] == 0)
    assert people.best_by_file(df, df.where("false")).count() == 0


def test_lists_are_put_together_in_stretches(spark):
    """A long list keeps its order, repeats and nulls, and no aggregation gathers a whole list's items."""
    from prismlake.operators import curation

    n = curation.STRETCH * 2 + 7
    ids = [(k * 7919) % n for k in range(n)] + [None, 3, 3]
    lists = spark.createDataFrame([(1, json.dumps(ids)), (2, "[5]"), (3, "[]"), (4, "x")], "id long, media_ids string")
    files = spark.range(n).selectExpr("id", "'p' AS path", "'f' AS folder_path")
    left = curation.removed(files, files.where("id % 5 = 0").select("id"), {"tags": lists}, {})["tags"]
    kept = [k for k in ids if k is None or k % 5]
    assert {r["id"]: r["media_ids"] for r in left.collect()} == {1: json.dumps(kept, separators=(",", ":")), 2: "[]", 3: "[]", 4: "[]"}
