"""Runs of equal size under a hot time, milestones as a report, the removal of faces in one cascade, regions of a map."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import curation, media, recognition, sessions, stats

WEEK = 7 * 86400


@pytest.fixture
def many_parts(spark):
    """Small inputs would come as one part otherwise."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_a_hot_second_is_spread_over_runs(spark, many_parts):
    rows = spark.range(0, 40_000, 1, 8).select(F.col("id"), F.when(F.col("id") % 3 != 0, 0).otherwise(F.col("id") * 7 % 90_001).alias("t"))
    cut = sessions.even_runs(rows, ["t", "id"])
    sizes = [r["n"] for r in cut.groupBy("_run").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 40_000 and len(sizes) > 1 and max(sizes) < 20_000  # the second 0 alone has 26,666 rows
    ends = sorted((r["_run"], tuple(r["a"]), tuple(r["b"])) for r in cut.groupBy("_run").agg(F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("b")).collect())
    assert all(x[2] < y[1] for x, y in zip(ends, ends[1:], strict=False))


def test_sessions_and_numbers_of_a_hot_day_equal_a_loop(spark, many_parts):
    events = [(i, 5 if i % 3 else (i * 7919) % 50_000) for i in range(3000)] + [(9000, None)]
    df = spark.createDataFrame(events, "id long, epoch long")
    want, last, n = {}, None, 0
    for t, i in sorted((t, i) for i, t in events if t is not None):
        n += last is None or t - last > 40
        want[i], last = n, t
    assert {r["id"]: r["session"] for r in sessions.gap_sessions(df, "epoch", 40, "id").collect()} == want
    files = df.select("id", F.col("epoch").alias("create_date"), F.lit(None).cast("long").alias("created"), F.lit(None).cast("long").alias("modified"))
    order = sorted(events, key=lambda e: (e[1] is not None, e[1] or 0, e[0]))
    assert {r["id"]: r["media_id"] for r in media.renumbered(files).collect()} == {i: k for k, (i, _) in enumerate(order, 1)}


def test_weeks_go_on_to_the_last_event_and_to_now(spark):
    times = spark.createDataFrame([(5 * WEEK + 1,), (9 * WEEK,), (None,)], "epoch long")
    assert [tuple(r) for r in stats.weekly(times, 7 * WEEK).orderBy("week").collect()] == [(5, 1), (6, 0), (7, 0), (8, 0), (9, 1)]
    assert [r["n"] for r in stats.weekly(times, 10 * WEEK).orderBy("week").collect()] == [1, 0, 0, 0, 1, 0]


def _files(spark, n, step=1):
    null = F.lit(None).cast("long")
    return spark.range(1, n + 1).select(
        "id", (F.col("id") * step).alias("media_id"), F.lit(None).cast("timestamp_ntz").alias("create_date_local"), (F.col("id") * 3600).alias("create_date"),
        null.alias("created"), null.alias("modified"), F.when(F.col("id") % 5 == 0, "screenshot").when(F.col("id") % 5 == 1, " ").otherwise("camera").alias("capture_type"),
    )


def test_milestones_as_a_report(spark):
    now = 10 * 86400
    got = stats.milestone_report(_files(spark, 1500), now).orderBy("milestone").collect()
    assert [(r["milestone"], r["base"], r["reached"], r["id"]) for r in got[:2]] == [(1000, 1500, True, 1000), (10_000, 1500, False, None)]
    assert str(got[0]["ts"]) == "1970-02-11 16:00:00" and len(got) == 9 and all(r["predicted"] > now for r in got[1:])
    # 168 files a week from the first on
    mean = None
    for k in range(9):
        n = sum(k * WEEK <= i * 3600 < (k + 1) * WEEK for i in range(1, 1501))
        mean = n if mean is None else 0.8 * mean + 0.2 * min(n, 3 * mean)
    assert abs(got[1]["predicted"] - (now + 8500 / (mean / 7) * 86400)) <= 1
    # of camera files the thousandth by media_id, though ids have gaps
    camera = stats.milestone_report(_files(spark, 1500, 7), now, skip_screens=True).orderBy("milestone").first()
    assert (camera["milestone"], camera["base"], camera["id"]) == (1000, 1200, [i for i in range(1, 1501) if i % 5][999])
    # no file has that very number
    gap = stats.milestone_report(_files(spark, 1500, 7), now).orderBy("milestone").first()
    assert (gap["base"], gap["reached"], gap["id"]) == (10_500, True, None)


def test_milestones_without_growth_or_files(spark):
    assert stats.milestone_report(_files(spark, 10).where("id < 0"), 0).count() == 0
    one = stats.milestone_report(_files(spark, 1), 86400).orderBy("milestone").collect()
    assert len(one) == 8 and all(r["predicted"] is None and not r["reached"] for r in one)


def test_faces_go_with_all_that_hangs_on_them(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    tables = {
        "faces": t([(1, 10, 0.9), (2, 10, 0.5), (3, 11, None), (4, 11, 0.4), (5, 12, 0.4), (6, 13, 0.8)], "id long, file_id long, recognition_quality double"),
        "assignments": t([(1, 1), (3, 1), (4, 1), (5, 1), (2, 2), (6, 3)], "face_id long, person_id long"),
        "people": t([(1, "a", 1), (2, "b", 2), (3, "c", 5), (4, "d", None)], "id long, name string, cover_face_id long"),
        "representatives": t([(1, 1), (4, 1)], "face_id long, person_id long"),
        "suggestions": t([(1, 4), (4, 2), (4, 6), (5, None)], "face_id long, candidate_face_id long"),
        "members": t([(7, 1), (7, 5)], "manual_person_id long, face_id long"),
        "ignored": t([(2,), (6,)], "face_id long"),
        "scans": t([(10, "v"), (11, "v")], "file_id long, version string"),
        "items": t([(7, 10), (7, 13)], "manual_person_id long, file_id long"),
    }
    out = curation.faces_removed(tables, t([(10,), (10,), (99,)], "id long"))
    rows = {n: sorted(map(tuple, df.collect()), key=str) for n, df in out.items()}
    # person 1 lost the cover: 4 and 5 are equally good, 3 has no quality; 3's cover is another one's face, which is left as it is; 2 has no face any more, 4 never had
    assert rows["people"] == [(1, "a", 4), (3, "c", 5)]
    assert rows["assignments"] == [(3, 1), (4, 1), (5, 1), (6, 3)] and [r[0] for r in rows["faces"]] == [3, 4, 5, 6]
    assert rows["suggestions"] == [(4, 6), (5, None)] and rows["representatives"] == [(4, 1)] and rows["members"] == [(7, 5)]
    assert rows["ignored"] == [(6,)] and rows["scans"] == [(11, "v")] and rows["items"] == [(7, 13)]
    # nothing removed: covers that are null are still filled
    same = curation.faces_removed({k: tables[k] for k in ("faces", "assignments", "people")}, t([], "id long"))
    assert set(same) == {"faces", "assignments", "people"} and sorted(map(tuple, same["people"].collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 5)]


def _flooded(values):
    """Regions by a plain flood fill."""
    h, w = values.shape
    seen, out = set(), []
    for y0 in range(h):
        for x0 in range(w):
            if values[y0, x0] < 0.3 or (y0, x0) in seen:
                continue
            seen.add((y0, x0))
            area = [(y0, x0)]
            for y, x in area:
                for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= a < h and 0 <= b < w and values[a, b] >= 0.3 and (a, b) not in seen:
                        seen.add((a, b))
                        area.append((a, b))
            ys, xs = [p[0] for p in area], [p[1] for p in area]
            if len(area) >= 8 and max(xs) - min(xs) >= 2 and max(ys) - min(ys) >= 2:
                out.append((max(min(xs) - 2, 0), max(min(ys) - 2, 0), min(max(xs) + 2, w - 1), min(max(ys) + 2, h - 1)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.62, 0.9, 1.0])
def test_regions_equal_a_flood_fill(share):
    draw = np.random.default_rng(int(share * 100))
    for h, w in ((1, 1), (1, 40), (40, 1), (3, 3), (25, 31), (60, 44)):
        values = (draw.random((h, w)) < share).astype(float)
        assert sorted(recognition._regions(values)) == _flooded(values)


def test_a_winding_region_is_one():
    values = np.zeros((41, 41))
    values[::2] = 1
    values[1::4, -1] = values[3::4, 0] = 1  # a snake through all rows
    assert recognition._regions(values) == _flooded(values) == [(0, 0, 40, 40)]
