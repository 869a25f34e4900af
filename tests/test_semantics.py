"""Odd values: nulls, ties, edges and empty tables of the media operators."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import columns as C
from prismlake.operators import clustering, curation, decisions, lookups, media, ordering, people, places, search, sessions, stats
from prismlake.operators.filters import FilterSpec, ViewOptions, apply_filters, for_search, milestone_capture, person_query, place_search
from prismlake.streaming import incremental

FILES = "id long, media_id long, filename string, path string, folder_path string, extension string, file_type string, size long, created long, modified long, create_date long, create_date_local timestamp_ntz, capture_type string, device_model string, camera_make string, camera_model string, lens_model string, focal_length double, iso int, aperture double, width int, height int, megapixels double, latitude double, longitude double, altitude double, country string, thumbnail_path string"
NAMES = [x.split()[0] for x in FILES.split(", ")]


def files(spark, *rows):
    return spark.createDataFrame([tuple({"media_id": r["id"], "file_type": "image"}.get(n) if n not in r else r[n] for n in NAMES) for r in rows], FILES)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_capture_time_falls_back_and_is_null_if_one_of_two_is_missing(spark):
    t = datetime.datetime(2020, 5, 1, 12)
    df = files(spark, {"id": 1, "create_date_local": t, "create_date": 0}, {"id": 2, "create_date": 86400}, {"id": 3, "created": 172800, "modified": 90000}, {"id": 4, "created": 5}, {"id": 5})
    got = {r["id"]: r["ts"] for r in df.select("id", C.capture_ts().alias("ts")).collect()}
    assert got == {1: t, 2: datetime.datetime(1970, 1, 2), 3: datetime.datetime(1970, 1, 2, 1), 4: None, 5: None}
    assert ids(apply_filters(df)) == [1, 2, 3, 4]
    assert ids(apply_filters(df, FilterSpec(), ViewOptions(allow_undated=True))) == [1, 2, 3, 4, 5]
    zoned = files(spark, {"id": 2, "create_date": 86400}).select(C.capture_ts("Europe/Amsterdam").alias("t")).first()["t"]
    assert zoned == datetime.datetime(1970, 1, 2, 1)


def test_ids_filter_null_empty_and_none(spark):
    df = files(spark, {"id": 1, "created": 1, "modified": 1}, {"id": 2, "created": 1, "modified": 1})
    assert ids(apply_filters(df, FilterSpec(ids=()))) == [1, 2]
    assert ids(apply_filters(df, FilterSpec(ids=(-1,)))) == []
    assert for_search(FilterSpec(ids=(1,), search_by="name", search_term="x")) == FilterSpec()
    assert [r["id"] for r in ordering.by_relevance(df.select("id"), [2, 9, 1]).collect()] == [2, 1]


def test_null_capture_type_and_folder(spark):
    df = files(spark, {"id": 1, "created": 1, "folder_path": "/a"}, {"id": 2, "created": 1, "capture_type": "screenshot", "folder_path": "/b"}, {"id": 3, "created": 1, "capture_type": " ", "folder_path": None})
    assert ids(apply_filters(df, FilterSpec(), ViewOptions(exclude_screen_captures=True))) == [1, 3]
    assert ids(apply_filters(df, FilterSpec(), ViewOptions(hidden_folders=("/b",)))) == [1]
    assert ids(df.where(milestone_capture())) == [1, 3]


def test_age_around_birthdays(spark):
    rows = [{"id": i, "create_date_local": datetime.datetime(*d)} for i, d in enumerate([(2021, 2, 28), (2021, 3, 1), (2020, 2, 29)])]
    got = {r["id"]: r["a"] for r in files(spark, *rows).select("id", C.age_on(C.capture_date(), "2000-02-29").alias("a")).collect()}
    assert got == {0: 20, 1: 21, 2: 20}


def test_aspect_and_file_names(spark):
    df = files(spark, {"id": 1, "width": 4, "height": 0}, {"id": 2, "width": None, "height": 3}, {"id": 3, "width": 13, "height": 10})
    assert [r[0] for r in df.orderBy("id").select(C.aspect_distance()).collect()] == [None, None, 0.0]
    names = ["IMG_20230101_000507.jpg", "a_20231301_000000.jpg", "a_20230101_240000.jpg", "x_20230231_101010.png", "none.jpg", None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string").orderBy("i").select(C.filename_datetime("p")).collect()]
    assert got == ["2023-01-01 00:05:07", None, None, "2023-02-31 10:10:10", None, None]


def test_capture_kinds(spark):
    rows = [
        {"id": 1, "path": "/DCIM/x.jpg"}, {"id": 2, "path": "/Screenshots/x.png"}, {"id": 3, "path": "/Camera & Screenshots/x.png"}, {"id": 4, "path": "/v/Screen Recording 1.mp4", "file_type": "video"},
        {"id": 5, "path": "a.png"}, {"id": 6, "path": "screencast1.mp4", "file_type": "video"}, {"id": 7, "path": "b.jpg"}, {"id": 8, "path": "/Camera & Screenshots/x.jpg"}, {"id": 9, "path": "/x/y.gif"},
        {"id": 10, "path": "/x/y.gif", "iso": 100, "aperture": 2.8}, {"id": 11, "path": "/x/y.pdf", "file_type": "other", "iso": 1, "aperture": 2.0}, {"id": 12, "path": "/x/y.png", "iso": 100, "aperture": 2.8, "lens_model": "L"},
        {"id": 13, "path": "/dcim/y.png", "iso": 100, "aperture": 2.8}, {"id": 14, "path": None}, {"id": 15, "path": "/v.mp4", "file_type": "video", "latitude": 1.0, "longitude": 2.0}, {"id": 16, "path": "/shot.jpg"},
    ]
    df = files(spark, *rows).withColumn("exposure_time", F.lit(None).cast("string")).withColumn("software", F.when(F.col("id") == 16, "Snipping Tool").otherwise(""))
    got = {r["id"]: r["capture_type"] for r in media.reclassified(df).collect()}
    assert got == {1: "camera", 2: "screenshot", 3: "screenshot", 4: "screen_recording", 5: "screenshot", 6: "screen_recording", 7: "camera", 8: "camera", 9: "unknown", 10: "camera", 11: "unknown", 12: "screenshot", 13: "camera", 14: "unknown", 15: "camera", 16: "screenshot"}


def test_gap_of_exactly_the_limit_goes_on(spark):
    rows = spark.createDataFrame([(1, 0), (2, 345600), (3, 691201), (4, 691201)], "id long, epoch long")
    got = {r["id"]: r["session"] for r in sessions.gap_sessions(rows, "epoch", 345600, "id", run_seconds=100_000).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}


def test_sessions_across_runs_equal_a_loop(spark):
    rnd = random.Random(5)
    events = [(i, rnd.randrange(100_000)) for i in range(300)]
    got = {r["id"]: r["session"] for r in sessions.gap_sessions(spark.createDataFrame(events, "id long, epoch long"), "epoch", 250, "id", run_seconds=700).collect()}
    n, last, want = 0, None, {}
    for i, t in sorted(events, key=lambda x: (x[1], x[0])):
        n += last is None or t - last > 250
        want[i], last = n, t
    assert got == want


def test_place_visits_keep_several_open_and_equal_a_loop(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(40), sorted(rnd.sample("ABC", rnd.randint(0, 2)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, epoch long, places array<string>")
    got = sorted((r["place"], r["segment"], r["n"]) for r in sessions.visits(df, F.col("places"), ["epoch", "id"], F.floor(F.col("epoch") / 7)).collect())
    want, before, number = {}, set(), {}
    for _, _, here in sorted(((t, i, p) for i, t, p in rows), key=lambda x: x[:2]):
        for p in here:
            if p not in before:
                number[p] = number.get(p, 0) + 1
            want[p, number[p]] = want.get((p, number[p]), 0) + 1
        before = set(here)
    assert got == sorted((p, s, n) for (p, s), n in want.items())


def test_trips_need_enough_rows_and_shares(spark):
    at = lambda d: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=d)
    rows = [{"id": i, "country": "NL", "create_date_local": at(i)} for i in range(20)]
    rows += [{"id": 100 + i, "country": "FR" if i else "be, fr", "create_date_local": at(2 + i / 10)} for i in range(5)]
    rows += [{"id": 200 + i, "country": "DE", "create_date_local": at(12)} for i in range(3)]
    got = sessions.trips(files(spark, *rows), sessions.TripOptions(min_items=4)).collect()
    assert [(r["n"], r["main_countries"], r["title"]) for r in got] == [(5, ["FR", "BE"], "FR – BE 2020")]


def test_routes_break_and_drop_single_points(spark):
    p = lambda i, lat, alt=0.0, c="NL": {"id": i, "latitude": lat, "longitude": 0.0, "altitude": alt, "country": c}
    df = files(spark, p(1, 0.0), p(2, 1.7), p(3, 3.6), p(4, 10.0), p(5, 10.1, 1501.0), p(6, 10.1, None), p(7, 10.1, 0.0, ""))
    assert [(r["line"], r["id"]) for r in sessions.route_lines(df).orderBy("id").collect()] == [(1, 1), (1, 2)]


def test_growth_is_capped_and_forecast_waits(spark):
    w = spark.createDataFrame([(0, 10), (1, 1000), (2, 0)], "week long, n long")
    m = 10 * 0.8 + 0.2 * 30
    assert abs(stats.growth(w).first()["weekly"] - m * 0.8) < 1e-9
    assert stats.ladder(0)[:9] == [1_000, 10_000, 25_000, 50_000, 75_000, 100_000, 150_000, 200_000, 250_000]
    assert stats.upcoming(999, None, 0)[0] == (1000, None)
    assert stats.growth(w.where("n < 0")).first()["weekly"] is None


def test_vector_search_zero_vectors_threshold_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [0.2, 0.9797959])], "file_id long, embedding array<float>")
    got = search.vector_topk(v, [1.0, 0.0], 2)
    assert [r["file_id"] for r in got.collect()] == [1, 3]
    assert [r["file_id"] for r in search.similar_to(v, 1, threshold=0.0).collect()][0] == 3


def test_typos_one_edit_only(spark):
    rows = spark.createDataFrame([(1, "a house there"), (2, "a hous there"), (3, "a hosue there"), (4, "HOUSES"), (5, None), (6, "")], "file_id long, text string")
    assert sorted(r["file_id"] for r in search.typo_hits(rows, "house cat").collect()) == [1, 2, 4]
    assert search.typo_hits(rows, "cat").count() == 0
    assert search.query_terms("ﬁne  a-b_c!") == ["fine", "ab_c"]
    assert search.text_search(rows, "HOUSE", 10).collect()[0]["label"] == "Text match"


def test_polygons_with_holes_and_smart_choice(spark):
    square = lambda a, b: [{"lon": a, "lat": a}, {"lon": b, "lat": a}, {"lon": b, "lat": b}, {"lon": a, "lat": b}]
    schema = "id long, local_name string, english_name string, country string, region string, subtype string, admin_level int, area double, min_lon double, max_lon double, min_lat double, max_lat double, geometry array<array<array<struct<lon: double, lat: double>>>>"
    loc = spark.createDataFrame([
        (1, "Stad", None, "NL", "NH", "locality", 3, 1.0, 0.0, 4.0, 0.0, 4.0, [[square(0.0, 4.0), square(1.0, 2.0)]]),
        (2, "Graafschap", "County", "NL", "NH", "county", 2, 5.0, 0.0, 4.0, 0.0, 4.0, [[square(0.0, 4.0)]]),
        (3, "Klein", None, "NL", "NH", "locality", 3, 0.5, 3.0, 4.0, 3.0, 4.0, [[square(3.0, 4.0)]]),
    ], schema)
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 9.0, 9.0), (4, 91.0, 0.0), (5, 3.5, 3.5)], "file_id long, latitude double, longitude double")
    cells = places.cells_of(loc)
    small = {r["file_id"]: r["i"] for r in places.resolve(pts, cells, loc, "smallest").select("file_id", F.col("place.locality_id").alias("i")).collect()}
    assert small == {1: 1, 2: 2, 3: None, 4: None, 5: 3}
    smart = {r["file_id"]: r["i"] for r in places.resolve(pts, cells, loc).select("file_id", F.col("place.locality_id").alias("i")).collect()}
    assert smart == {1: 2, 2: 2, 3: None, 4: None, 5: 2}
    edge = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (0.0, 0.1)], "a double, o double").select(C.grid_cell(F.col("a"), F.col("o")).alias("c"))
    assert [r["c"] for r in edge.collect()] == [1799 * 3600 + 3599, 0, 900 * 3600 + 1801]


def test_leaders_follow_thresholds_and_groups(spark):
    v = lambda x: [x, float(np.sqrt(1 - x * x))]
    rows = [(1, 1.0, v(1.0), None), (2, 0.9, v(0.71), None), (3, 0.8, v(0.6), None), (4, 0.7, v(-1.0), 7), (5, 0.6, v(1.0), 7), (6, 0.5, None, None)]
    df = spark.createDataFrame(rows, "face_id long, quality double, embedding array<double>, group_id long")
    got = {r["face_id"]: (r["leader"], r["suggested"]) for r in clustering.leaders(df).collect()}
    assert got[4][0] == got[5][0] == 4 and 6 not in got
    assert got[2][0] == got[1][0]
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 20.0, 0.0, 5.0, 5.0, 0.7)], "file_id long, box_id long, x double, y double, w double, h double, score double")
    assert sorted(r["box_id"] for r in clustering.kept_boxes(boxes).collect()) == [1, 3]


def test_leaders_by_component_equal_one_fold(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(clustering, "BLOCK", 40)
    g = np.random.default_rng(4)
    centre = g.normal(size=(12, 16))
    x = centre[g.integers(0, 12, 260)] + g.normal(size=(260, 16)) * 0.55
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [(i, float(g.integers(0, 50)), v.tolist(), int(g.integers(0, 8)) if g.random() < 0.1 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "face_id long, quality double, embedding array<double>, group_id long")
    pdf = pd.DataFrame(data, columns=["face_id", "quality", "embedding", "group_id"]).assign(block=0, free=lambda d: d["group_id"].isna(), hidden=False, old=False, person_id=0)
    pdf = pdf.sort_values(["free", "quality", "face_id"], ascending=[True, False, True], ignore_index=True)
    want = {r.face_id: (r.leader, round(r.score, 9), None if pd.isna(r.suggested) else r.suggested) for r in next(clustering._fold(iter([pdf]))).itertuples()}
    got = {r["face_id"]: (r["leader"], round(r["score"], 9), r["suggested"]) for r in clustering.leaders(df).collect()}
    assert got == want and 5 < len({v[0] for v in want.values()}) < 200
    s = x @ x.T
    pairs = {(r["a"], r["b"]) for r in clustering.similar_pairs(df, block=40).collect()}
    assert pairs == {(i, j) for i in range(260) for j in range(i + 1, 260) if s[i, j] >= clustering.SUGGEST}
    assert clustering.leaders(df.limit(0)).count() == 0


def test_tags_memories_and_removal(spark):
    tags = spark.createDataFrame([(1, "a", "[3,1]", 5), (2, "b", "[]", 6), (3, "c", None, 7)], "id long, name string, media_ids string, last_used long")
    one = lambda df, i: [r["media_ids"] for r in df.where(F.col("id") == i).collect()][0]
    assert one(curation.with_item(tags, 1, 2, 99), 1) == "[3,1,2]" and one(curation.with_item(tags, 1, 3), 1) == "[3,1]"
    assert one(curation.without_item(tags, 1, 3), 1) == "[1]" and one(curation.with_item(tags, 3, 8), 3) == "[8]"
    f = files(spark, {"id": 1, "path": "/a/1", "folder_path": "/a"}, {"id": 3, "path": "/b/3", "folder_path": "/b"})
    out = curation.removed(f, curation.folder_files(f, "/b"), {"tags": tags}, {"ocr": spark.createDataFrame([(3,), (1,)], "file_id long")})
    assert ids(out["files"]) == [1] and one(out["tags"], 1) == "[1]" and out["ocr"].count() == 1 and out["tombstones"].count() == 1
    m, apart = curation.merged_groups(spark.createDataFrame([(5, 1), (6, 2), (6, 1)], "manual_person_id long, face_id long"), spark.createDataFrame([(5, 6), (6, 9)], "left_manual_person_id long, right_manual_person_id long"), [5, 6])
    assert sorted(map(tuple, m.collect())) == [(5, 1), (5, 2)] and [tuple(r) for r in apart.collect()] == [(5, 9)]


def test_people_pages_keep_their_total(spark):
    p = spark.createDataFrame([(1, "Ann", None, 0), (2, None, None, 0), (3, "Bo", None, 1)], "id long, name string, cover_face_id long, hidden int")
    faces = spark.createDataFrame([(1, 10, 0.5), (2, 10, 0.9), (3, 11, 0.1)], "id long, file_id long, recognition_quality double")
    own = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "face_id long, person_id long")
    counted = people.counts(p, people.person_files(own, faces), own)
    assert [(r["id"], r["item_count"], r["face_count"], r["total"]) for r in people.page(counted, limit=1).collect()] == [(1, 1, 2, 2)]
    assert people.page(counted, offset=5).count() == 0
    assert {r["id"]: r["cover_face_id"] for r in people.covers(p, own, faces).collect()} == {1: 2, 2: 3, 3: None}
    assert p.where(person_query("2")).count() == 1 and p.where(person_query("")).count() == 3


def test_enrichment_is_idempotent_and_fails_once(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([(1, "x", "v1"), (2, "y", "v2")], "file_id long, text string, model_version string")
    run = lambda d: incremental.enriched(rows, d, lambda t: t.where("id <> 3").select(F.col("id").alias("file_id"), F.lit("z").alias("text")), "v2")
    once = run(done)
    want = [(1, "z", "v2"), (2, "y", "v2"), (3, None, "v2")]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, run(once).collect())) == want


def test_stream_enriches_each_file_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(src)
    for _ in range(2):
        q = incremental.follow(spark, src, "id long", lambda df: df.select(F.col("id").alias("file_id")), out, str(tmp_path / "cp"))
        q.awaitTermination(120)
        spark.range(3, 5).write.mode("append").parquet(src)
    assert sorted(r["file_id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_empty_tables(spark):
    none = files(spark).limit(0)
    assert stats.totals(none).first()["n"] == 0 and stats.streaks(stats.by_day(none)).count() == 0
    assert sessions.trips(none).count() == 0 and sessions.route_lines(none).count() == 0 and media.renumbered(none).count() == 0
    assert stats.milestones(none).count() == 0 and stats.year_range(none).count() == 0
    assert place_search_hits(spark) == ["Málaga"]


def place_search_hits(spark):
    df = spark.createDataFrame([("Málaga",), ("Oslo",), (None,)], "city string")
    return [r["city"] for r in df.where(place_search("malaga", ["city"])).collect()]


def state(spark):
    people_ = spark.createDataFrame([(1, "a", 10, False), (2, "b", 20, True), (3, "c", 30, False)], "id long, name string, cover_face_id long, hidden boolean")
    assigned = spark.createDataFrame([(10, 1, "auto"), (11, 1, "auto"), (20, 2, "auto"), (21, 2, "auto"), (30, 3, "auto")], "face_id long, person_id long, assigned_by string")
    groups = spark.createDataFrame([(1, None, None), (2, "two", 11)], "id long, name string, avatar_face_id long")
    members = spark.createDataFrame([(1, 10), (2, 11)], "manual_person_id long, face_id long")
    return decisions.State(people_, assigned, groups, members, spark.createDataFrame([], "manual_person_id long"), spark.createDataFrame([(1, 9)], "left_manual_person_id long, right_manual_person_id long"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_decisions_about_people(spark):
    s, group = decisions.with_group(state(spark), 1)  # two groups become the first, which takes the other's name and picture
    assert group == 1 and rows(s.groups) == [(1, "two", 11)] and rows(s.members) == [(1, 10), (1, 11)]
    s = decisions.renamed(state(spark), 3, "  Carla ")
    assert (3, "Carla", 30, False) in rows(s.people) and (3, "Carla", None) in rows(s.groups) and (3, 30) in rows(s.members)
    with pytest.raises(ValueError):
        decisions.renamed(s, 3, " " * 5)
    with pytest.raises(ValueError):
        decisions.renamed(s, 3, "x" * 129)
    s = decisions.hidden(state(spark), 1, 3)
    assert [r[3] for r in rows(s.people)] == [True, True, True] and rows(s.hidden_groups) == [(1,), (2,)]
    s = decisions.unhidden(s, 1)
    assert rows(s.hidden_groups) == [(2,)] and (1, "a", 10, False) in rows(s.people)
    s = decisions.split(decisions.hidden(state(spark), 2), 2)
    assert [m for m in rows(s.members) if m[1] >= 20] == [(4, 20), (5, 21)] and {(4,), (5,)} <= set(rows(s.hidden_groups))
    with pytest.raises(ValueError):
        decisions.split(state(spark), 3)
    s = decisions.merged(state(spark), 2, 1, 3)
    assert rows(s.people) == [(2, "b", 20, True)] and {r[1] for r in rows(s.assignments)} == {2} and {r[0] for r in rows(s.members)} == {1}
    s = decisions.kept_apart(state(spark), 3, 2)
    assert rows(s.exclusions) == [(1, 9), (3, 4)]
    with pytest.raises(ValueError):
        decisions.kept_apart(decisions.merged(state(spark), 2, 1), 2, 2)


def test_decisions_about_faces(spark):
    s = decisions.added_to(state(spark), 30, 1)
    assert (30, 1, "manual") in rows(s.assignments) and (1, 30) in rows(s.members) and 3 not in [r[0] for r in rows(s.people)]
    s = decisions.separated(state(spark), 11, hide=True)
    assert (4, None, 11, True) in rows(s.people) and (11, 4, "manual") in rows(s.assignments) and (3, 11) in rows(s.members) and rows(s.hidden_groups) == [(3,)] and (2, "two", None) in rows(s.groups)
    s = decisions.with_avatar(state(spark), 21, 2)
    assert (2, "b", 21, True) in rows(s.people) and (3, None, 21) in rows(s.groups)
    moved = decisions.replace(s, people=s.people.withColumn("cover_face_id", F.lit(None).cast("long")))
    assert {r[0]: r[2] for r in rows(decisions.with_avatars(moved).people)} == {1: 11, 2: 21, 3: None}
    faces = spark.createDataFrame([(1, 7), (2, 8)], "id long, file_id long")
    scans = spark.createDataFrame([(7, "v1"), (8, "v1")], "file_id long, pipeline_version string")
    f, c = decisions.replaced_faces(faces, scans, faces.limit(0), scans.where("file_id = 8"))
    assert rows(f) == [(1, 7)] and rows(c) == [(7, "v1"), (8, "v1")]
    assert [t.count() for t in decisions.rebuilt(faces, scans)] == [0, 0]


def test_lookups(spark):
    df = files(spark, {"id": 1, "media_id": 5, "thumbnail_path": "/t/1"}, {"id": 2, "media_id": 9, "thumbnail_path": None})
    assert [r["id"] for r in lookups.overview(df).collect()] == [2, 1] and lookups.item(df, 2).count() == 1 and lookups.item(df, 3).count() == 0
    e = spark.createDataFrame([(1, "v1", "completed"), (2, "v1", "failed")], "file_id long, pipeline_version string, status string")
    assert [lookups.has_row(e, i).first()[0] for i in (1, 3)] == [True, False]
    assert [lookups.processed(e, i, v).first()[0] for i, v in ((1, "v1"), (1, "v2"), (2, "v1"), (9, "v1"))] == [True, False, False, False]
    assert rows(media.stale_thumbnails(spark.createDataFrame([("/t/1",), ("/t/2",)], "path string"), df)) == [("/t/2",)]
    chart = spark.createDataFrame([("Unknown", 9), ("10", 1), ("9", 2), ("x", 3)], "value string, n int")
    assert [r[0] for r in stats.chart_order(chart, True).collect()] == ["9", "10", "x", "Unknown"] and [r[0] for r in stats.chart_order(chart).collect()] == ["x", "9", "10", "Unknown"]


def test_swapped_tables_survive_a_crash(spark, tmp_path):
    from prismlake.sources.tables import write_swapped

    path = f"file://{tmp_path}/t"
    write_swapped(spark.range(3), path)
    write_swapped(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path)
    assert rows(spark.read.parquet(path)) == [(10,), (11,), (12,)]
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if it had stopped between the renames
    write_swapped(spark.range(1), path)
    assert rows(spark.read.parquet(path)) == [(0,)] and not (tmp_path / "t.old").exists()


def test_modes_are_worked_anew(spark):
    from prismlake.streaming import incremental

    df, done = spark.range(3), spark.createDataFrame([(0, "x", "smart"), (1, "y", "small")], "file_id long, place string, mode string")
    out = incremental.reworked(df, done, lambda d: d.select(F.col("id").alias("file_id"), F.lit("new").alias("place")), "smart")
    assert rows(out) == [(0, "x", "smart"), (1, "new", "smart"), (2, "new", "smart")]


def test_recognised_lines_and_regions(spark):
    from prismlake.operators import recognition

    df = spark.createDataFrame([(1, [0, 1, 1, 0, 1, 2, 2, 9], [0.9, 0.8, 0.7, 0.9, 0.6, 0.4, 0.9, 0.2]), (2, [0, 0], [0.5, 0.5]), (3, [], [])], "id int, c array<int>, s array<double>")
    got = {r["id"]: (r["x"]["text"], round(r["x"]["confidence"], 9)) for r in df.select("id", recognition.ctc_text(F.col("c"), F.col("s"), ["a", "b"]).alias("x")).collect()}
    assert got == {1: ("aab", 0.5), 2: ("", 0.0), 3: ("", 0.0)}
    grid = np.zeros((20, 30))
    grid[3:6, 4:9] = grid[12:16, 2:5] = 0.5
    grid[12:16, 5] = 0.29  # below the threshold
    grid[0:2, 20:29] = 1  # not high enough
    grid[6, 9] = 0.9  # only touches by a corner
    df = spark.createDataFrame([(7, 30, 20, grid.ravel().tolist(), 60, 40)], "file_id long, map_width int, map_height int, values array<double>, image_width int, image_height int")
    assert [tuple(r) for r in recognition.text_regions(df).orderBy("place").collect()] == [(7, 0, 4, 2, 18, 14), (7, 1, 0, 20, 14, 16)]


def test_stored_index_is_kept_in_step(spark):
    old = spark.createDataFrame([(1, "one two two"), (2, "two three"), (3, "four"), (4, "")], "file_id long, text string")
    new = spark.createDataFrame([(2, "two two six"), (5, "Zwölf two")], "file_id long, text string")
    gone = spark.createDataFrame([(3,)], "file_id long")
    kept = old.where("file_id NOT IN (2, 3)").union(new)
    p = search.refreshed_index(search.postings(old, "file_id", "text"), search.postings(new, "file_id", "text"), gone, "file_id")
    n = search.refreshed_index(search.lengths(old, "file_id", "text"), search.lengths(new, "file_id", "text"), gone, "file_id")
    for q in ("two", "zwolf tw", "one six", "none", ""):
        want, got = ({r["file_id"]: round(r["score"], 9) for r in df.collect()} for df in (search.bm25(kept, q), search.bm25_stored(p, n, q)))
        assert got == want and (q in ("none", "") or want)


def test_accents_fold(spark):
    from prismlake.operators.filters import folded

    df = spark.createDataFrame([("Ếcole ÀÉÎõü ǍṢ Łódź e\u0301 ß",)], "t string")
    assert df.select(folded(F.col("t"))).first()[0] == "ecole aeiou as lodz e ß"
