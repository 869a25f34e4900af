"""Detector heads and alignment against loops; retries and ingest through failures and replays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import detector, ingest
from prismlake.sources.tablesets import TableSet
from prismlake.streaming import retries

LEVELS = "array<struct<scores: array<float>, boxes: array<float>, landmarks: array<float>>>"


def loop(file_id, iw, ih, w, h, levels):
    """The faces of one image, one anchor after another, then one box after another."""
    found = []
    for level, (scores, boxes, marks) in enumerate(levels):
        stride = (8, 16, 32)[level]
        wide = iw // stride
        for k in range(min(len(scores), len(boxes) // 4, len(marks) // 10, ih // stride * wide * 2)):
            if scores[k] < 0.55:
                continue
            cx, cy = k // 2 % wide * stride, k // 2 // wide * stride
            b = [float(v) * stride for v in boxes[4 * k : 4 * k + 4]]
            x1, y1, x2, y2 = max(0, cx - b[0]), max(0, cy - b[1]), min(iw, cx + b[2]), min(ih, cy + b[3])
            if x2 - x1 >= 2 and y2 - y1 >= 2:
                p = [float(v) * stride for v in marks[10 * k : 10 * k + 10]]
                found.append((level * 2**40 + k, float(scores[k]), x1 * w / iw, y1 * h / ih, x2 * w / iw, y2 * h / ih, [((cx + p[2 * j]) * w / iw, (cy + p[2 * j + 1]) * h / ih) for j in range(5)]))
    kept = []
    for f in sorted(found, key=lambda f: -f[1]):
        over = False
        for g in kept:
            both = max(0, min(f[4], g[4]) - max(f[2], g[2])) * max(0, min(f[5], g[5]) - max(f[3], g[3]))
            union = (f[4] - f[2]) * (f[5] - f[3]) + (g[4] - g[2]) * (g[5] - g[3]) - both
            over |= union > 0 and both / union >= 0.4
        if not over:
            kept.append(f)
    return {(file_id, f[0]): f[1:] for f in kept}


def test_heads_equal_a_loop(spark):
    g = np.random.default_rng(1)
    rows, want = [], {}
    for i in range(6):
        iw, ih, levels = 96, 64, []
        for stride in (8, 16, 32):
            n = iw // stride * (ih // stride) * 2 + (3 if i == 1 else 0)
            s, b, m = (g.random(n).astype(np.float32), (g.random(4 * n) * 4 - 0.5).astype(np.float32), g.normal(size=10 * n).astype(np.float32))
            levels.append((s[: n // 2] if i == 2 else s, b[:-3] if i == 3 else b, m[:15] if i == 4 else m))
        rows.append((i, iw, ih, 200 + i, 100, [tuple(x.tolist() for x in lv) for lv in levels]))
        want |= loop(i, iw, ih, 200 + i, 100, levels)
    rows += [(8, 96, 64, 10, 10, []), (9, 96, 64, 10, 10, None)]
    got = {(r["file_id"], r["box_id"]): r for r in detector.detected(spark.createDataFrame(rows, f"file_id long, input_width int, input_height int, width int, height int, levels {LEVELS}")).collect()}
    assert got.keys() == want.keys() and len(want) > 60
    for k, (score, x1, y1, x2, y2, marks) in want.items():
        r = got[k]
        assert np.allclose([r["score"], r["x1"], r["y1"], r["x2"], r["y2"]], [score, x1, y1, x2, y2]) and np.allclose([tuple(p) for p in r["landmarks"]], marks)
        side = min(x2 - x1, y2 - y1)
        assert np.isclose(r["quality"], score * min(1, side / 140) * max(0, min(1, float(np.hypot(*np.subtract(marks[1], marks[0]))) / max(1, side * 0.35))))


def test_known_transforms_come_back_and_singular_ones_are_null(spark):
    g, rows, want = np.random.default_rng(2), [], []
    for i in range(20):
        a, b, tx, ty = g.normal(size=4) * (1, 1, 50, 50)
        # landmarks that the map takes to the target
        d = a * a + b * b
        rows.append((i, [(float((a * (u - tx) + b * (v - ty)) / d), float((a * (v - ty) - b * (u - tx)) / d)) for u, v in detector.TARGET]))
        want.append((a, b, tx, ty))
    rows += [(20, [(3.0, 4.0)] * 5), (21, [(1.0, 2.0)] * 4), (22, None), (23, [(1.0, None)] * 5), (24, [(float(k * 1e9), float(k % 2 * 1e9)) for k in range(5)])]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, p array<struct<x: double, y: double>>").select("i", detector.similarity(F.col("p")).alias("t")).collect()}
    assert all(np.allclose(tuple(got[i]), w, rtol=1e-9, atol=1e-9) for i, w in enumerate(want))
    assert [got[i] for i in range(20, 25)] == [None] * 5
    noisy = [(x + float(e), y - float(e)) for (x, y), e in zip(rows[0][1], g.normal(size=5), strict=True)]
    t = tuple(spark.createDataFrame([(noisy,)], "p array<struct<x: double, y: double>>").select(detector.similarity(F.col("p"))).first()[0])
    left = np.array([r for x, y in noisy for r in ([x, -y, 1, 0], [y, x, 0, 1])])
    assert np.allclose(t, np.linalg.lstsq(left, np.array(detector.TARGET).ravel(), rcond=None)[0])


def test_a_warp_equals_a_loop(spark):
    g = np.random.default_rng(3)
    image = g.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    a, b, tx, ty = 2.1, 0.4, 10.0, -5.0
    want = np.zeros((112, 112, 3), np.uint8)
    for y in range(112):
        for x in range(112):
            sx, sy = (a * (x - tx) + b * (y - ty)) / (a * a + b * b), (-b * (x - tx) + a * (y - ty)) / (a * a + b * b)
            if 0 <= sx < 49 and 0 <= sy < 39:
                i, j = int(sx), int(sy)
                top = image[j, i] * (1 - (sx - i)) + image[j, i + 1] * (sx - i)
                low = image[j + 1, i] * (1 - (sx - i)) + image[j + 1, i + 1] * (sx - i)
                want[y, x] = np.floor(top * (1 - (sy - j)) + low * (sy - j) + 0.5)
    raw = image.tobytes()
    rows = [(bytearray(raw), 50, 40, (a, b, tx, ty)), (bytearray(raw[:-1]), 50, 40, (a, b, tx, ty)), (None, 50, 40, (a, b, tx, ty)), (bytearray(raw), 50, 40, None), (bytearray(raw), 1, 40, (a, b, tx, ty))]
    got = [r[0] for r in spark.createDataFrame(rows, "r binary, w int, h int, t struct<a: double, b: double, tx: double, ty: double>").select(detector.warped(*map(F.col, "rwht"))).collect()]
    assert bytes(got[0]) == want.tobytes() and want.any() and got[1:] == [None] * 4


def state(tables):
    return {r["file_id"]: (r["state"], r["attempts"], r["error"], r["next_at"]) for r in tables.latest().table("attempts").collect()}


def test_failures_wait_and_end_while_an_offline_drive_only_waits(spark, tmp_path):
    tables = TableSet(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "broken"), (4, "away"), (5, "silent")], "id long, kind string")
    seen = []

    def work(online):
        def run(df):
            seen.append(sorted(r["id"] for r in df.collect()))
            kind = F.col("kind")
            outcome = F.when((kind == "ok") | ((kind == "away") & F.lit(online)), "ok").when(kind == "away", "offline").when(kind == "broken", "permanent").otherwise("failed")
            return df.where("kind <> 'silent'").select(F.col("id").alias("file_id"), outcome.alias("outcome"), F.concat(F.lit("it was "), kind).alias("error"), F.upper(kind).alias("text"))

        return run

    once = lambda now, online=False, again=tables, version="v1": retries.work_once(again, rows, work(online), version, now, "texts", most=2, delay=10, defer=100)
    once(1000)
    assert state(tables) == {1: ("done", 1, None, None), 2: ("failed", 1, "it was bad", 1010), 3: ("given_up", 1, "it was broken", None), 4: ("offline", 0, "it was away", 1100), 5: ("failed", 1, "no result", 1010)}
    version = once(1005).version
    assert seen == [[1, 2, 3, 4, 5]] and version == tables.latest().version
    once(1011, again=TableSet(spark, tables.root))
    assert seen[1:] == [[2, 5]] and state(tables)[2] == ("given_up", 2, "it was bad", None) == (*state(tables)[5][:2], "it was bad", None)
    for n in range(3):
        once(1100 + 100 * n)
    assert seen[2:] == [[4]] * 3 and state(tables)[4] == ("offline", 0, "it was away", 1400)
    once(1400, online=True)
    assert state(tables)[4][:2] == ("done", 1)
    once(9999)
    assert len(seen) == 6 and sorted(tuple(r) for r in tables.latest().table("texts").collect()) == [(1, "OK", "v1"), (4, "AWAY", "v1")]
    once(9999, online=True, version="v2")
    assert seen[6:] == [[1, 2, 3, 4, 5]] and sorted(r["model_version"] for r in tables.latest().table("texts").collect()) == ["v2", "v2"]
    assert "tried" not in tables.latest()


def test_a_crash_between_work_and_record_is_due_again(spark, tmp_path, monkeypatch):
    tables, rows = TableSet(spark, f"file://{tmp_path}/t"), spark.createDataFrame([(1,)], "id long")
    good = lambda df: df.select(F.col("id").alias("file_id"), F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("error"))
    with monkeypatch.context() as m:
        m.setattr(retries, "recorded", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            retries.work_once(tables, rows, good, "v", 5, "texts")
    retries.work_once(TableSet(spark, tables.root), rows, good, "v", 6, "texts")
    assert state(tables) == {1: ("done", 1, None, None)}


def test_ingest_numbers_new_paths_without_gap_or_repeat(spark, tmp_path):
    tables = TableSet(spark, f"file://{tmp_path}/t")
    listing = lambda ids: spark.createDataFrame([(f"/p/{i}.jpg",) for i in ids] + [(None,), (f"/p/{ids[0]}.jpg",)], "path string").repartition(7)
    unreadable = {3}
    extract = lambda df: df.where(~F.col("path").isin([f"/p/{i}.jpg" for i in unreadable])).withColumn("size", F.length("path"))
    removed = spark.createDataFrame([("/p/5.jpg",)], "path string")
    files = lambda: {r["path"]: r["media_id"] for r in ingest.indexed(tables.latest()).collect()}
    ingest.ingest(tables, listing(range(40)), extract, 0, removed)
    first = files()
    assert sorted(first.values()) == list(range(1, 39)) and "/p/5.jpg" not in first and "/p/3.jpg" not in first
    unreadable.clear()
    ingest.ingest(tables, listing(range(50)), extract, 1, removed)
    both = files()
    assert first.items() <= both.items() and sorted(both.values()) == list(range(1, 50))
    assert ingest.ingest(tables, listing(range(90)), extract, 1).version == 2 and files() == both
    ingest.ingest(tables, listing(range(50)), extract, 2, removed)
    assert files() == both and tables.latest().notes == {"ingest_batch": 2, "last_media_id": 49}


def test_numbers_of_no_rows_and_of_empty_partitions(spark):
    assert ingest.numbered(spark.range(0), 5).count() == 0
    rows = spark.range(100).repartition(16).where("id % 9 = 0")
    assert sorted(r["media_id"] for r in ingest.numbered(rows, 5).collect()) == list(range(6, 18))


def test_alignment_has_the_sums_of_sql(spark, sf):
    """Not only after rounding: sums are taken in the same order, so that no value lies on the other side of a half."""
    import oracle

    from prismlake.plans import upkeep

    sql = upkeep.query.__globals__["ORACLE"]["face_alignment"]
    for c in ("a", "b"):
        sql = sql.replace(f"round({c}, 6)", c)
    sql = sql.replace("round((u - a * x + b * y) / 5, 4)", "(u - a * x + b * y) / 5").replace("round((v - b * x - a * y) / 5, 4)", "(v - b * x - a * y) / 5")
    assert "round(a," not in sql and "/ 5, 4)" not in sql
    want = {(r[0], r[1]): tuple(r[2:]) for r in oracle.connect(sf).execute(sql).fetchall()}
    found = detector.decoded(upkeep._heads(spark, sf)).select("file_id", "box_id", detector.similarity(F.col("landmarks")).alias("t")).collect()
    assert len(found) == len(want) and all(want[r["file_id"], r["box_id"]] == tuple(r["t"]) for r in found)
