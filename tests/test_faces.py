"""Faces in batches against one plain pass: any cut, replays, hidden people, ignored faces, streams that start again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import clustering
from prismlake.sources.tablesets import ConflictError, TableSet
from prismlake.streaming import faces as S

SCHEMA = "face_id long, quality double, embedding array<double>"


def random_faces(n, seed, noise=0.55):
    g = np.random.default_rng(seed)
    centre = g.normal(size=(9, 12))
    x = centre[g.integers(0, 9, n)] + g.normal(size=(n, 12)) * noise
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), float(g.integers(0, 8)), v.tolist()) for i, v in zip(g.permutation(n * 3)[:n], x, strict=True)]


def plain(faces, hidden=(), people=None):
    """One pass in order: {face: (person, score, suggestion, place)}, and each person's cover."""
    people = people or {}  # person to [(face, vector)]
    out, cover = {}, {}
    for face, quality, v in faces:
        hit = near = None
        for p, known in people.items():
            if p in hidden:
                continue
            s = [(sum(a * b for a, b in zip(v, k, strict=False)), f) for f, k in known]
            top = max(s, key=lambda t: t[0])
            rest = sorted((t[0] for t in s), reverse=True)
            if near is None or top[0] > near[0]:
                near = top
            if (top[0] >= 0.7 or (len(s) > 1 and top[0] >= 0.64 and rest[1] >= 0.54)) and (hit is None or top[0] > hit[1]):
                hit = p, top[0]
        person = hit[0] if hit else face
        known = people.setdefault(person, [])
        place = len(known) if len(known) < 6 else None
        if place is not None:
            known.append((face, v))
        out[face] = person, hit and round(hit[1], 9), near[1] if not hit and near and near[0] >= 0.58 else None, place
        if person not in cover or quality > cover[person][1]:
            cover[person] = face, quality
    return out, {p: c[0] for p, c in cover.items()}


def found(tables):
    t = S.state(tables.latest())
    place = {r["face_id"]: r["place"] for r in t["representatives"].collect()}
    near = {r["face_id"]: r["candidate_face_id"] for r in t["suggestions"].collect()}
    out = {r["face_id"]: (r["person_id"], r["score"] and round(r["score"], 9), near.get(r["face_id"]), place.get(r["face_id"])) for r in t["assignments"].collect()}
    return out, {r["person_id"]: r["cover_face_id"] for r in t["people"].collect()}


@pytest.mark.parametrize("cuts", [[], [1, 40, 41, 100]])
def test_batches_equal_one_pass_in_any_cut(spark, tmp_path, cuts):
    rows = sorted(random_faces(160, 1))
    tables = TableSet(spark, f"file://{tmp_path}/t")
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        S.assign_batch(tables, spark.createDataFrame(rows[a:b], SCHEMA).repartition(3), k)
    want = plain(rows)
    assert found(tables) == want
    assert 5 < len(want[1]) < 100 and any(r[2] is not None for r in want[0].values()) and any(r[3] is None for r in want[0].values())


def test_replays_change_nothing_and_a_lost_race_neither(spark, tmp_path):
    rows = sorted(random_faces(60, 2))
    tables = TableSet(spark, f"file://{tmp_path}/t")
    df = lambda a, b: spark.createDataFrame(rows[a:b], SCHEMA)
    S.assign_batch(tables, df(0, 30), 0)
    stale = tables.latest()
    S.assign_batch(tables, df(30, 60), 1)
    want = found(tables)
    assert S.assign_batch(tables, df(30, 60), 1).version == 2 == S.assign_batch(tables, df(0, 30), 0).version
    # the same faces under a new number are assigned already
    S.assign_batch(tables, df(0, 60), 2)
    assert found(tables) == want == plain(rows)
    with pytest.raises(ConflictError):
        tables.commit(stale, S.assigned(S.state(stale), df(30, 60)))


def test_hidden_people_do_not_grow_and_ignored_faces_stay_out(spark, tmp_path):
    rows = sorted(random_faces(120, 3))
    tables = TableSet(spark, f"file://{tmp_path}/t")
    S.assign_batch(tables, spark.createDataFrame(rows[:60], SCHEMA), 0)
    first, _ = plain(rows[:60])
    most = max({p for p, *_ in first.values()}, key=lambda p: sum(r[0] == p for r in first.values()))
    base = tables.latest()
    tables.commit(base, {"people": base.table("people").withColumn("hidden", F.col("person_id") == most)})
    ignored = spark.createDataFrame([(rows[70][0],), (rows[90][0],)], "face_id long")
    S.assign_batch(tables, spark.createDataFrame(rows[60:], SCHEMA), 1, ignored)
    people = {}
    for f, (p, *_, place) in first.items():
        if place is not None:
            people.setdefault(p, []).append((place, f, dict((i, v) for i, _, v in rows)[f]))
    people = {p: [x[1:] for x in sorted(k, key=lambda t: t[0])] for p, k in sorted(people.items())}
    rest, _ = plain([r for i, r in enumerate(rows[60:]) if i not in (10, 30)], {most}, people)
    got = found(tables)[0]
    assert got == {**first, **rest} and sum(r[0] == most for r in got.values()) == sum(r[0] == most for r in first.values())


def test_a_stream_goes_on_after_a_crash_between_the_two_commits(spark, tmp_path, monkeypatch):
    rows = sorted(random_faces(90, 4))
    tables, source = TableSet(spark, f"file://{tmp_path}/t"), f"{tmp_path}/in"
    spark.createDataFrame(rows[:30], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    real = S.assign_batch

    def crash(*a, **k):
        real(*a, **k)
        raise RuntimeError("crash after the commit")

    monkeypatch.setattr(S, "assign_batch", crash)
    with pytest.raises(Exception, match="crash"):
        S.follow_faces(spark, source, SCHEMA, tables, f"{tmp_path}/c").awaitTermination()
    monkeypatch.undo()
    assert tables.latest().version == 1
    spark.createDataFrame(rows[30:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    S.follow_faces(spark, source, SCHEMA, tables, f"{tmp_path}/c").awaitTermination()
    assert found(tables) == plain(rows) and tables.latest().version == 2


def test_links_join_what_pairs_join_and_stay_few(spark):
    rows = [(i, v) for i, _, v in random_faces(150, 5)] + [(1000 + i, [1.0] + [0.0] * 11) for i in range(300)]
    df = spark.createDataFrame(rows, "face_id long, embedding array<double>")
    links, pairs = clustering.similar_links(df, block=64), clustering.similar_pairs(df, block=64)
    roots = lambda e: {r["node"]: r["root"] for r in clustering.components(e.select("a", "b")).collect()}
    assert roots(links) == roots(pairs)
    assert links.count() < 450 * 8 < pairs.count()


def test_known_faces_are_not_compared_with_each_other_and_hidden_groups_take_no_face(spark):
    rows = [(1, 1.0, [1.0, 0.0], 5), (2, 0.9, [1.0, 0.0], None), (3, 0.8, [0.0, 1.0], None), (4, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", group_id long")
    hidden = spark.createDataFrame([(5,)], "group_id long")
    got = {r["face_id"]: r["leader"] for r in clustering.leaders(df, hidden=hidden).collect()}
    assert got == {1: 1, 2: 2, 3: 3} and {r["face_id"]: r["leader"] for r in clustering.leaders(df).collect()} == {1: 1, 2: 1, 3: 3}
    known = spark.createDataFrame([(2**60 + 1, 2**60 + 1, 0, [0.0, 1.0]), (2**60 + 2, 2**60 + 2, 0, [0.0, 1.0])], "person_id long, face_id long, place int, embedding array<double>")
    got = [tuple(r) for r in clustering.leaders(df.where("face_id = 3"), known).collect()]
    assert got == [(3, 2**60 + 1, 1.0, None, None, 1)]


def test_links_of_large_components_do_not_grow_with_blocks(spark):
    g = np.random.default_rng(6)
    x = np.eye(3, 12)[np.arange(900) % 3] * 2 + g.normal(size=(900, 12)) * 0.4
    x[890:] = g.normal(size=(10, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "face_id long, embedding array<double>")
    roots = lambda e: {r["node"]: r["root"] for r in clustering.components(e.select("a", "b")).collect()}
    links = clustering.similar_links(df, block=64)
    assert roots(links) == roots(clustering.similar_pairs(df, block=64)) and links.count() < 2 * 900


def test_a_component_is_one_stream_however_shuffles_are_read(spark, tmp_path):
    rows = sorted(random_faces(160, 7))
    tables, name = TableSet(spark, f"file://{tmp_path}/t"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")  # as with large tables, whose shuffles have many partitions
    try:
        for k in range(2):
            S.assign_batch(tables, spark.createDataFrame(rows[80 * k : 80 * k + 80], SCHEMA).repartition(3), k)
        assert found(tables) == plain(rows)
    finally:
        spark.conf.set(name, before)
