"""Commits of several tables: crashes at every step, two writers, pinned readers, collection."""

import pytest

from prismlake.sources.tablesets import ConflictError, TableSet


def rows(snapshot, *names):
    return {n: sorted(tuple(r) for r in snapshot.table(n).collect()) for n in names if n in snapshot}


@pytest.fixture
def tables(spark, tmp_path):
    return TableSet(spark, f"file://{tmp_path}/set")


def two(spark, n):
    return {"a": spark.createDataFrame([(n,)], "x long"), "b": spark.createDataFrame([(n, str(n))], "x long, y string")}


def test_commits_change_tables_together_and_readers_stay_with_their_version(spark, tables):
    none = tables.latest()
    assert none.version == 0 and "a" not in none
    one = tables.commit(none, two(spark, 1), notes={"batch": 1})
    both = tables.commit(one, {"a": one.table("a").union(two(spark, 2)["a"])}, notes={"by": "x"})
    assert rows(one, "a", "b") == {"a": [(1,)], "b": [(1, "1")]}
    assert rows(tables.latest(), "a", "b") == {"a": [(1,), (2,)], "b": [(1, "1")]} and tables.latest().notes == {"batch": 1, "by": "x"}
    last = tables.commit(both, {}, removed=("b",))
    assert "b" not in tables.latest() and rows(tables.at(2), "b") == {"b": [(1, "1")]} and last.version == 3


def test_empty_tables_keep_their_columns(spark, tables):
    s = tables.commit(tables.latest(), {"a": spark.createDataFrame([], "x long, y array<string>")})
    assert tables.latest().table("a").dtypes == [("x", "bigint"), ("y", "array<string>")] == s.table("a").dtypes


def test_two_writers_one_wins(spark, tables):
    base = tables.commit(tables.latest(), two(spark, 1))
    tables.commit(base, two(spark, 2))
    with pytest.raises(ConflictError):
        tables.commit(base, two(spark, 3))
    late = tables.latest()
    # the other writer comes between the check and the rename
    seen, tables.versions = tables.versions, lambda: [late.version]
    TableSet(spark, tables.root).commit(late, two(spark, 4))
    tables.versions = lambda calls=iter([[late.version], [late.version, late.version + 1]]): next(calls)
    with pytest.raises(ConflictError):
        tables.commit(late, two(spark, 5))
    tables.versions = seen
    assert rows(tables.latest(), "a", "b") == {"a": [(4,)], "b": [(4, "4")]}
    assert len(tables._names("data/a")) == 3


@pytest.mark.parametrize("step", ["first table", "second table", "manifest", "rename", "after"])
def test_a_crash_leaves_the_old_or_the_new_set(spark, tables, monkeypatch, step):
    base = tables.commit(tables.latest(), two(spark, 1))
    new = two(spark, 2)
    if step.endswith("table"):
        bad = spark.createDataFrame([(2,)], "x long").selectExpr("CAST(raise_error('crash') AS LONG) AS x")
        new = {"a": bad} if step.startswith("first") else {"a": new["a"], "b": bad}
    if step == "manifest":
        monkeypatch.setattr(tables, "_publish", lambda *a: 1 / 0)
    if step == "rename":
        real = tables._path
        monkeypatch.setattr(tables, "_path", lambda name: 1 / 0 if name.endswith("2.json") else real(name))
    if step == "after":
        whole = tables._publish
        monkeypatch.setattr(tables, "_publish", lambda *a: whole(*a) and 1 / 0)
    with pytest.raises(Exception):
        tables.commit(base, new)
    monkeypatch.undo()
    n = 2 if step == "after" else 1
    again = TableSet(spark, tables.root)
    assert rows(again.latest(), "a", "b") == {"a": [(n,)], "b": [(n, str(n))]}
    assert rows(again.commit(again.latest(), two(spark, 3)), "a", "b") == {"a": [(3,)], "b": [(3, "3")]}


def test_collection_keeps_what_is_named_and_what_may_be_in_writing(spark, tables):
    s = tables.latest()
    for n in range(4):
        s = tables.commit(s, two(spark, n) if n != 2 else {"a": two(spark, n)["a"]})
    two(spark, 9)["a"].write.parquet(f"{tables.root}/data/a/000000002-lost")
    two(spark, 9)["a"].write.parquet(f"{tables.root}/data/a/000000005-running")
    gone = tables.collect(keep=2)
    assert {g.split("-")[0] for g in gone} == {"a/000000001", "a/000000002", "b/000000001"} and len(gone) == 4
    assert tables.versions() == [3, 4] and rows(tables.at(3), "a", "b") == {"a": [(2,)], "b": [(1, "1")]}
    assert tables._names("data/a")[-1] == "000000005-running"
