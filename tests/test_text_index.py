"""A stored index against BM25 over the texts, through updates, deletes and merges; how much of it a search reads."""

import random

import pytest

from prismlake.operators import search
from prismlake.sources.tablesets import TableSet
from prismlake.sources.text_index import TextIndex


def scores(df):
    return {r["file_id"]: round(r["score"], 9) for r in df.collect()}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file_id long, text string")


@pytest.fixture
def index(spark, tmp_path):
    return TextIndex(TableSet(spark, f"file://{tmp_path}/i"))


def test_it_equals_bm25_after_every_step(spark, index):
    rng, texts = random.Random(1), {}
    words = ["Alpha", "alphabet", "béta", "beta_x", "gamma1", "the"] + [f"w{i}" for i in range(30)]
    assert index.search("alpha").collect() == []
    for step in range(5):
        new = {rng.randrange(60): " ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(25)}
        new[1000 + step] = None
        gone = rng.sample(range(60), 5) if step else []
        gone = [g for g in gone if g not in new]
        index.update(frame(spark, new), gone=spark.createDataFrame([(g,) for g in gone], "file_id long"), batch=step)
        again = index.update(frame(spark, {1: "alpha " * 99}), batch=step)
        texts = {k: v for k, v in {**texts, **new}.items() if k not in gone}
        assert again.notes["texts"] == sum(v is not None for v in texts.values())
        if step in (2, 4):
            before = index.segments(index.tables.latest())
            index.compact(whole=step == 4)
            after = index.segments(index.tables.latest())
            assert len(after) < len(before) and (step != 4 or len(after) == 1 and index.tables.latest().table("deleted").count() == 0)
        for q in ("alpha", "BETA the", "w1 gamma", "nothing", "the"):
            assert scores(index.search(q)) == scores(search.bm25(frame(spark, texts), q)), (step, q)
    assert index.search("?!").collect() == []


def test_merging_takes_the_newest_while_older_ones_stay(spark, index):
    index.update(frame(spark, {i: f"big{i} one two three four five" for i in range(100)}))
    for n in range(3):
        index.update(frame(spark, {i: "small text" for i in range(n * 2, n * 2 + 2)}))
    s = index.compact()
    assert len(index.segments(s)) == 2 and 0 in index.segments(s) and s.table("deleted").count() == 6
    assert sorted(scores(index.search("small"))) == list(range(6)) and sorted(scores(index.search("big9")))[:1] == [9]


def test_a_prefix_reads_the_row_groups_of_its_range_only(spark, tmp_path):
    index = TextIndex(TableSet(spark, f"file://{tmp_path}/i"), file_rows=20_000, group_bytes=1 << 15)
    rows = spark.range(4000).selectExpr("id AS file_id", "concat_ws(' ', transform(sequence(0, 24), i -> concat('w', lpad(hex(xxhash64(id, i)), 16, '0')))) AS text")
    index.update(rows)
    s = index.tables.latest()
    total = s.table("postings_0").count()
    part = s.table("postings_0").where(search.word_begins("wa3"))
    plan = part._jdf.queryExecution()
    n = plan.toRdd().count()
    read = plan.executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert total == 100_000 and 0 < n <= read < total / 10
    folder = f"{tmp_path}/i/data/{s.tables['postings_0']['folder']}"
    spans = spark.read.parquet(folder).selectExpr("word", "input_file_name() AS f").groupBy("f").agg({"word": "min"}).count()
    assert spans == 5
    assert scores(index.search("wa3")) == scores(search.bm25(rows, "wa3"))


def test_words_of_a_text_are_counted_without_a_shuffle(spark):
    from prismlake.sources.text_index import _counted

    rows = spark.createDataFrame([(1, ["b", "a", "b", "é", "b"]), (2, []), (3, None), (4, ["x"])], "doc_id long, _words array<string>")
    got = _counted(rows, "doc_id")
    assert sorted(tuple(r) for r in got.select("doc_id", "word", "tf", "len").collect()) == [(1, "a", 1, 5), (1, "b", 3, 5), (1, "é", 1, 5), (4, "x", 1, 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
