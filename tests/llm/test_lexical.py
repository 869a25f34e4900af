"""Block-Max WAND against a plain loop over all documents, and how much of the postings it reads."""

import math
import random
import re

import numpy as np
import pytest

from prismlake.llm import lexical

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return [] if text is None else WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain(docs, items, k=20):
    """Every document scored for every distinct item."""
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, w, {x: w.count(x) for x in w}) for i, w in own if w]
    n, total = len(own), sum(len(w) for _, w, _ in own)
    df = {}
    for _, _, tf in own:
        for x in tf:
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        found = []
        for i, w, tf in own:
            m = 75 + 25 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m)) for x in terms(text) if x in tf)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=20, shard_terms=lexical.SHARD_TERMS, query_terms=lexical.QUERY_TERMS):
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), shard_terms=shard_terms)
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k, query_terms=query_terms)
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("shard_terms,query_terms", [(60, 10), (1 << 22, 1 << 18)])
def test_equals_a_plain_loop_over_odd_rows(spark, shard_terms, query_terms):
    rng = random.Random(5)
    words = ["Ab", "cd", "É", "x1", "żó", "zz"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, [40 / (j + 1) for j in range(len(words))], k=rng.choice([1, 3, 20, 90])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,"), (None, "cd zz w1"), (7, docs[7][1]), (7, docs[7][1]), (-3, "cd\ncd_CD"), (300, "w3 " * 5000)]
    items = [(0, "AB cd w3"), (1, "w39 w38, w37 cd cd CD"), (2, None), (3, "nothing here"), (4, ""), (None, "zz É"), (5, "ab"), (5, "ab"), (5, "x1 żó"), (6, " ".join(words * 2))]
    assert searched(spark, docs, items, 5, shard_terms, query_terms) == plain(docs, items, 5)


def test_empty_tables_and_extra_columns(spark):
    assert searched(spark, [], [(1, "a")]) == [] == searched(spark, [(1, "a")], [])
    docs = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, score int, `item.id` int")
    assert [tuple(r) for r in lexical.op11_block_max_wand(docs, docs.selectExpr("doc_id AS item_id", "text", "1 AS rank", "2 AS term")).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_ties_at_the_border_go_to_the_smaller_doc_id_in_any_shard(spark):
    docs = [(i, "same words here") for i in range(99, -1, -1)] + [(1000, "other")]
    got = searched(spark, docs, [(1, "same")], 20, shard_terms=30)
    assert [r[2] for r in got] == sorted(range(20), key=lambda i: repr((1, i + 1, i))) and len({r[3] for r in got}) == 1


def test_blocks_below_the_threshold_stay_compressed():
    """One document in a hundred has the rare term; of a list that all documents are in, few blocks are read."""
    n = 100_000
    sizes = np.full(n, 50)
    sizes[1::1000] = 3
    ids, rows = list(range(n)), []
    for i in range(n):
        w = np.full(sizes[i], 2)
        w[0] = 0
        if i % 1000 == 1:
            w[1] = 1
        rows.append(w)
    batches = list(lexical._shard_rows(0, ids, sizes.tolist(), rows, [b"all", b"rare", b"fill"], n, int(sizes.sum())))
    docs, lists = batches[0], {t: (d, h, x) for t, d, h, x in zip(*[sum((b.column(c).to_pylist() for b in batches[1:]), []) for c in ("term", "df", "head", "data")], strict=True)}
    shard = lexical.Shard(docs.column("head")[0].as_py(), docs.column("data")[0].as_py(), n, int(sizes.sum()))
    shard.lists = {j: lexical.Postings(*lists[t]) for j, t in enumerate([b"all", b"rare"])}
    got, scores = shard.best([0, 1], [1, 5000], 10)
    assert got.tolist() == list(range(1, 10_001, 1000)) and len(set(scores.tolist())) == 1
    assert shard.lists[0].read.sum() < 0.2 * len(shard.lists[0].read)
    assert len(shard.best([0, 1], [1, 5000], 10, int(scores[0]) + 1)[0]) == 0


def test_posting_blocks_come_back():
    rng = np.random.default_rng(3)
    doc = np.unique(rng.integers(0, 5000, 1000))
    tf = rng.integers(1, 300, len(doc))
    sizes = np.ones(5000, np.int64)
    sizes[doc] += tf
    parts = [np.concatenate([np.zeros(n - 1, np.int32), [1]]) for n in sizes]
    batches = list(lexical._shard_rows(0, list(range(5000)), sizes.tolist(), parts, [b"a", b"b"], 5000, int(sizes.sum())))
    m = lexical.lengths(sizes, 5000, int(sizes.sum()))
    p = lexical.Postings(*[batches[1].column(c)[0].as_py() for c in ("df", "head", "data")])
    some = np.array([1, 2, 5])
    at = p.decompressed(some, m)
    assert np.array_equal(p.doc[at], np.concatenate([doc[128 * b : 128 * b + 128] for b in some]))
    at = p.decompressed(np.arange(len(p.read)), m)
    assert np.array_equal(p.doc[at], doc) and np.array_equal(p.impact[at], lexical.impacts(tf, m[doc]))
    assert [int(p.impact[128 * b : 128 * b + 128].max()) for b in range(len(p.read))] == p.peak[:-1].tolist()
