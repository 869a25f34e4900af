"""Corpus operators against brute force, and their odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prismlake.llm import _links, ann, decontam, licences, line_dedup, mixture, near_dedup, quality, quoting, sharding, toxicity
from prismlake.llm._shared import components, materialize, shingle_hashes, table, word_hashes, WordHash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows, a very long text, and columns with names that operators use."""
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (None, "some text", "en", None, 1), (None, None, None, None, None), (4, None, "de", "b", 0), (5, "", "en", "b", 0), (6, " \n\t ", "en", "b", 3), (7, "lang " * 60_000, "en", "a", 5), (1, "another text of the same id here", "en", "c", 1), (8, "日本 語 ünï", None, "ü", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("size", "score", "items", "spans", "shard", "copies", "key", "md5", "node", "uid", "_p", "leaf"):
        df = df.withColumn(c, F.lit("x"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- 1 ------------------------------------------------------------------------------------------


def exact(ids, x, q, k=20):
    out = []
    for i in np.flatnonzero(ids % q == 0):
        s = np.add.accumulate(x * x[i], 1)[:, -1]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out += [(int(ids[i]), r + 1, int(ids[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_nearest_equal_brute_force_with_ties(spark):
    g = np.random.default_rng(1)
    x = np.round(g.normal(size=(600, 8)), 1) * g.integers(1, 4, (600, 1))
    x[100:180] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.op1_vp_tree(df).collect())
    assert got == exact(np.arange(600), x, 20)


@pytest.mark.parametrize("kind", ["binary", "huge"])
def test_nearest_keeps_ties_and_bears_huge_norms(spark, kind):
    g = np.random.default_rng(3)
    if kind == "binary":  # many distinct vectors of equal score
        x = (g.random((3000, 14)) < 0.5).astype(float)
        x[:, 0] = 1
    else:
        x = g.normal(size=(3000, 8))
        x[1] *= 1e9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.op1_vp_tree(df).collect())
    assert got == exact(np.arange(3000), x, 20)


def test_nearest_on_driver_table_and_relaxed_recall(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = exact(ids, x, 20)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.op1_vp_tree(e).collect())
    assert got == want
    relaxed = {(r["query_id"], r["vec_id"]) for r in ann.search(e, e.where("vec_id % 20 = 0"), factor=2.0).collect()}
    assert len(relaxed & {(q, v) for q, _, v in want}) >= 0.9 * len(want)


def test_tree_prunes_and_stays_exact_on_clusters():
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(c * 50, 1, (800, 4)) for c in range(8)])
    tree = ann.VPTree(x, leaf=100)
    found, far = tree.nearest(x[:50], 5, 1.0)
    for i in range(50):
        assert np.allclose(np.sort(far[i]), np.sort(((x - x[i]) ** 2).sum(1))[:5], atol=1e-6)
    assert (tree.bounds(x[:50]) > np.sqrt(far.max(1))[:, None]).mean() > 0.5


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1.0, None]), (None, [1.0, 1.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [3.0]), (120, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.op1_vp_tree(df).collect())
    assert got == [(0, 1, 120), (0, 2, 1), (120, 1, 0), (120, 2, 1)]
    assert ann.op1_vp_tree(df.limit(0)).count() == 0


# --- 2 ------------------------------------------------------------------------------------------


def fill(sizes):
    """Shares by weight in order of code point, null last, capped at twice a source's size, by turns."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(w[s] for s in open_)
        over = [s for s in open_ if rate * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: rate * w[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mix_meets_targets(spark, sf):
    d = table(spark, sf, "documents").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = mixture.op2_pivotal_mix(d).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or ""))
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    want = fill(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixture.op2_pivotal_mix(d.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_rounding_keeps_sums_and_chances():
    g = np.random.default_rng(0)
    p, size = g.random(40), g.integers(1, 100, 40)
    n, trials = np.zeros(40), 3000
    for t in range(trials):
        out, at, q = mixture._pivotal(p, size, [f"{t}-{i}".encode() for i in range(40)], 0)
        mass = (out * size).sum() + (q * size[at] if at >= 0 else 0)
        assert abs(mass - (p * size).sum()) < 1e-6
        n += out if at < 0 else np.where(np.arange(40) == at, q, out)
    assert np.abs(n / trials - p).max() < 0.05


def test_taken_rows_equal_a_loop(spark, sf, monkeypatch):
    """The same leaves and tree in plain loops take the same rows; words are traded as masses."""
    monkeypatch.setattr(mixture, "LEAF", 48)
    monkeypatch.setattr(mixture, "FAN_IN", 3)
    d = table(spark, sf, "documents").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = [r.asDict() for r in mixture.copies(d).collect()]
    per = Counter()
    for r in rows:
        r["class"] = math.floor(math.log2(r["size"] + 1) * 4)
        per[r["source"], r["class"]] += 1
        rate = r["target"] / r["source_size"] if r["source_size"] else 0.0
        r["whole"], r["mass"] = math.floor(rate), (rate - math.floor(rate)) * r["size"]

    def hashed(schema, values, *columns):
        out = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {schema}").select("i", F.xxhash64(*columns).alias("h"))
        return [r["h"] for r in out.orderBy("i").collect()]

    salt = hashed("k string, c int", [(r["key"], 5) for r in rows], "k", "c")
    salt = [h % -(-per[r["source"], r["class"]] // 48) for h, r in zip(salt, rows, strict=True)]
    for h, r in zip(hashed("s string, n boolean, c int, p long", [(r["source"] or "", r["source"] is None, r["class"], p) for r, p in zip(rows, salt, strict=True)], "s", "n", "c", "p"), rows, strict=True):
        r["leaf"] = h

    def decide(group, level):
        """Settle all rows of a node but one, which is returned."""
        last = None
        for r in sorted(group, key=lambda r: (-r["size"], r["key"])):
            if r["size"] and 1e-9 < r["mass"] / r["size"] < 1 - 1e-9:
                if last:
                    up, down = min(r["mass"], last["size"] - last["mass"]), min(last["mass"], r["size"] - r["mass"])
                    moved = up if xxhash.xxh64_intdigest(r["key"], seed=level) / 2**64 * (up + down) < down else -down
                    last["mass"], r["mass"] = last["mass"] + moved, r["mass"] - moved
                both = [x for x in (last, r) if x and 1e-9 < x["mass"] / x["size"] < 1 - 1e-9]
                last = both[0] if both else None
        return [last] if last else []

    nodes, level = defaultdict(list), 0
    for r in rows:
        nodes[r["leaf"]].append(r)
    left = [r for own in nodes.values() for r in decide(own, 0)]
    while max((many := Counter(r["source"] for r in left)).values(), default=0) > 1:
        level, nodes = level + 1, defaultdict(list)
        for h, r in zip(hashed("l long, c int", [(r["leaf"], level) for r in left], "l", "c"), left, strict=True):
            nodes[r["source"], h % -(-many[r["source"]] // 3)].append(r)
        left = [r for own in nodes.values() for r in decide(own, level)]
    assert level >= 2
    want = Counter((r["key"], r["whole"] + (r["mass"] / r["size"] >= 0.5) if r["size"] else 0) for r in rows)
    assert want == Counter((r["key"], r["copies"]) for r in rows)


def test_mix_odd_rows(spark):
    rows = mixture.op2_pivotal_mix(odd(spark)).collect()
    assert len(rows) == 10 and sum(r["size"] for r in rows if r["doc_id"] == 4) == 0
    assert mixture.op2_pivotal_mix(odd(spark).limit(0)).count() == 0
    many = mixture.repeated(odd(spark))
    assert many.columns == odd(spark).columns and many.where("text IS NULL").count() == 0
    assert {(r["size"], r["copies"], r["key"], r["leaf"]) for r in many.collect()} == {("x",) * 4}
    again = spark.createDataFrame([(1, None, "x"), (1, "x", None), (1, "x y", None), (1, "", "x")], "doc_id long, text string, source string")
    assert {(r["text"], r["source"]) for r in mixture.repeated(again).collect()} <= {("x", None), ("x y", None)}


# --- 3 ------------------------------------------------------------------------------------------


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "How do I grow tomatoes well?\nIn a small garden."),
        (1, 1, "assistant", "Plant them in full sun please."),
        (1, 2, "user", "On Monday she wrote:\n> How do I grow tomatoes WELL?\n> In a small  garden.\nFirst of all water."),
        (1, 3, "user", "> > How do I grow tomatoes well?\n> > In a small garden.\n> First of all water.\nThank you so much"),
        (2, 0, "user", "> Plant them in full sun please.\nSeen elsewhere"),
        (3, 0, None, None), (None, 0, "user", "> a b c d\nx"), (3, 1, "user", "> no such passage here\nok"), (3, 2, "user", ""),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quoting.op3_quote_links(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    up = {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items() if r["parent_conv"] is not None}
    assert up == {(1, 2): (1, 0), (1, 3): (1, 2), (2, 0): (1, 1)}
    assert got[1, 2]["text"] == "First of all water." and got[1, 3]["text"] == "Thank you so much"
    assert (got[1, 3]["thread_conv"], got[1, 3]["thread_turn"], got[1, 3]["depth"]) == (1, 0, 2)
    assert got[2, 0]["thread_conv"] == 1 and got[3, 1]["linked"] == 0 and got[3, 0]["text"] is None
    one = sorted((r for r in got.values() if r["thread_conv"] == 1), key=lambda r: (r["thread_turn"], r["conv_id"], r["turn"]))
    assert [(r["conv_id"], r["turn"]) for r in one] == [(1, 0), (1, 2), (1, 3), (1, 1), (2, 0)]


def test_partial_and_inline_quotes_link(spark):
    five = "The first line stands here.\nA second line follows it.\nThe third line is in the middle\nand runs on to a fourth.\nHere the fifth line ends."
    three = "Alpha beta gamma\ndelta epsilon.\n\nZeta eta theta\niota kappa.\n\nLambda mu nu\nxi omicron."
    rows = [
        (1, 0, "user", five), (1, 1, "user", three),
        (1, 2, "user", "> A second line follows it.\n> The third line is in the middle\ntwo lines of a paragraph"),
        (1, 3, "user", "> Alpha beta gamma\n> delta epsilon.\n>\n> Zeta eta\n> theta iota kappa.\ntwo paragraphs of three"),
        (1, 4, "user", "> A second line follows it.\n> Here the fifth line ends.\nmy answer comes first\n> Lambda mu nu\n> xi omicron.\nthen there is more\nof the same kind"),
        (1, 5, "user", "> then there is more of the same kind\nto a message that was answered inline itself"),
        (1, 6, "user", "Certainly not"), (1, 7, "user", "> Certainly not\nshort, but of this conversation"),
        (1, 8, "user", "One sentence here. Another sentence there! A third one."), (1, 9, "user", "> Another sentence there!\none sentence"),
        (1, 10, "user", "> no one ever said this\n> Certainly not\nlines of few words don't link a longer passage"),
        (2, 0, "user", "> Certainly not\nshort, and of no conversation"), (2, 1, "user", "A second line follows it."),
        (2, 2, "user", "> A second line follows it.\n> The third line is in the middle\n> and runs on to a fourth.\n> Here the fifth line ends.\nlonger elsewhere"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quoting.op3_quote_links(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    up = {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items() if r["parent_conv"] is not None}
    assert up == {(1, 2): (1, 0), (1, 3): (1, 1), (1, 4): (1, 0), (1, 5): (1, 4), (1, 7): (1, 6), (1, 9): (1, 8), (2, 2): (1, 0)}
    assert (got[1, 4]["quotes"], got[1, 4]["linked"]) == (2, 2) and got[1, 4]["text"] == "my answer comes first\nthen there is more\nof the same kind"


def test_links_equal_brute_force(spark):
    """Random messages that quote runs of earlier lines, against a look at all messages for each quote."""
    rnd, rows = random.Random(17), []
    line = lambda: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(5))
    for conv in range(6):
        said = []
        for turn in range(12):
            own, quoted = [line() for _ in range(rnd.randrange(1, 4))], []
            if said and rnd.random() < 0.6:
                src = rnd.choice(said)
                a = rnd.randrange(len(src))
                quoted = src[a : a + rnd.randrange(1, 3)]
            rows.append((conv, turn, "user", "\n".join([*(f"> {x}" for x in quoted), *own])))
            said.append(own)
    messages = {(c, t): text for c, t, _, text in rows}

    def parent(key):
        _, _, quoted = quoting.parts(messages[key])
        best = None
        for at, (level, q) in enumerate(quoted):
            found = []
            for n in quoting.grains(q):
                size = n.count(" ") + 1
                if size < quoting.LEAST_WORDS and n != quoting.normal(q):
                    continue
                say = sorted(k for k, text in messages.items() if any(n in quoting.grains(p) for p in (quoting.parts(text)[0], *quoting.parts(text)[1])))
                near = [k for k in say if k[0] == key[0] and k[1] < key[1]]
                if near:
                    found.append((-size, 0, -near[-1][1], near[-1]))
                elif size >= quoting.LEAST_WORDS and say and say[0][0] < key[0]:
                    found.append((-size, 1, -say[0][1], say[0]))
            if found:
                own = (level, at, min(found)[3])
                best = own if best is None or own < best else best
        return best[2] if best else None

    want = {k: parent(k) for k in messages}
    assert sum(v is not None for v in want.values()) > 20
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit("x")).withColumn("depth", F.lit("x"))
    got = {(r["conv_id"], r["turn"]): r for r in quoting.op3_quote_links(df.union(df.limit(3))).collect()}
    assert {k: (r["parent_conv"], r["parent_turn"]) if r["parent_conv"] is not None else None for k, r in got.items()} == want
    for k, r in got.items():
        up, d = k, 0
        while want[up]:
            up, d = want[up], d + 1
        assert (r["thread_conv"], r["thread_turn"], r["depth"]) == (*up, d)


def test_conversations_without_quotes_stay(spark, sf):
    c = table(spark, sf, "conversations")
    got = quoting.op3_quote_links(c)
    assert got.count() == c.count() and got.where("depth > 0").count() == 0
    assert quoting.op3_quote_links(c.limit(0)).count() == 0


# --- 4 ------------------------------------------------------------------------------------------


def test_block_max_index_is_exact():
    g = np.random.default_rng(5)
    vectors = []
    for _ in range(500):
        ids = np.sort(g.choice(40, g.integers(1, 6), replace=False))
        w = g.random(len(ids)) + 0.1
        vectors.append((ids, w / np.linalg.norm(w)))
    full = np.zeros((500, 40))
    for i, (a, w) in enumerate(vectors):
        full[i, a] = w
    index = toxicity.BlockMaxIndex(vectors, 40, 16)
    for q in range(60):
        near, cosine = index.nearest(*vectors[q], 7)
        s = full @ full[q]
        best = [i for i in np.lexsort((np.arange(500), -np.round(s, 9))) if s[i] > 0][:7]
        assert near.tolist() == best and np.allclose(cosine, np.minimum(s[best], 1))


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs_, own = table(spark, d, "documents"), table(spark, d, "labels")
    rows = toxicity.op4_toxicity_knn(docs_, own).join(own, "doc_id").collect()
    for r in rows[:200]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    hit = Counter((r["toxic"], r["predicted"]) for r in held)
    assert hit[1, 1] / (hit[1, 1] + hit[0, 1]) > 0.9 and hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.7
    # calibrated: the mean score is near the rate
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["toxic"] for r in held])) < 0.04


def test_toxicity_neighbours_equal_brute_force(spark, sf):
    """Every text with a word of an example has neighbours, and they are those of the largest cosine in the whole word space."""
    d, own = table(spark, sf, "documents"), table(spark, sf, "labels")
    m = toxicity.fit(d, own).value
    rows = d.orderBy("doc_id").collect()
    n, df = len(rows), Counter()
    text = {r["doc_id"]: r["text"].encode() for r in rows}
    for t in text.values():
        df.update(m.terms.count(t)[0].tolist())
    learnt = {t.decode() for i in m.id.tolist() for t in re.findall(rb"[a-z0-9\x80-\xff]+", text[i].lower())}
    assert learnt <= {t.decode() for t in m.terms.terms}
    more = m.idf / (np.log((n + 1) / (np.array([df[i] for i in range(len(m.idf))]) + 1)) + 1)
    assert more.min() > 0.999 and np.isclose(more, 1).mean() > 0.9

    def vector(t):
        v = np.zeros(len(m.idf))
        ids, tf = m.terms.count(t)
        v[ids] = (1 + np.log(tf)) * m.idf[ids]
        return v / max(np.linalg.norm(v), 1e-300)

    full = np.array([vector(text[i]) for i in m.id.tolist()])
    none = 0
    for r in rows[:120]:
        ids, tf = m.terms.count(text[r["doc_id"]])
        near, cosine = m.index.nearest(ids, m.unit(ids, tf), m.k) if len(ids) else (np.zeros(0, int), np.zeros(0))
        s = np.minimum(full @ vector(text[r["doc_id"]]), 1)
        best = [i for i in np.lexsort((np.arange(len(s)), -np.round(s, 9))) if s[i] > 1e-12][: m.k]
        none += not best
        assert np.allclose(cosine, s[best], atol=1e-9) and near.tolist() == best
    assert none <= 0.05 * 120


def test_plain_cosine_on_request(spark, sf):
    d, own = table(spark, sf, "documents"), table(spark, sf, "labels")
    m, n = toxicity.fit(d, own, telling=0.0).value, d.count()
    df = toxicity.document_frequencies(d, spark.sparkContext.broadcast(m.terms))
    assert not any(t.endswith(b"*") for t in m.terms.terms) and np.allclose(m.idf, np.log((n + 1) / (df + 1)) + 1)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(d, own, telling=0.0).collect())


def test_toxicity_odd_rows(spark):
    rows = toxicity.op4_toxicity_knn(odd(spark), labels(spark, [(1, 1, 0), (5, 1, None), (None, 1, 1)])).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    of = toxicity.score(odd(spark), labels(spark, [(1, 1, 0), (7, 1, 1)]), keep_text=True)
    assert [c for c in of.columns if c not in ("score", "predicted", "evidence")] == [c for c in odd(spark).columns if c != "score"]
    assert {(r["size"], r["items"], r["_p"], r["leaf"]) for r in of.collect()} == {("x",) * 4} and sum(r["text"] is None for r in of.collect()) == 2
    assert len({r["score"] for r in of.collect() if not (r["text"] or "").strip()}) == 1
    assert toxicity.op4_toxicity_knn(odd(spark).limit(0), labels(spark, [])).count() == 0
    assert all(r["score"] == 0 for r in toxicity.op4_toxicity_knn(odd(spark), labels(spark, [])).collect())


# --- 5 ------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    own = table(spark, d, "labels")
    rows = quality.op5_bayes_quality(table(spark, d, "documents"), own).join(own, "doc_id").where("held_out").collect()
    good = [r["keep"] == bool(r["quality"]) for r in rows]
    assert np.mean(good) > 0.9
    bad = [r["score"] for r in rows if not r["quality"]]
    fine = [r["score"] for r in rows if r["quality"]]
    assert np.mean(np.array(bad)[:, None] < np.array(fine)[None]) > 0.9


def test_sparse_sites_stay_near_the_prior(spark):
    groups = spark.createDataFrame([("a", 1000, 900.0), ("b", 1000, 100.0), ("c", 1, 1.0)], "h string, n long, s double")
    rate = {r["h"]: r["r"] for r in quality._shrunk(groups, "n", "s", F.lit(0.5), "r")[0].collect()}
    assert rate["a"] > 0.85 and rate["b"] < 0.15 and 0.5 < rate["c"] < rate["a"]


def test_quality_odd_rows(spark):
    rows = quality.op5_bayes_quality(odd(spark), labels(spark, [(1, 1, 0), (5, 0, 0), (6, None, 0)])).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.op5_bayes_quality(odd(spark).limit(0), labels(spark, [])).count() == 0


# --- 6, 7 ---------------------------------------------------------------------------------------


def roots(n, pairs):
    up = list(range(n))

    def f(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[max(f(a), f(b))] = min(f(a), f(b))
    return [f(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(300, edges)
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def similar_texts():
    """Chains of texts that change by a character at a time, so that classes hold pairs that are far apart."""
    rnd, texts = random.Random(3), []
    for _ in range(3):
        base = [rnd.choice("abcdefgh ") for _ in range(60)]
        cur = base[:]
        for _ in range(24):
            cur = cur if rnd.random() < 0.7 else base[:]
            cur[rnd.randrange(60)] = rnd.choice("abcdefgh ")
            texts.append("".join(cur).encode())
    rnd.shuffle(texts)
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize("block", [4, 16, 512])
def test_large_buckets_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(_links, "BLOCK", block)
    texts = similar_texts()
    sets = line_dedup.bags(texts)
    s = np.array([[_links.similarity(a, b) for b in sets] for a in sets])
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if s[i, j] >= 0.8])
    assert len(set(want)) == 3
    blobs = materialize(spark.createDataFrame([(i, bytearray(t), float(len(x[0]))) for i, (t, x) in enumerate(zip(texts, sets, strict=True))], "node long, blob binary, total double"), "t")
    monkeypatch.setattr(_links, "ENTRIES", 4 * block)  # small parts, in which the bucket is hot
    members = spark.createDataFrame([(i, [1, 2] if i % 2 else [1]) for i in range(len(texts))], "node long, buckets array<long>")
    seen = _links.classes([members], lambda nodes: blobs.join(nodes, "node", "left_semi"), line_dedup.bags, 0.8)
    got = {r["node"]: r["root"] for r in seen.collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_sketches_only_rule_out_unlike_sets():
    rnd = random.Random(8)
    for _ in range(3000):
        n = rnd.randrange(1, 400)
        base = [rnd.getrandbits(64) for _ in range(n)]
        other = [x if rnd.random() < 0.9 else rnd.getrandbits(64) for x in base]
        a, b = ((np.unique(np.array(x, np.uint64)), None) for x in (base, other))
        assert not (_links._ruled_out(a, b, 0.8) and _links.similarity(a, b) >= 0.8)


def test_members_of_shared_buckets_are_found(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, [rnd.randrange(3000), 10_000 + rnd.randrange(20), 20_000 if i % 3 == 0 else 30_000 + i]) for i in range(900)] + [(900, None), (901, [])]
    count = Counter(b for _, own in rows for b in own or ())
    want = sorted((b, i) for i, own in rows for b in own or () if count[b] > 1)
    df = spark.createDataFrame(rows, "node long, buckets array<long>")
    for entries in (64, 1 << 21):
        monkeypatch.setattr(_links, "ENTRIES", entries)
        got = sorted((r["bucket"], r["node"]) for r in _links._met(df).collect())
        assert sorted(x for x in got if count[x[0]] > 1) == want and len(got) == len(set(got))


def test_fuzzy_lines_equal_brute_force(spark, sf):
    d = table(spark, sf, "documents").where("doc_id < 60")
    rows = line_dedup.op6_fuzzy_lines(d).collect()
    lines = [(r["doc_id"], i, line_dedup.normal(x.encode())) for r in d.orderBy("doc_id").collect() for i, x in enumerate(r["text"].split("\n"))]
    full = [x for x in lines if x[2]]
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (x[2].decode() for x in full)]
    pairs = [(i, j) for i in range(len(full)) for j in range(i) if full[i][2] == full[j][2] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = roots(len(full), pairs)
    want = {x[:2]: full[r][:2] for x, r in zip(full, root, strict=True)}
    got = {(r["doc_id"], r["line"]): (r["kept_doc_id"], r["kept_line"]) for r in rows}
    assert len(rows) == len(lines) and sum(got[k] != want[k] for k in want) <= 0.005 * len(want)  # a band may miss a pair at the threshold
    assert all(r["keep"] == ((r["doc_id"], r["line"]) == (r["kept_doc_id"], r["kept_line"])) for r in rows)


def test_lines_at_the_threshold_meet():
    rnd, a, b = random.Random(11), [], []
    while len(a) < 4000:
        x = bytes(rnd.choices(b"abcdefghijklmnopqrstuvwxyz ", k=90))
        y = x[: rnd.randrange(71, 78)] + bytes(rnd.choices(b"abcdefghijklmnopqrstuvwxyz ", k=4))
        p, q = ({z[i : i + 5] for i in range(len(z) - 4)} for z in (x, y))
        if 0.8 <= len(p & q) / len(p | q) <= 0.82:
            a.append(x)
            b.append(y)
    odd_ = line_dedup._factors(line_dedup.BANDS, line_dedup.ROWS)
    met = [(line_dedup.buckets(z, line_dedup.BANDS, line_dedup.ROWS, odd_)) for z in (a, b)]
    assert ((met[0] == met[1]).any(axis=1)).mean() >= 0.999


def test_line_similarity_is_exact():
    rnd = random.Random(12)
    texts = ["".join(rnd.choices("aб日", k=rnd.choice([1, 3, 5, 9, 40]))) for _ in range(60)]
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    want = [[len(p & q) / len(p | q) for q in sets] for p in sets]
    own = line_dedup.bags([t.encode() for t in texts])
    match = _links.overlaps(own)
    assert np.allclose([match(i) for i in range(60)], want, rtol=0, atol=1e-12)
    assert np.allclose([[_links.similarity(x, y) for y in own] for x in own], want, rtol=0, atol=1e-12)


def test_lines_odd_rows(spark):
    rows = line_dedup.op6_fuzzy_lines(odd(spark)).collect()
    assert sum(r["keep"] for r in rows if r["doc_id"] == 1) == 2 and sum(r["keep"] for r in rows if r["doc_id"] == 6) == 2
    assert line_dedup.op6_fuzzy_lines(odd(spark).limit(0)).count() == 0


def weighted(d):
    """Pairs of texts whose weighted Jaccard similarity is 0.8 or more, by all pairs, on the words themselves."""
    rows = sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=lambda r: r[0])
    known, own = WordHash(), [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) for _, t in rows]
    slot = lambda w: int(known[w.encode()]) & (near_dedup.BUCKETS - 1)
    df = Counter(x for t in own for x in {slot(w) for w in t})
    step = lambda w: round(64 * (np.log((len(rows) + 1) / (df[slot(w)] + 1)) + 1))
    bags = []
    for t in own:
        n = Counter(tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 0))) if len(t) >= 5 else Counter([tuple(t)] if t else [])
        bags.append({x: (1 + np.log(k)) * ((sum(map(step, x)) // len(x) + 4) // 8) / 8 for x, k in n.items()})
    where = defaultdict(list)
    for i, b in enumerate(bags):
        for x in b:
            where[x].append(i)
    near = {(i, j) for o in where.values() for i in o for j in o if j < i}
    total = [sum(b.values()) for b in bags]
    pairs = [(i, j) for i, j in near if (low := sum(min(v, bags[j][x]) for x, v in bags[i].items() if x in bags[j])) >= 0.8 * (total[i] + total[j] - low)]
    same = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        same[t].append(i)
    pairs += [(x[0], y) for x in same.values() for y in x[1:]]
    root = roots(len(rows), pairs)
    return {r[0]: rows[k][0] for r, k in zip(rows, root, strict=True)}


def test_near_duplicates_equal_brute_force(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op7_icws_near_dedup(d).collect()}
    want = weighted(d)
    assert len(got) == len(want) and sum(got[k] != want[k] for k in want) <= 2  # a band may miss a pair at the threshold
    kept = near_dedup.representatives(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_near_duplicates_equal_plain_jaccard_of_planted_texts(spark):
    rnd = random.Random(21)
    fresh = lambda n: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))
    texts, shared = [], fresh(60)
    for _ in range(12):  # copies with a few changed words, some near enough and some not
        base = fresh(100).split()
        for n in (0, 1, 2, 6):
            own = base[:]
            for i in range(n):
                own[5 + 15 * i] = fresh(1)
            texts.append(" ".join(own))
    texts += [f"{shared} {fresh(2)}" for _ in range(8)]  # mostly one shared passage
    texts += [f"{shared} {fresh(60)}" for _ in range(8)]  # half of it
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op7_icws_near_dedup(docs(spark, *texts)).collect()}
    assert [got[i] for i in range(len(texts))] == root and len(set(root)) < len(texts) - 20


def test_consistent_sampling_estimates_weighted_jaccard():
    g = np.random.default_rng(2)
    s = np.arange(1, 201, dtype=np.uint32) * np.uint32(2654435761)
    a, b = g.random(200) + 0.2, g.random(200) + 0.2
    t = near_dedup._variates(400)
    x = near_dedup.signatures(np.concatenate([s, s]), np.concatenate([a, b]), np.array([200, 200]), t)
    assert abs((x[0] == x[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.08


def test_near_duplicates_odd_rows(spark):
    rows = near_dedup.op7_icws_near_dedup(odd(spark)).collect()
    assert len(rows) == 10 and all(r["class_size"] == 1 for r in rows if r["doc_id"] == 4)
    assert near_dedup.op7_icws_near_dedup(odd(spark).limit(0)).count() == 0
    kept = near_dedup.representatives(odd(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0), (True, 0)]


# --- 8 ------------------------------------------------------------------------------------------


def test_licences_and_inheritance(spark):
    mit = licences.TEMPLATES["MIT"][2]
    rows = [(1, "r/LICENSE", mit), (2, "r/src/a.c", "int main"), (3, "r/sub/COPYING", "Licensed under the Apache License, Version 2.0."), (4, "r/sub/deep/er/b.c", "x"), (5, "r/sub/c.c", "code\nmore code here of several words\nReleased under the MIT License."), (6, "q/d.c", "nothing"), (7, None, "x"), (8, "r/e.c", None), (9, "r/src/f.c", "This is free of charge and the public may publish it.")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["how"]) for r in licences.licensed(df, F.col("path")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: ("Apache-2.0", "inherited"), 5: ("MIT", "own"), 6: (None, None), 7: (None, None), 8: ("MIT", "inherited"), 9: ("MIT", "inherited")}


def licence_of(text):
    found = licences.Templates().notices(text.encode(), licences.LEAST)
    return max(found, key=lambda f: (round(f[1], 9), -f[2]))[0] if found else None


@pytest.mark.parametrize("name", sorted(licences.TEMPLATES))
@pytest.mark.parametrize("width", [40, 72])
def test_wrapped_headers(name, width):
    for text in licences.TEMPLATES[name]:
        lines, line = [], ""
        for w in text.split():
            if line and len(line) + len(w) >= width:
                lines.append(line)
                line = ""
            line = f"{line} {w}".strip()
        body = "\n".join(f" * {x}" for x in [*lines, line])
        assert licence_of(body) == name
        assert licence_of(f"/* This file is part of the License of Example Software\n * under terms and conditions as published\n{body}\n * without any of the rights or copies of this work\n */\nint main") == name


def test_standard_headers_of_like_licences():
    grant = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    for name, title, version in (("AGPL-3.0", "Affero General Public License", "3"), ("LGPL-3.0", "Lesser General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("GPL-3.0", "General Public License", "3"), ("GPL-2.0", "General Public License", "2")):
        assert licence_of(grant.format(title, version)) == name
    assert licence_of("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007") == "LGPL-3.0"
    two = "Copyright (c) 2020, A. Body\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n"
    assert licence_of(two) == "BSD-2-Clause"
    assert licence_of(two + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n") == "BSD-3-Clause"


def test_licence_lines_of_documents(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    want = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in licences.op8_licence_scan(d).collect():
        found = {v for k, v in want.items() if k in text[r["doc_id"]]}
        assert (r["licence"] in found) if found else r["how"] != "own"
    assert licences.op8_licence_scan(odd(spark)).count() == 10 and licences.op8_licence_scan(d.limit(0)).count() == 0


def test_licences_equal_brute_force(spark, sf):
    # every range of consecutive lines of every text against every template, as plain dictionaries; directories by walking upwards
    cut = re.compile(rb"[0-9a-z\x80-\xff]+")
    terms = lambda own: Counter(own) + Counter(zip(own, own[1:], strict=False))
    texts = [(name, cut.findall(t.encode().lower())) for name, ts in licences.TEMPLATES.items() for t in ts]
    df = Counter(t for _, w in texts for t in terms(w))
    rare = math.log(len(texts) + 1) + 0.1
    idf = lambda t: math.log((len(texts) + 1) / df[t]) + 0.1 if t in df else rare if isinstance(t, bytes) else rare / 2
    vector = lambda own: {t: n * idf(t) for t, n in terms(own).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, v, norm(v)) for name, w in texts for v in [vector(w)]]
    vocabulary = {t for t in df if isinstance(t, bytes)}

    def nearest(text):
        lines = [cut.findall(x) for x in text.encode().lower().split(b"\n")]
        best, k = None, 0
        mostly = [bool(w) and 2 * sum(x in vocabulary for x in w) >= len(w) for w in lines]
        while k < len(lines):
            end = k
            while end < len(lines) and mostly[end]:
                end += 1
            for i in range(k, end):
                for j in range(i + 1, end + 1):
                    v = vector([w for x in lines[i:j] for w in x])
                    size = norm(v)
                    for name, t, n in templates:
                        c = sum(x * t.get(y, 0) for y, x in v.items()) / size / n
                        if c >= licences.LEAST and (best is None or c > best[1] + 1e-9):
                            best = (name, c, i)
            k = max(end, k + 1)
        return best

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    extra = [
        (10**6 + i, text, "xx", "made")
        for i, text in enumerate([*[t for ts in licences.TEMPLATES.values() for t in ts], "Header\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files\nand so on", "no licence at all", "", None])
    ]
    every = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = every.collect()
    want = {r["doc_id"]: nearest(r["text"]) if r["text"] else None for r in rows}
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    got = {r["doc_id"]: r for r in licences.scan(every, path).collect()}
    assert len(got) == len(rows) and sum(w is not None for w in want.values()) > 50
    for k, w in want.items():
        r = got[k]
        assert (r["licence"] is None) == (w is None), (k, w, r)
        if w:
            assert r["licence"] in (w[0], *[a for a, b in licences.HOLDS.items() if b == w[0]]) and abs(r["cosine"] - w[1]) < 1e-6, (k, w, r)
    holders = {}
    for r in sorted(got.values(), key=lambda r: (-round(r["cosine"] or 0, 9), r["licence"] or "")):
        if r["is_file"]:
            holders.setdefault(r["path"].rpartition("/")[0], r["licence"])
    for r in licences.licensed(every, path).collect():
        own, up = got[r["doc_id"]], r["path"].rpartition("/")[0]
        while own["licence"] is None and up and up not in holders:
            up = up.rpartition("/")[0]
        assert (r["licence"], r["from_dir"]) == ((own["licence"], None) if own["licence"] else (holders.get(up), up if up in holders else None))


# --- 9 ------------------------------------------------------------------------------------------


def test_shards_are_even_and_keep_copies_together(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sharding.op9_bin_packing(d).collect()
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    size, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of[t].add(r["shard"])
    assert sorted(size) == list(range(40)) and max(size.values()) < 1.02 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())


def by_items(sizes, capacity):
    """Best fit by looking at every open bin: the load of each bin, and the bin of each item."""
    room, put = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        i = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(max(capacity, s))
        room[i] -= s
        put.append(i)
    return put


def test_best_fit_takes_the_tightest_bin():
    g = random.Random(4)
    for capacity in (10, 60, 97, 1000):
        sizes = sorted((g.randrange(1, 50) for _ in range(300)), reverse=True)
        runs = sorted(Counter(sizes).items(), reverse=True)
        got = [b for b, n in sharding.best_fit(runs, capacity) for _ in range(n)]
        assert got == by_items(sizes, capacity)
    assert [b for b, n in sharding.best_fit([(30, 1), (5, 2)], 10) for _ in range(n)] == [0, 1, 1]
    put, load, at = sharding.fewest(runs, 7), Counter(), 0
    for b, n in put:
        load[b] += sum(sizes[at : at + n])
        at += n
    assert at == 300 and len(load) == 7 and max(load.values()) - min(load.values()) <= 7
    assert sharding.fewest([], 7) == [] and sharding.best_fit([(0, 3)], 5) == [(0, 3)]


def test_rooms_stay_sorted_and_find_the_tightest():
    g, tree, held = random.Random(9), sharding.Rooms(8), []
    for k in range(3000):
        if g.random() < 0.6 or not held:
            held.append((g.randrange(500), k))
            tree.add(*held[-1])
        else:
            size = g.randrange(520)
            fits = [x for x in held if x[0] >= size]
            assert tree.tightest(size) == (min(fits) if fits else None)
            if fits:
                held.remove(min(fits))
        assert all(leaf and leaf[-1] == top and len(leaf) <= 8 for leaf, top in zip(tree.leaves, tree.tops, strict=True))
    assert [x for leaf in tree.leaves for x in leaf] == sorted(held)


def test_shards_equal_best_fit_of_all_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANKS", 16)
    g = random.Random(5)
    rows = [(i, f"g{g.randrange(200)}", g.randrange(1, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, name string, w int")
    got = {r["doc_id"]: r["shard"] for r in sharding.pack(df, F.col("name"), F.col("w"), capacity=100).collect()}
    total = Counter()
    for _, name, w in rows:
        total[name] += w
    order = sorted(total, key=lambda x: (-total[x], hashlib.md5(x.encode()).hexdigest()))
    of = dict(zip(order, by_items([total[x] for x in order], 100), strict=True))
    assert got == {i: of[name] for i, name, _ in rows}


def test_shards_odd_rows(spark):
    rows = sharding.op9_bin_packing(odd(spark)).collect()
    assert len(rows) == 10 and {r["size"] for r in rows if r["doc_id"] in (4, 5)} == {16}
    assert sharding.op9_bin_packing(odd(spark).limit(0)).count() == 0
    filled = sharding.pack(odd(spark), F.col("text"), F.lit(10), capacity=30)
    assert filled.groupBy("shard").count().agg(F.max("count")).first()[0] <= 3 and set(odd(spark).columns) <= set(filled.columns) | {"shard"}
    assert {(r["_p"], r["size"], r["node"], r["leaf"]) for r in filled.collect()} == {("x",) * 4}
    mapped = odd(spark).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert sharding.pack(mapped, F.col("text"), F.lit(1), shards=3).select("m").count() == mapped.count()
    none = sharding.pack(odd(spark), F.col("text"), F.lit(None).cast("int"), shards=3)
    assert none.count() == 10 and none.where("shard IS NULL").count() == 0


# --- 10 -----------------------------------------------------------------------------------------


def hits(text, items, window=13):
    """Words hit and items found, by looking at every place."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        own = words(t)
        for k in range(max(len(own) - window, 0) + 1 if own else 0):
            p = own[k : k + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    items = [(r["item_id"], r["text"]) for r in b.collect()]
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in decontam.op10_fm_index(d, b).collect():
        n, hit, found = hits(text[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest() and r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_fm_index_counts_and_locates():
    g = np.random.default_rng(8)
    text = np.append(g.integers(1, 5, 400), 0)
    index = decontam.FMIndex(text, 4)
    for n in (1, 2, 3, 5):
        rows = g.integers(1, 5, (20, n))
        low, high = index.search(rows, np.full(20, n))
        for p, a, b in zip(rows, low, high, strict=True):
            want = [i for i in range(400 - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("size", [5, 13, 20])
@pytest.mark.parametrize("copies", [2, 3, 8])
def test_fm_index_of_equal_stretches(size, copies):
    text = np.array([*range(1, size + 1), 0] * copies)
    order = decontam.suffix_order(np.append(text + 1, 0))
    assert order.tolist() == sorted(range(len(text) + 1), key=lambda i: [*(text[i:] + 1), 0])
    index = decontam.FMIndex(text, size)
    low, high = index.search(np.array([[2, 3, 4]]), np.array([3]))
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [1 + i * (size + 1) for i in range(copies)]


@pytest.mark.parametrize("size", [5, 13, 20])
def test_copies_of_one_leak_are_all_found(spark, size):
    leak = " ".join(f"w{i}" for i in range(size))
    b = spark.createDataFrame([(1, leak)], "item_id long, text string")
    for copies in (2, 3, 8):
        same = docs(spark, *[leak] * copies).coalesce(1)
        assert [(r["n_hit"], r["n_items"]) for r in decontam.op10_fm_index(same, b).collect()] == [(size, 1)] * copies
        inside = docs(spark, *[f"other {leak} words {i}" for i in range(copies)]).coalesce(1)
        assert [(r["n_words"], r["n_hit"]) for r in decontam.op10_fm_index(inside, b).collect()] == [(size + 3, size)] * copies


def test_decontamination_odd_rows(spark, monkeypatch):
    b = spark.createDataFrame([("q1", "Some TEXT"), ("q1", "two three"), ("q2", None), (None, "one"), ("q3", "  "), ("q4", "lang lang")], "item_id string, text string")
    rows = decontam.op10_fm_index(odd(spark), b).collect()
    got = sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in rows)
    assert got == sorted([(6, 2, 1), (6, 2, 1), (2, 2, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (60_000, 60_000, 1), (7, 0, 0), (3, 0, 0)])
    assert decontam.op10_fm_index(odd(spark).limit(0), b).count() == 0
    assert decontam.op10_fm_index(odd(spark), b.limit(0)).where("n_hit > 0").count() == 0
    monkeypatch.setattr(decontam, "PHRASES_AT_ONCE", 1)
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.op10_fm_index(odd(spark), b).collect()) == got


def test_spans_are_cut_out(spark):
    b = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    found = decontam.scan(docs(spark, "a b, C d! e", "é B c", None), b, keep_text=True)
    assert [r["text"] for r in decontam.without_spans(found).orderBy("doc_id").collect()] == ["a  d! e", "é ", None]


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    before, kept = table(spark, sf, "documents"), None
    for name, stage in p.STAGES[:3]:
        after = materialize(stage(spark, before, sf), name, swept=False)
        assert after.columns == before.columns
        a, z = {r["doc_id"] for r in before.collect()}, {r["doc_id"] for r in after.collect()}
        assert z <= a and len(z) > 0.6 * len(a)
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
            for r in before.collect():
                n, hit, _ = hits(r["text"], items)
                assert (r["doc_id"] in z) == (not (hit > 0 and 20 * hit >= n))
        before = after
    mixed = materialize(p.mix_sources(spark, before, sf), "mix", swept=False)
    want = {r["doc_id"]: r["copies"] for r in mixture.copies(before).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in want.items() if v})
    last = materialize(p.shard(spark, mixed, sf), "last", swept=False)
    assert last.columns[: len(mixed.columns)] == mixed.columns and last.columns[len(mixed.columns) :] == ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in last.collect()) == Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    packed = Counter((r["doc_id"], r["size"], r["shard"]) for r in sharding.op9_bin_packing(mixed).collect())
    assert Counter((r["doc_id"], r["size"], r["shard"]) for r in last.collect()) == packed
    for k in range(40):
        slots = sorted(r["slot"] for r in last.where(F.col("shard") == k).collect())
        assert slots == list(range(len(slots)))


def test_pipeline_stages_bear_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    labels(spark, [(1, 1, 0), (7, 1, 1), (8, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q1", "some text"), (None, "one"), ("q2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = materialize(odd(spark), "odd", swept=False)
    left = {}
    for name, stage in p.STAGES:
        out = stage(spark, df, str(tmp_path))
        rows = out.collect()
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
        if name != "sharding":
            assert out.columns == df.columns and {(r["size"], r["items"], r["shard"], r["key"], r["_p"], r["leaf"], r["score"], r["spans"]) for r in rows} <= {("x",) * 8}
        left[name] = Counter((r["doc_id"], r["text"] if "text" in out.columns else None) for r in rows)
    every = Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert left["toxicity"] <= every and left["toxicity"][4, None] == left["toxicity"][None, None] == 1
    assert left["near_dedup"] == Counter(every.keys())
    assert left["sharding"] == every
    assert left["decontamination"] == every - Counter({(None, "some text"): 1})
    assert all(n <= 2 * every[k] for k, n in left["mixing"].items()) and not any((t or "").strip() == "" for _, t in left["mixing"])
    assert sum(left["sharding"].values()) == 10


@pytest.mark.parametrize("name", ["op1_vp_tree", "op10_fm_index", "op11_block_max_wand", "op12_warc_captures", "op13_repair"])
def test_queries_equal_sql(spark, sf, name):
    import oracle

    from prismlake.llm import queries

    names, rows = oracle.rows_of_duck(oracle.connect(sf), queries.ORACLE_SQL[name])
    df = queries.queries()[name](spark, sf)
    assert names == sorted(df.columns) and oracle.rows_of_spark(df) == rows


def test_quality_equals_brute_force(spark, sf):
    """Counts, rates and scores again, by loops over the rows."""
    d = [(r["doc_id"], r["source"], r["lang"], quality.describe((r["text"] or "").encode())) for r in table(spark, sf, "documents").collect()]
    y = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    seen = [(b, y[i]) for i, _, _, b in d if i in y]
    t = np.full((len(quality.FEATURES), quality.BINS, 2), 0.5)
    for b, k in seen:
        for f, x in enumerate(b):
            t[f, x, k] += 1
    rate = t / t.sum(1, keepdims=True)
    llr = np.log(rate[:, :, 1] / rate[:, :, 0])
    raw = lambda b: sum(llr[f, x] for f, x in enumerate(b))
    base = (sum(k for _, k in seen) + 0.5) / (len(seen) + 1)
    z0 = np.log(base / (1 - base))
    loss = lambda f: np.mean([np.log1p(np.exp(-(z0 + f * raw(b)) * (1 if k else -1))) for b, k in seen])
    factor = min((0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0), key=loss)
    ev = {i: factor * raw(b) for i, _, _, b in d}
    p = {i: 1 / (1 + np.exp(-(z0 + e))) for i, e in ev.items()}

    def shrunk(groups):  # name: (n, s, prior)
        n = sum(g[0] for g in groups.values())
        between = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups.values()) / n
        spread = max(between - sum(g[2] * (1 - g[2]) for g in groups.values()) / n, 1e-6)
        m = min(max(sum(g[0] * g[2] * (1 - g[2]) for g in groups.values()) / n / spread - 1, 1.0), 1e6)
        return {k: (g[1] + m * g[2]) / (g[0] + m) for k, g in groups.items()}, m

    sums = lambda key: {k: (len(v), sum(v)) for k, v in _grouped(d, key, p).items()}
    hosts, _ = shrunk({k: (*g, base) for k, g in sums(lambda r: r[1]).items()})
    paths = sums(lambda r: (r[1], r[2]))
    rates, m = shrunk({k: (*g, hosts[k[0]]) for k, g in paths.items()})
    for r in quality.op5_bayes_quality(table(spark, sf, "documents"), table(spark, sf, "labels")).collect():
        k = r["host"], r["path"]
        n, s = paths[k]
        rest = min(max((s - p[r["doc_id"]] + m * hosts[k[0]]) / (n - 1 + m), 1e-4), 1 - 1e-4)
        want = 1 / (1 + np.exp(-(np.log(rest / (1 - rest)) + ev[r["doc_id"]])))
        assert abs(r["host_rate"] - hosts[k[0]]) < 1e-9 and abs(r["path_rate"] - rates[k]) < 1e-9 and abs(r["score"] - want) < 1e-9


def _grouped(rows, key, value):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(value[r[0]])
    return out


@pytest.mark.parametrize("name", ["op1_vp_tree", "op10_fm_index", "op11_block_max_wand", "op12_warc_captures", "op13_repair"])
def test_queries_are_registered(name):
    import __spark_entry__ as e

    assert name in e.queries() and "pipeline" in e.queries()


def test_repeated_members_count_once(spark):
    rows = [(1, [10, 20]), (1, [10, 20]), (2, [10, 30]), (3, [10, 30]), (4, [40]), (4, [40])]
    seen = _links._met(spark.createDataFrame(rows, "node long, buckets array<long>")).collect()
    assert sorted((r["bucket"], r["node"], r["n"]) for r in seen) == [(10, 1, 3), (10, 2, 3), (10, 3, 3), (30, 2, 2), (30, 3, 2)]
    assert [(r["node"], r["other"]) for r in seen if r["other"] is not None] == [(2, 3)]


def test_lines_are_told_apart_by_their_whole_digest(spark, monkeypatch):
    """Lines whose digests agree in one half are different lines still, also if they repeat in other tasks."""
    texts = ["alpha beta gamma delta\nsomething else entirely", "alpha beta gamma delta", "one two three four five six seven eight nine", "one two three four five six seven eight ninE!"]
    df = docs(spark, *texts).repartition(4)
    want = sorted(map(tuple, line_dedup.op6_fuzzy_lines(df).collect()))
    whole = line_dedup._texts(line_dedup.lines(df).where("n IS NOT NULL"), "hi", "lo").count()
    same = line_dedup.lines(df).withColumn("lo", F.when(F.col("lo").isNotNull(), F.lit(7)).cast("long"))
    monkeypatch.setattr(line_dedup, "lines", lambda _: same)
    assert whole == 4
    assert sorted(map(tuple, line_dedup.op6_fuzzy_lines(df).collect())) == want
    assert len({x[2:4] for x in want}) == 3


def test_lines_are_written_and_dealt_once(spark, monkeypatch):
    """The bodies of lines that meet no other are in one work table only."""
    tables = {}

    def spy(df, tag, *how):
        tables[tag] = df
        return materialize(df, tag, *how)

    monkeypatch.setattr(line_dedup, "materialize", spy)
    d = docs(spark, "alpha beta gamma delta", "something else entirely\nalpha  beta gamma delta")
    assert line_dedup.op6_fuzzy_lines(d).where("keep").count() == 2
    assert [t for t, df in tables.items() if "body" in df.columns] == ["lines"]
