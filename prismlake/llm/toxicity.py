"""Toxicity of texts from their nearest labelled examples by exact cosine of TF-IDF vectors, in which terms that tell the labels apart weigh more."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from prismlake.llm._shared import discard, materialize, trim, utf8_rows, word_pieces

#: Labelled rows that are learnt from, at most: those of the least hashes.
EXAMPLES = 8_192
#: Examples in one block of a posting list.
BLOCK = 64
NEIGHBOURS = 15
#: Texts that are searched together, and words and texts that a task remembers.
GROUP, REMEMBERED, RESULTS = 64, 150_000, 4_000
#: Lengths in bytes of word beginnings that may tell labels apart; they catch inflected forms.
PREFIXES = (4, 5, 6, 7, 8)
#: A term that tells labels apart weighs more: once, and so many times the logarithm of its odds.
TELLING = 4.0


def beginnings(word: bytes) -> list[bytes]:
    return [word[:n] + b"*" for n in PREFIXES if len(word) >= n]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that have each term, over the rows of one task."""
    seen = (Counter(), Counter())
    for b in batches:
        for t, y in zip(utf8_rows(b.column("text")), b.column("toxic").to_pylist(), strict=True):
            own = {w for p in word_pieces(t or b"") for w in p}
            seen[y].update({x for w in own for x in (w, *beginnings(w))})
    terms = [t for t in seen[0].keys() | seen[1].keys()]
    for i in range(0, len(terms), 50_000):
        some = terms[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array([c[t] for t in some], pa.int64()) for c in seen)], names=["term", "n0", "n1"])


def learn_terms(examples: DataFrame, telling: float = TELLING) -> tuple[list[bytes], np.ndarray]:
    """The terms of the vector space and how much more each weighs: all words of the examples, and word beginnings that tell the labels apart.

    A term tells if its odds differ at least fourfold between the labels and a likelihood-ratio test
    finds that beyond doubt (G2 >= 25, at least 5 texts); it weighs 1 + telling * |ln odds| times as much as others.
    With telling 0 the space is that of the words, all weighing alike: plain TF-IDF.
    """
    n0, n1 = (examples.where(F.col("toxic") == y).count() for y in (0, 1))
    c = examples.select("text", "toxic").mapInArrow(_counts, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    a, b, n = F.col("a"), F.col("b"), max(n0 + n1, 1)
    odds = (b + 0.5) / (n1 + 1.0) / ((a + 0.5) / (n0 + 1.0))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    g2 = 2 * sum(part(o, e) for o, e in ((a, (a + b) * n0 / n), (b, (a + b) * n1 / n), (n0 - a, (n - a - b) * n0 / n), (n1 - b, (n - a - b) * n1 / n)))
    tells = (a + b >= 5) & (a + b < n) & ((odds >= 4) | (odds <= 0.25)) & (g2 >= 25) if n0 and n1 else F.lit(False)
    c = c.select("term", F.when(tells, F.abs(F.log(odds))).otherwise(F.lit(0.0)).alias("o"))
    chosen = (F.lit(telling > 0) & (F.col("o") > 0)) | (F.substring("term", -1, 1) != F.lit(b"*"))
    found = c.where(chosen).orderBy("term").toArrow()  # bounded by the examples
    return found.column("term").to_pylist(), 1 + telling * found.column("o").to_numpy()


class Terms:
    """How often each term of a space occurs in texts."""

    def __init__(self, terms: list[bytes]):
        self.terms, self.known = terms, None

    def __getstate__(self) -> dict:
        return {"terms": b" ".join(self.terms)}

    def __setstate__(self, state: dict) -> None:
        self.terms, self.known = state["terms"].split(), None

    def __len__(self) -> int:
        return len(self.terms)

    def _start(self) -> None:
        at = {t: i + 1 for i, t in enumerate(self.terms)}
        heads = {t[: PREFIXES[0]] for t in self.terms if t.endswith(b"*")}
        lists: list[list[int]] = [[]]

        class Known(dict):
            """The number of a word's only term, 0 for none, or less for the place of a list of several."""

            def __missing__(self, word: bytes) -> int:
                k = at.get(word, 0)
                more = [at[t] for t in beginnings(word) if t in at] if word[: PREFIXES[0]] in heads else ()
                if more:
                    lists.append([*([k] if k else ()), *more])
                    k = 1 - len(lists)
                self[word] = k
                return k

        self.lists, self.known = lists, Known()

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms of a whole text, ascending, and how often each occurs."""
        if self.known is None:
            self._start()
        elif len(self.known) > REMEMBERED:
            self.known.clear()
            del self.lists[1:]
        parts = [np.fromiter(map(self.known.__getitem__, p), np.int32, len(p)) for p in word_pieces(text)]
        u, n = np.unique(np.concatenate(parts), return_counts=True)
        several = np.searchsorted(u, 0)
        total = Counter()
        for p, m in zip(u[:several].tolist(), n[:several].tolist(), strict=True):
            for i in self.lists[-p]:
                total[i] += m
        first = np.searchsorted(u, 1)
        ids, tf = u[first:], n[first:]
        if total:
            ids, at = np.unique(np.concatenate([ids, np.fromiter(total, np.int32, len(total))]), return_inverse=True)
            tf = np.bincount(at, np.concatenate([tf, np.fromiter(total.values(), np.int64, len(total))]))
        return ids.astype(np.int64) - 1, tf.astype(np.float64)


def document_frequencies(docs: DataFrame, terms) -> np.ndarray:
    """In how many texts each term occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = terms.value
        total = np.zeros(len(space), np.int64)
        for b in batches:
            for t in utf8_rows(b.column("text")):
                if t:
                    total[space.count(t)[0]] += 1
            trim()
        hit = np.flatnonzero(total)
        for a in range(0, len(hit), 1 << 16):
            some = hit[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    sums = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # one row for each term
    out = np.zeros(len(terms.value), np.int64)
    out[sums.column("i").to_numpy()] = sums.column("n").to_numpy()
    return out


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0], ..., end[0] - 1, start[1], ..."""
    size = end - start
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


class BlockMaxIndex:
    """Inverted index of unit vectors with the largest weight of each term in each block of examples.

    Terms that over a sixteenth of the examples have are kept as full rows, and a group of queries takes
    their part of all cosines from one matrix product. A query adds the block maxima of its other terms to
    the largest such part in each block, visits the blocks of the largest sums, and then all others whose sum isn't
    below the k-th best cosine found. Bounds and candidates have a margin for single precision, and
    candidates are scored again in double, so the result is exact.
    """

    MARGIN, HEAVY = 2e-5, 16

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        # like examples stand together, which makes bounds tight
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")][:3].tolist(), i))
        self.order, self.n, self.block = np.array(order, np.int64), len(order), block
        self.vectors, self.query = [(vectors[i][0].astype(np.int32), vectors[i][1]) for i in order], np.zeros(terms)
        self.blocks = max(-(-len(order) // block), 1)
        term = np.concatenate([v[0] for v in self.vectors]).astype(np.int64) if order else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(order)), [len(v[0]) for v in self.vectors])
        weight = np.concatenate([v[1] for v in self.vectors]) if order else np.zeros(0)
        heavy = np.flatnonzero(np.bincount(term, minlength=terms) * self.HEAVY > max(self.n, self.HEAVY))
        self.row = np.full(terms, -1, np.int32)
        self.row[heavy] = np.arange(len(heavy))
        self.full = np.zeros((len(heavy), self.blocks * block), np.float32)
        at = self.row[term] >= 0
        self.full[self.row[term[at]], place[at]] = weight[at]
        term, place, weight = term[~at], place[~at], weight[~at]
        sort = np.argsort(term, kind="stable")  # by term, then by place
        term, self.place, self.weight = term[sort], place[sort].astype(np.int32), weight[sort].astype(np.float32)
        key = term * self.blocks + self.place // block
        self.low = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.high = np.append(self.low[1:], len(key)) if len(key) else self.low
        self.most = np.maximum.reduceat(self.weight, self.low) if len(key) else np.zeros(0)
        self.of = key[self.low] % self.blocks
        self.start = np.searchsorted(key[self.low] // self.blocks, np.arange(terms + 1))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0, and their cosines; ties go to the smaller example."""
        return self.nearest_all([(ids, weights)], k, [without])[0]

    def nearest_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = np.zeros((len(queries), len(self.full)), np.float32)
        for q, (ids, w) in zip(rows, queries, strict=True):
            at = self.row[ids]
            q[at[at >= 0]] = w[at >= 0]
        parts = rows @ self.full
        return [self._one(ids, w, part, k, out) for (ids, w), part, out in zip(queries, parts, without, strict=True)]

    def _one(self, ids: np.ndarray, weights: np.ndarray, part: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        light = self.row[ids] < 0
        start, end, w = self.start[ids[light]], self.start[ids[light] + 1], weights[light]
        lists, mine = _spans(start, end), np.repeat(w, end - start)
        of = self.of[lists]
        bound = part.reshape(self.blocks, self.block).max(1) + np.bincount(of, mine * self.most[lists], self.blocks)
        turn = np.argsort(-bound, kind="stable")
        seen_at, seen_s, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for some in (turn[:3], turn[3:]):
            some = some[(bound[some] > 0) & (bound[some] >= least - self.MARGIN)]
            if not len(some):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[some] = True
            own = np.flatnonzero(chosen[of])
            low, high = self.low[lists[own]], self.high[lists[own]]
            post = _spans(low, high)
            score = np.bincount(self.place[post], np.repeat(mine[own], high - low) * self.weight[post], self.blocks * self.block)
            at = (np.sort(some)[:, None] * self.block + np.arange(self.block)).ravel()
            s = score[at] + part[at]
            keep = (s > 0) & (s >= least - self.MARGIN)
            seen_at, seen_s = np.concatenate([seen_at, at[keep]]), np.concatenate([seen_s, s[keep]])
            if len(seen_s) > k:  # one more, since an example may be left out
                least = np.partition(seen_s, -k - 1)[-k - 1]
        seen_at = seen_at[seen_s >= least - self.MARGIN]
        self.query[ids] = weights
        i = self.order[seen_at]
        s = np.array([min(float(v[1] @ self.query[v[0]]), 1.0) for v in (self.vectors[x] for x in seen_at.tolist())])
        self.query[ids] = 0
        keep = (i != without) & (s > 0) if len(i) else np.zeros(0, bool)
        i, s = i[keep], s[keep]
        top = np.lexsort((i, -np.round(s, 9)))[:k]
        return i[top], s[top]


class Model:
    """Examples, their index, and how votes map to chances. Workers build the index from the examples' counts, which are small to send."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, examples: Iterable[tuple[int, np.ndarray, np.ndarray, int]], k: int = NEIGHBOURS):
        """examples: (doc_id, term numbers, counts, label)."""
        self.terms, self.idf, self.k, self.built = Terms(terms), idf, k, None
        full, bare = [], []
        for doc_id, ids, tf, label in examples:
            if len(ids):
                full.append((doc_id, ids.astype(np.int32), tf.astype(np.int32), label))
            else:
                bare.append(label)
        self.id, self.label = np.array([e[0] for e in full], np.int64), np.array([e[3] for e in full], float)
        self.per = np.array([len(e[1]) for e in full], np.int64)
        self.ids, self.tf = (np.concatenate([e[i] for e in full]) if full else np.zeros(0, np.int32) for i in (1, 2))
        n, toxic = len(full) + len(bare), float(self.label.sum()) + sum(bare)
        self.prior = (toxic + 0.5) / (n + 1) if n else 0.0
        self.none = (sum(bare) + 0.5) / (len(bare) + 1) if bare else self.prior / 2
        self.at, self.chance = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    @property
    def index(self) -> BlockMaxIndex:
        if self.built is None:
            ends = np.cumsum(self.per)
            spans = [slice(e - n, e) for e, n in zip(ends.tolist(), self.per.tolist(), strict=True)]
            self.built = BlockMaxIndex([(self.ids[x].astype(np.int64), self.unit(self.ids[x], self.tf[x])) for x in spans], max(len(self.terms), 1))
        return self.built

    def unit(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[ids]
        n = math.sqrt(float(w @ w))
        return w / n if n else w

    def votes(self, texts: list[bytes], without: list[int] | None = None) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """For each text the share of toxic examples among the nearest, each weighing by nearness, and these; the prior stands beside them.

        without: doc_ids of examples that are left out. None if there is no neighbour.
        """
        counted = [self.terms.count(t) for t in texts]
        out: list = [(None, np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        some = [i for i, c in enumerate(counted) if len(c[0]) and len(self.id)]
        for a in range(0, len(some), GROUP):
            part = some[a : a + GROUP]
            gone = [-1 if without is None else int((np.flatnonzero(self.id == without[i]).tolist() or [-1])[0]) for i in part]
            found = self.index.nearest_all([(counted[i][0], self.unit(*counted[i])) for i in part], self.k, gone)
            for i, (near, cosine) in zip(part, found, strict=True):
                if len(near):
                    w, w0 = 1 / (1.05 - cosine), 1 / 1.05
                    out[i] = (float((w @ self.label[near] + w0 * self.prior) / (w.sum() + w0)), near, cosine)
        return out

    def scores(self, texts: list[bytes]) -> list[tuple[float, list[tuple[int, float, int]]]]:
        out = []
        for vote, near, cosine in self.votes(texts):
            p = self.none if vote is None else float(np.interp(vote, self.at, self.chance))
            out.append((p, [(int(self.id[i]), float(c), int(self.label[i])) for i, c in zip(near[:3].tolist(), cosine.tolist(), strict=False)]))
        return out


def _isotonic(vote: np.ndarray, label: np.ndarray, bins: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 by vote, never falling: smoothed rates of bins, pooled where they fall."""
    if not len(vote):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    b = np.minimum((vote * bins).astype(int), bins - 1)
    pools: list[list[float]] = []
    for i in np.unique(b).tolist():
        own = b == i
        pools.append([float(vote[own].sum()), float(label[own].sum()), float(own.sum())])
        while len(pools) > 1 and (pools[-2][1] + 0.5) / (pools[-2][2] + 1) >= (pools[-1][1] + 0.5) / (pools[-1][2] + 1):
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([v / n for v, _, n in pools]), np.array([(y + 0.5) / (n + 1) for _, y, n in pools])


def held_out(doc_id="doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS, telling: float = TELLING):
    """A broadcast model of at most `examples` labelled rows outside the held-out third; equal texts of one label once."""
    spark = docs.sparkSession
    own = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.avg("toxic").alias("m")).where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)  # bounded by the parameter
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(own), "doc_id")
    first = rows.groupBy(F.md5(F.col("text").cast("binary")).alias("m"), "toxic").agg(F.min(F.struct("doc_id", "text")).alias("d"))
    kept = materialize(first.select("d.doc_id", "d.text", "toxic"), "examples")
    terms, more = learn_terms(kept, telling)
    space = Terms(terms)
    sent = spark.sparkContext.broadcast(space)
    n, df = docs.count(), document_frequencies(docs, sent)
    sent.unpersist()
    idf = (np.log((n + 1) / (df + 1)) + 1) * more
    model = Model(terms, idf, [(r["doc_id"], *space.count(r["text"].encode("utf-8", "surrogatepass")), r["toxic"]) for r in kept.orderBy("doc_id", "toxic").toLocalIterator()], k)
    shared = spark.sparkContext.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [v[0] for v in shared.value.votes([t or b"" for t in utf8_rows(b.column("text"))], b.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), b.column("toxic")], names=["vote", "toxic"])

    # each example by the others; at most `examples` numbers
    seen = kept.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(votes, "vote double, toxic int").where("vote IS NOT NULL").toArrow()
    model.at, model.chance = _isotonic(seen.column("vote").to_numpy(), seen.column("toxic").to_numpy().astype(float))
    discard(kept)
    shared.unpersist()
    return spark.sparkContext.broadcast(model)


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS, threshold: float = 0.7, keep_text: bool = False, telling: float = TELLING) -> DataFrame:
    """docs, without the text unless asked for, with score, predicted and evidence.

    At most `examples` labelled rows outside the held-out third are learnt from. All their words span
    the vector space, and beginnings of words that tell the labels apart; document frequencies are counted
    over all documents, and vectors are (1 + ln tf) * idf, times more for terms that tell (see `learn_terms`).
    The k nearest examples by exact cosine vote by nearness, and a never-falling map fitted on
    left-out examples turns votes into chances. evidence: up to three (doc_id, cosine, label), ties to the smaller doc_id.

    Null and empty texts, and texts without a word of any example, get the rate of examples without words (half the
    rate of all where there are none). Texts of any length are taken whole; equal texts get equal scores. A document with
    labels of both kinds in equal number isn't learnt from; without usable labels every score is 0. An empty
    table gives no rows. Columns of docs named score, predicted or evidence are replaced; others are kept.
    """
    shared = fit(docs, labels, examples, k, telling)
    names = [c for c in docs.columns if c not in ("score", "predicted", "evidence")]
    left = [c for c in names if keep_text or c != "text"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for b in batches:
            texts = [t or b"" for t in utf8_rows(b.column("text"))]
            keys = [xxhash.xxh3_128_digest(t) for t in texts]
            if len(known) > RESULTS:
                known.clear()
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
            known |= zip(new, shared.value.scores(list(new.values())), strict=True)
            found = [known[k] for k in keys]
            evidence = [[{"doc_id": d, "cosine": c, "label": y} for d, c, y in e] for _, e in found]
            new = [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()), pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*b.select(left).columns, *new], names=[*left, "score", "predicted", "evidence"])
            trim()

    new_fields = T.StructType.fromDDL("score double, predicted int, evidence array<struct<doc_id: long, cosine: double, label: int>>").fields
    own = docs.select(*[F.col(f"`{n}`") for n in names])
    return own.mapInArrow(rate, T.StructType([*(own.schema[n] for n in left), *new_fields]))


def op4_toxicity_knn(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of op4: a score for every document. See `score` for odd rows; a null doc_id is not held out."""
    out = score(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
