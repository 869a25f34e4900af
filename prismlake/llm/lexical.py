"""Ranked lexical search: Block-Max WAND over compressed posting blocks, one index for each shard of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from prismlake.functions import varints
from prismlake.llm._shared import finished, materialize, utf8_rows, word_pieces

#: Postings of one compressed block.
BLOCK = 128
#: Terms, repeats included, of one shard; a shard ends with the document that fills it.
SHARD_TERMS = 1 << 22
#: Distinct terms of items that are searched at once, about; more items take further passes over their terms' postings.
QUERY_TERMS = 1 << 18
#: One shard in so many is searched first; what it finds is the threshold from which the others start.
AHEAD = 16

_INDEX = "shard long, term binary, df int, head binary, data binary"
_FOUND = "item int, item_id long, doc_id long, score long"


class Index(NamedTuple):
    """rows: one for each term of each shard, and one with null term for the documents of a shard; documents and terms of all shards."""

    rows: DataFrame
    documents: int
    terms: int


class _Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """How much a document of n terms is damped: 100 for the average, a quarter of it in proportion to n."""
    return 75 + (25 * n * documents) // terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def counts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for b in batches:
            for t in utf8_rows(b.column(0)):
                n = sum(map(len, word_pieces(t)))
                docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], names=["docs", "terms"])

    rows = docs.select(docs[f"`{text}`"].alias("text")).where("text IS NOT NULL")
    r = rows.mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes that follow each other, up to their ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _shard_rows(shard: int, ids: list[int | None], sizes: list[int], parts: list[np.ndarray], known: list[bytes], documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard: documents first, then each term with its blocks.

    A block's head is (last document, highest impact, first byte) as three ints; its body has the distance to
    the document before, less one, and the frequency, less one, for each posting.
    """
    n = np.array(sizes, np.int64)
    m = lengths(n, documents, terms)
    # a document without doc_id has a negative size
    own = np.array([i or 0 for i in ids], np.int64), np.where([i is None for i in ids], -n, n)
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([None], pa.binary()), pa.array([len(n)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in own]], names=["shard", "term", "df", "head", "data"])
    key = np.concatenate(parts).astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n)
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(at, len(key)))
    term, doc = np.divmod(key[at], len(n))
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    df = np.diff(np.append(first, len(term)))
    place = np.arange(len(term)) - np.repeat(first, df)
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first] + 1
    begin = np.flatnonzero(place % BLOCK == 0)
    data, used = varints.encode(np.stack([gap - 1, tf - 1], 1).ravel())
    byte = np.cumsum(used[::2] + used[1::2])
    start = byte - used[::2] - used[1::2]
    last = np.append(begin[1:], len(term)) - 1
    head = np.stack([doc[last], np.maximum.reduceat(impacts(tf, m[doc]), begin), start[begin] - np.repeat(start[first], -(-df // BLOCK))], 1).astype(np.int32)
    out = pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(df), shard)), pa.array(known, pa.binary()), pa.array(df.astype(np.int32)), _binary(head, 12 * np.cumsum(-(-df // BLOCK))), _binary(data, byte[first + df - 1])],
        names=["shard", "term", "df", "head", "data"],
    )
    for a in range(0, len(df), 1 << 16):
        yield out.slice(a, 1 << 16)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_terms: int = SHARD_TERMS) -> Index:
    """An index of docs, written to the shared folder.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. Each task
    cuts its documents into shards of about `shard_terms` terms and writes every term's postings of a shard, in
    blocks of 128 with the highest impact of each, so nothing is shuffled and a task holds one shard. Counts of
    documents and terms come first, since impacts depend on them.

    Null and empty texts and texts without a term aren't in the index; rows with null doc_id are; repeated rows are
    documents of their own. A text of any length is read whole. An empty table gives an empty index; other columns
    aren't read.
    """
    documents, terms = counts(docs, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, sizes, parts, known, held = TaskContext.get().partitionId() << 32, [], [], [], _Numbers(), 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), utf8_rows(b.column(1)), strict=True):
                own = [np.fromiter(map(known.__getitem__, p), np.int32, len(p)) for p in word_pieces(t)]
                n = sum(map(len, own))
                if n:
                    ids.append(i)
                    sizes.append(n)
                    parts += own
                    held += n
                if held >= shard_terms:
                    yield from _shard_rows(shard, ids, sizes, parts, list(known), documents, terms)
                    shard, ids, sizes, parts, known, held = shard + 1, [], [], [], _Numbers(), 0
        if held:
            yield from _shard_rows(shard, ids, sizes, parts, list(known), documents, terms)

    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).where("text IS NOT NULL")
    return Index(materialize(rows.mapInArrow(cut, _INDEX), "lexical"), documents, terms)


class Postings:
    """A term's postings in one shard. Heads of blocks are read at once, a block's body when it is first needed."""

    def __init__(self, df: int, head: bytes, data: bytes):
        h = np.frombuffer(head, np.int32).reshape(-1, 3)
        self.last, self.peak, self.start = h[:, 0].astype(np.int64), np.append(h[:, 1], 0).astype(np.int64), np.append(h[:, 2], len(data))
        self.df, self.data, self.read = df, np.frombuffer(data, np.uint8), np.zeros(len(h), bool)
        self.doc = self.impact = np.zeros(0, np.int64)

    def _places(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.minimum(self.df - blocks * BLOCK, BLOCK)
        return size, np.repeat(blocks * BLOCK - np.cumsum(size) + size, size) + np.arange(size.sum())

    def decompressed(self, blocks: np.ndarray, m: np.ndarray) -> np.ndarray | slice:
        """Where the postings of blocks are in `doc` and `impact`; m is of the shard's documents."""
        todo = blocks[~self.read[blocks]]
        if len(todo):
            if not len(self.doc):
                self.doc, self.impact = np.empty(self.df, np.int64), np.empty(self.df, np.int64)
            size, at = self._places(todo)
            whole = todo[-1] - todo[0] + 1 == len(todo)
            raw = self.data[self.start[todo[0]] : self.start[todo[-1] + 1]] if whole else np.concatenate([self.data[a:b] for a, b in zip(self.start[todo], self.start[todo + 1], strict=True)])
            values = varints.decode(raw)
            gap, tf = values[::2] + 1, values[1::2] + 1
            first, run = np.cumsum(size) - size, np.cumsum(gap)
            before = np.where(todo > 0, self.last[todo - 1], -1)
            doc = run + np.repeat(before - run[first] + gap[first], size)
            self.doc[at], self.impact[at] = doc, impacts(tf, m[doc])
            self.read[todo] = True
        return slice(0, self.df) if len(blocks) == len(self.read) else self._places(blocks)[1]


class Shard:
    """The documents of a shard and the postings of some terms."""

    def __init__(self, ids: bytes, sizes: bytes, documents: int, terms: int):
        n = np.frombuffer(sizes, np.int64)
        self.ids, self.null = np.frombuffer(ids, np.int64), n < 0
        self.m, self.lists = lengths(np.abs(n), documents, terms), {}
        self.scores = np.zeros(len(n), np.int64)

    def best(self, terms: list[int], weights: list[int], k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the k best of score `floor` or more.

        Between two ends of blocks, whichever lists they belong to, every list lies in one block. So a shallow
        move over heads alone gives each such range the sum of its blocks' highest impacts, which no document in it
        exceeds. Ranges are taken from the highest sum down, in growing steps; once a sum is below the threshold,
        which is the k-th best score so far, no block of that range or of a later one is decompressed.
        """
        lists = [(self.lists[t], w) for t, w in zip(terms, weights, strict=True) if w > 0 and t in self.lists]
        docs = scores = np.zeros(0, np.int64)
        if not lists:
            return docs, scores
        ends = np.unique(np.concatenate([p.last for p, _ in lists]))
        where = [np.searchsorted(p.last, ends) for p, _ in lists]  # as many as there are blocks: none
        bound = sum(w * p.peak[b] for (p, w), b in zip(lists, where, strict=True))
        order = np.argsort(-bound, kind="stable")
        threshold, at, step = max(floor, 1), 0, 8
        while at < len(order) and bound[order[at]] >= threshold:
            some = order[at : at + step]
            some = some[bound[some] >= threshold]
            at, step = at + step, step * 4
            live = np.zeros(len(ends), bool)
            live[some] = True
            touched = []
            for (p, w), b in zip(lists, where, strict=True):
                need = np.zeros(len(p.peak), bool)
                need[b[some]] = True
                blocks = np.flatnonzero(need[:-1])
                if len(blocks):
                    rows = p.decompressed(blocks, self.m)
                    doc, gain = p.doc[rows], w * p.impact[rows]
                    if len(some) < len(ends):
                        keep = live[np.searchsorted(ends, doc)]
                        doc, gain = doc[keep], gain[keep]
                    self.scores[doc] += gain
                    touched.append(doc)
            new = np.unique(np.concatenate(touched)) if sum(map(len, touched)) * 8 < len(self.m) else np.flatnonzero(self.scores)
            s = self.scores[new]
            self.scores[new] = 0
            docs, scores = np.concatenate([docs, new[s >= threshold]]), np.concatenate([scores, s[s >= threshold]])
            if len(docs) > k:
                threshold = max(threshold, int(np.partition(scores, -k)[-k]))
                docs, scores = docs[scores >= threshold], scores[scores >= threshold]
        top = np.lexsort((self.ids[docs], self.null[docs], -scores))[:k]
        return docs[top], scores[top]


class _Items(NamedTuple):
    """Items of one pass: their ids, the numbers of all terms, and each item's terms with weights times occurrences."""

    ids: list[int | None]
    number: dict[bytes, int]
    terms: list[list[int]]
    weights: list[list[int]]


def _answers(shard: Shard, items: _Items, k: int, floors: list[int]) -> pa.RecordBatch:
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i, (terms, weights) in enumerate(zip(items.terms, items.weights, strict=True)):
        docs, scores = shard.best(terms, weights, k, floors[i])
        for column, x in zip(out, (np.full(len(docs), i, np.int32), shard.ids[docs], shard.null[docs], scores), strict=True):
            column.append(x)
    item, doc, null, score = (np.concatenate(x) for x in out)
    return pa.RecordBatch.from_arrays([pa.array(item), pa.array([items.ids[i] for i in item.tolist()], pa.int64()), pa.array(doc, mask=null), pa.array(score)], names=["item", "item_id", "doc_id", "score"])


def _searched(hits: DataFrame, items: _Items, index: Index, shards: int, k: int, floors: dict[int, int]) -> DataFrame:
    """(item, item_id, doc_id, score): each shard's best; a task reads its shards one after another."""
    shared = hits.sparkSession.sparkContext.broadcast((items, [floors.get(i, 1) for i in range(len(items.ids))]))  # at most about QUERY_TERMS terms
    documents, terms = index.documents, index.terms

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = shared.value
        at, shard = None, None
        for b in batches:
            for own, term, df, head, data in zip(*[b.column(c).to_pylist() for c in ("shard", "term", "df", "head", "data")], strict=True):
                if own != at:
                    if shard and shard.lists:
                        yield _answers(shard, items, k, floors)
                    at, shard = own, Shard(head, data, documents, terms)
                else:
                    shard.lists[items.number[term]] = Postings(df, head, data)
        if shard and shard.lists:
            yield _answers(shard, items, k, floors)

    rows = hits.repartition(max(1, min(2 * shards, 8192)), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return rows.mapInArrow(search, _FOUND)


def _terms_of(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times) of items (item_id, text); an item is a distinct row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, i, t in zip(b.column("item").to_pylist(), b.column("item_id").to_pylist(), utf8_rows(b.column("text")), strict=True):
                times: dict[bytes, int] = {}
                for piece in word_pieces(t):
                    for word in piece:
                        times[word] = times.get(word, 0) + 1
                n = len(times)
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([i] * n, pa.int64()), pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64())], names=["item", "item_id", "term", "times"])

    rows = items.where("text IS NOT NULL").distinct().withColumn("item", F.monotonically_increasing_id())
    return rows.mapInArrow(cut, "item long, item_id long, term binary, times long")


def _loaded(asked: DataFrame, df: DataFrame, documents: int) -> _Items:
    items = _Items([], {}, [], [])
    at: dict[int, int] = {}
    for r in asked.join(df, "term").toLocalIterator():  # at most about QUERY_TERMS rows
        if r["item"] not in at:
            at[r["item"]] = len(items.ids)
            items.ids.append(r["item_id"])
            items.terms.append([])
            items.weights.append([])
        i = at[r["item"]]
        items.terms[i].append(items.number.setdefault(bytes(r["term"]), len(items.number)))
        items.weights[i].append(weight(documents, r["df"]) * r["times"])
    return items


def search(index: Index, queries: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by ascending doc_id, nulls last.

    An item's score is the sum over its terms, repeats included, of floor(1000 ln((2 N + 2) / (2 df + 1))) times
    the term's impact in the document. Items are dealt to passes of about `query_terms` terms. A pass takes its terms' postings
    from all shards once. One shard in 16 is searched first; the k-th best score of an item there is a lower bound of the
    final one and the threshold from which all others start, so most of their blocks stay compressed.

    Every distinct (item_id, text) is an item, also with null item_id; null texts and texts without a term have no
    result, nor have items whose terms are in no document. Repeated items count once. Empty tables give no rows.
    """
    asked = materialize(_terms_of(queries.select(queries[f"`{item_id}`"].cast("long").alias("item_id"), queries[f"`{text}`"].alias("text"))), "asked")
    passes = max(1, -(-asked.count() // query_terms))
    out = None
    for p in range(passes):
        mine = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        need = mine.select("term", F.lit(True).alias("needed")).distinct()
        hits = materialize(index.rows.join(F.broadcast(need), "term", "left").where("needed OR term IS NULL").drop("needed"), "hits")  # at most about query_terms terms
        items = _loaded(mine, hits.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")), index.documents)
        shards = hits.where("term IS NULL").count()
        ahead = F.pmod(F.xxhash64("shard"), F.lit(AHEAD)) == 0
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        first = materialize(_searched(hits.where(ahead), items, index, -(-shards // AHEAD), k, {}), "ahead")
        kth = first.withColumn("rank", rank).where(F.col("rank") == k).select("item", "score").toLocalIterator()  # one row for each item of the pass
        found = first.union(_searched(hits.where(~ahead), items, index, shards, k, {r["item"]: r["score"] for r in kth}))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return out


def op11_block_max_wand(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract of op11: the 20 documents of highest score for each benchmark item. See `build` and `search` for odd rows."""
    return finished(documents.sparkSession, "op11", lambda: search(build(documents), benchmark))
