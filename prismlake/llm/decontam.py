"""Benchmark decontamination: an FM-index for each shard of training text, searched for benchmark phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from prismlake.llm._shared import WORD_BYTES, discard, materialize, utf8_rows, word_pieces, words

#: Symbols of one shard's text; a shard ends with the document that fills it.
SHARD_SYMBOLS = 1 << 18
#: One text position in so many has its suffix position kept.
SAMPLE = 16
#: Phrases broadcast at once, about; a larger benchmark is searched in further passes over the documents.
PHRASES_AT_ONCE = 200_000


class WaveletTree:
    """Rank of symbols in a sequence: one level for each bit, each level stably parted by its bit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels, at = bits, [], sequence
        for b in range(bits - 1, -1, -1):
            ones = (at >> b & 1).astype(bool)
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            self.levels.append((before, len(at) - int(before[-1])))
            at = np.concatenate([at[~ones], at[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start, end = np.zeros_like(place), place
        for b, (before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> b & 1).astype(bool)
            s, e = before[start], before[end]
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def get(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its occurrences before that place."""
        symbol, at, start = np.zeros_like(place), place, np.zeros_like(place)
        for before, zeros in self.levels:
            one = before[at + 1] > before[at]
            symbol = symbol << 1 | one
            a, s = before[at], before[start]
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + s, start - s)
        return symbol, at - start


class FMIndex:
    """Backward search over a sequence of symbols above 0, in which 0 ends every piece.

    Inside, every symbol is one more, and a single 0 ends the whole: repeats of a block then differ in where they end.
    """

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.append(text + 1, 0)
        self.n = len(text)
        order = suffix_order(text)
        bwt = text[order - 1]
        self.bits = int(symbols + 1).bit_length()
        self.tree = WaveletTree(bwt, self.bits)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 2))])
        kept = order % sample == 0
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.kept_at = kept, order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; phrases are right-aligned rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            step = alive[lengths[alive] >= phrases.shape[1] - j]
            if not len(step):
                break
            c = phrases[step, j] + 1
            low[step] = self.below[c] + self.tree.rank(c, low[step])
            high[step] = self.below[c] + self.tree.rank(c, high[step])
            alive = alive[high[alive] > low[alive]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back through the text to the next kept position."""
        out, at, steps = np.full(len(rows), -1, np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            found = self.kept[at[todo]]
            hit = todo[found]
            out[hit] = self.kept_at[self.kept_before[at[hit]]] + steps
            todo = todo[~found]
            symbol, before = self.tree.get(at[todo])
            at[todo] = self.below[symbol] + before
            steps += 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a text in order, by doubling the compared length; its last symbol occurs nowhere else."""
    n = len(text)
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1) + rank[(np.arange(n) + width) % n]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        width *= 2
        if new[-1] == n - 1:
            return order


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(phrase, items): every distinct window of the items, its words with a blank between, and the sorted ids of items that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column("item").to_pylist(), utf8_rows(b.column("text")), strict=True):
                w = words(t)
                for a in range(0, max(len(w) - window, 0) + 1 if w else 0, 8192):
                    some = [b" ".join(w[i : i + window]) for i in range(a, min(a + 8192, max(len(w) - window, 0) + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([item] * len(some), pa.string())], names=["phrase", "item"])

    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(cut, "phrase binary, item string").groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Phrases:
    """Distinct phrases as right-aligned rows of symbols, with the items that have each."""

    def __init__(self, found: list[tuple[bytes, list[str]]], window: int):
        self.items = [x for _, x in found]
        own = [p.split() for p, _ in found]
        self.symbol: dict[bytes, int] = {}
        self.length = np.array([len(w) for w in own], np.int64)
        self.least = int(self.length.min()) if own else 0
        self.rows = np.zeros((len(own), window), np.int64)
        for row, w in zip(self.rows, own, strict=True):
            row[window - len(w) :] = [self.symbol.setdefault(x, len(self.symbol) + 1) for x in w]


def _shard(texts: list[tuple[np.ndarray, np.ndarray]], p: Phrases) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (its symbols and their word numbers): first words, lengths and phrases of what the shard's index finds."""
    empty = (np.zeros(0, np.int64),) * 3
    if not any(len(s) for s, _ in texts):
        return [empty] * len(texts)
    text = np.concatenate([s for s, _ in texts])
    index = FMIndex(text, len(p.symbol))
    low, high = index.search(p.rows, p.length)
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    at = index.locate(np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + low[phrase])
    order = np.argsort(at, kind="stable")
    at, phrase = at[order], phrase[order]
    first = np.concatenate([[0], np.cumsum([len(s) for s, _ in texts])])
    cut = np.searchsorted(at, first)
    return [(w[at[a:b] - f], p.length[phrase[a:b]], phrase[a:b]) if b > a else empty for (_, w), a, b, f in zip(texts, cut, cut[1:], first, strict=False)]


def _symbols(text: bytes, p: Phrases) -> tuple[np.ndarray, np.ndarray, int]:
    """The stretches of a text that any phrase could lie in, with a 0 after each, their word numbers, and the number of words.

    A word of no phrase ends a stretch, and a stretch shorter than the shortest phrase holds none, so
    leaving both out changes no result.
    """
    get, parts, n = p.symbol.get, [], 0
    for piece in word_pieces(text):
        parts.append(np.fromiter(map(get, piece, repeat(0)), np.int32, len(piece)))
        n += len(piece)
    s = np.concatenate(parts) if len(parts) > 1 else parts[0]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], s != 0, [0]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= max(p.least, 1)
    starts, ends = starts[long], ends[long]
    size = ends - starts + 1
    where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    out = np.concatenate([s, [0]])[where].astype(np.int64)
    out[np.cumsum(size) - 1] = 0
    return out, where, n


def merged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removal spans [first word, end word) that cover what overlaps or touches."""
    if not len(start):
        return start, start
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate((start + length)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([new[1:], [True]])]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs, without `text` unless asked for, with n_words long, items array<string> (sorted) and spans array<struct<first, end>>, word numbers.

    A phrase is `window` consecutive words of an item, or all words of a shorter item; windows are cut and
    made distinct in Spark. Every task cuts its documents into shards of about 2^18 symbols, builds an
    FM-index of each (suffixes by prefix doubling, ranks by a wavelet tree over the transformed text,
    one suffix position in 16 kept) and searches all phrases backwards at once; spans of a document that
    overlap or touch are merged. Memory is bounded by a shard and its longest document, and by
    200,000 phrases, which go to the tasks by broadcast: a larger benchmark is dealt to several passes over
    the documents, each of which is written and adds its spans to what the ones before it found.

    Null texts have no words. Items that are null, or without words, have no phrase; an item_id given
    twice counts once. Empty tables give empty or untouched results; equal rows get equal results. Columns
    of docs named n_words, items or spans are replaced, others are kept.
    """
    found = materialize(windows(benchmark, window), "phrases")
    passes = max(1, -(-found.count() // PHRASES_AT_ONCE))
    names = [c for c in docs.columns if c not in ("n_words", "items", "spans", text)]
    rows = docs.select(*[docs[f"`{c}`"] for c in names], docs[f"`{text}`"])
    for k in range(passes):
        some = found if passes == 1 else found.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == k)
        block = Phrases([(bytes(r["phrase"]), list(r["items"])) for r in some.orderBy("phrase").toLocalIterator()], window)
        last = k == passes - 1
        before, rows = rows, _searched(rows, block, text, keep_text or not last, k > 0)
        if not last:
            rows = materialize(rows, "scanned")
            discard(before)
    order = [c for c in docs.columns if c in names or (keep_text and c == text)]
    return rows.select(*[rows[f"`{c}`"] for c in order], "n_words", "items", "spans")


def _searched(docs: DataFrame, block: Phrases, text: str, keep_text: bool, again: bool) -> DataFrame:
    """docs with what the phrases of one block find in them, beside the items and spans of earlier passes."""
    names = [c for c in docs.columns if c not in ("n_words", "items", "spans") and (keep_text or c != text)]
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most PHRASES_AT_ONCE phrases

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        kept, held, symbols = [], [], 0

        def out() -> pa.RecordBatch:
            items, pairs = [], []
            for (start, length, phrase), h in zip(_shard([h[1] for h in held], p), held, strict=True):
                own, spans = h[2], h[3]
                items.append(sorted(own.union(*(p.items[x] for x in np.unique(phrase).tolist()))))
                s, e = merged(np.concatenate([start, spans[:, 0]]), np.concatenate([length, spans[:, 1] - spans[:, 0]]))
                pairs.append([{"first": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
            new = [pa.array([h[0] for h in held], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(pairs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]
            table = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*table.columns, *new], names=[*names, "n_words", "items", "spans"])

        for batch in batches:
            rest = batch.select(names)
            start = 0
            items = batch.column("items").to_pylist() if again else [[]] * batch.num_rows
            spans = batch.column("spans").to_pylist() if again else [[]] * batch.num_rows
            for i, t in enumerate(utf8_rows(batch.column(text))):
                s, where, n = _symbols(t or b"", p)
                held.append((n, (s, where), set(items[i]), np.array([(x["first"], x["end"]) for x in spans[i]], np.int64).reshape(-1, 2)))
                symbols += len(s)
                if symbols >= SHARD_SYMBOLS or len(held) >= 20_000:
                    kept.append(rest.slice(start, i + 1 - start))
                    start = i + 1
                    yield out()
                    kept, held, symbols = [], [], 0
            if start < batch.num_rows:
                kept.append(rest.slice(start))
        if held:
            yield out()

    new = T.StructType.fromDDL("n_words long, items array<string>, spans array<struct<first: long, end: long>>").fields
    return docs.mapInArrow(find, T.StructType([*(docs.schema[n] for n in names), *new]))


def contaminated(n_hit, n_words):
    """The rule: at least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def n_hit(spans="spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])


def without_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs whose text lacks the words of its spans; what lies between kept words stays as it is."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, new = b.schema.get_field_index(text), []
            for t, s in zip(utf8_rows(b.column(text)), b.column(spans).to_pylist(), strict=True):
                if t is None or not s:
                    new.append(None if t is None else t.decode("utf-8", "replace"))
                    continue
                ink = np.frombuffer(t.translate(WORD_BYTES), np.uint8) != 0x20
                edge = np.flatnonzero(np.diff(np.concatenate([[0], ink, [0]]).astype(np.int8)))
                keep, at = [], 0
                for x in s:
                    keep.append(t[at : edge[2 * x["first"]]])
                    at = int(edge[2 * x["end"] - 1])
                new.append(b"".join([*keep, t[at:]]).decode("utf-8", "replace"))
            yield b.set_column(k, text, pa.array(new, pa.string()))

    return docs.mapInArrow(cut, docs.schema)


def op10_fm_index(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Contract of op10: for every document the words hit, the items found and the verdict. See `scan` for odd rows."""
    found = scan(docs.select("doc_id", "text"), benchmark, window).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
