"""Near-duplicate documents by consistent weighted sampling of word shingles, weighted by TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismlake.llm._links import Bag, classes as connected
from prismlake.llm._shared import WordHash, discard, in_mask, mask_of, materialize, mixed, shingle_hashes, trim, utf8_rows, word_hashes

#: Bands of rows: a pair of similarity 0.8 meets in a band with probability 0.998.
BANDS, ROWS = 12, 4
#: Document frequencies of words are counted in so many hash buckets, whatever the corpus.
BUCKETS = 1 << 20
#: Entries of each table of random variates; a shingle and a sample number choose one entry for r, another one for c and b.
VARIATES = 1 << 13
#: Words handled at once.
AT_ONCE = 1 << 16
#: Steps in which inverse document frequencies are told apart: of words, and of shingles.
WORD_STEP, STEP = 64, 8


def _runs(batch: pa.RecordBatch, known: WordHash) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """In runs of rows: the first row, the hashes of all words one after another, and how many words each row has."""
    hashes, first, n = [], 0, 0
    rows = list(utf8_rows(batch.column("text")))
    for i, t in enumerate(rows):
        hashes.append(word_hashes(t or b"", known))
        n += len(hashes[-1])
        if n >= AT_ONCE or i == len(rows) - 1:
            yield first, np.concatenate(hashes), np.array([len(h) for h in hashes])
            hashes, first, n = [], i + 1, 0


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a word in each of 2^20 hash buckets, over all documents, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(BUCKETS, np.int64), WordHash()
        for b in batches:
            for _, h, sizes in _runs(b, known):
                row = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(20), sizes)
                key = np.unique(row | (h & np.uint64(BUCKETS - 1)))
                total += np.bincount((key & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            trim()
        hit = np.flatnonzero(total)
        for a in range(0, len(hit), 1 << 16):
            some = hit[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2^20 rows
    out = np.zeros(BUCKETS, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out, docs.count()


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    """ln((n + 1) / (df + 1)) + 1 of each bucket of words, in steps of 1/64."""
    return np.rint(WORD_STEP * (np.log((n + 1) / (np.minimum(df, n) + 1)) + 1)).astype(np.int64)


def _shingles(batch: pa.RecordBatch, known: WordHash, width: int, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In runs of rows: the first row, 32-bit shingles sorted within each row, their idf in steps, how often each occurs, and how many each row has.

    The idf of a shingle is the mean of its words', rounded to 1/8.
    """
    for first, h, sizes in _runs(batch, known):
        s, per = shingle_hashes(h, sizes, width)
        before = np.concatenate([[0], np.cumsum(idf[(h & np.uint64(BUCKETS - 1)).astype(np.int64)])])
        start = np.repeat(np.cumsum(sizes) - sizes, per) + np.arange(len(s)) - np.repeat(np.cumsum(per) - per, per)
        long = np.minimum(np.repeat(sizes, per), width)
        step = WORD_STEP // STEP
        code = np.minimum(((before[start + long] - before[start]) // long + step // 2) // step, 255).astype(np.uint64)
        key = np.sort(np.repeat(np.arange(len(per), dtype=np.uint64) << np.uint64(40), per) | (s >> np.uint64(32)) << np.uint64(8) | code)
        both = key >> np.uint64(8)
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.concatenate([new, [len(key)]]))
        own = both[new]
        yield first, (own & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key[new] & np.uint64(255)).astype(np.uint8), tf, np.bincount((own >> np.uint64(32)).astype(np.int64), minlength=len(per))


def _variates(samples: int) -> tuple[np.ndarray, ...]:
    """For the samples: two odd factors that choose entries, and in tables gamma(2, 1) r, its inverse, ln of gamma(2, 1) c and uniform b."""
    g = np.random.default_rng([20240229, 0])
    odd = g.integers(1, 1 << 32, (2, samples), np.uint64).astype(np.uint32) | np.uint32(1)
    r = g.gamma(2.0, 1.0, (samples, VARIATES)).astype(np.float32)
    return odd[0], odd[1], r, 1 / r, np.log(g.gamma(2.0, 1.0, (samples, VARIATES))).astype(np.float32), g.random((samples, VARIATES), np.float32)


def signatures(s: np.ndarray, weight: np.ndarray, per: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """Improved consistent weighted sampling: a row of hashes of (shingle, level) for each row that has shingles.

    For each sample the level t = floor(ln w / r + b) and the value ln c - r (t + 1 - b) are computed for
    all shingles; the shingle of least value is drawn together with t. Two rows draw alike with
    the probability of their weighted Jaccard similarity.
    """
    has = per > 0
    start = (np.cumsum(per) - per)[has]
    row = np.repeat(np.arange(len(start)), per[has])
    log_w = np.log(weight).astype(np.float32)
    wide = s.astype(np.uint64)
    out = np.zeros((len(start), len(tables[0])), np.uint64)
    shift = np.uint32(32 - VARIATES.bit_length() + 1)
    for k, (odd, other, r, inverse, c, b) in enumerate(zip(*tables, strict=True)):
        e, f = (s * odd >> shift).astype(np.int64), (s * other >> shift).astype(np.int64)
        rb = b[f]
        t = np.floor(log_w * inverse[e] + rb)
        value = c[f] - r[e] * (t + 1 - rb)
        least = np.minimum.reduceat(value, start)
        hit = np.flatnonzero(value == least[row])
        first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]  # of equal values the least shingle
        out[:, k] = mixed(wide[first] ^ (t[first].astype(np.int64).astype(np.uint64) << np.uint64(32)))
    return out


def banded(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket for each band: a hash of the band's number and rows."""
    with np.errstate(over="ignore"):
        out = np.zeros((len(sig), bands), np.uint64)
        for b in range(bands):
            h = np.full(len(sig), b + 1, np.uint64)
            for r in range(rows):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
            out[:, b] = h
    return out.view(np.int64)


def weights(tf: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * code / STEP


def _blob(s: np.ndarray, code: np.ndarray, tf: np.ndarray) -> bytes:
    return np.uint32(len(s)).tobytes() + s.tobytes() + np.minimum(tf, 0xFFFFFFFF).astype(np.uint32).tobytes() * bool((tf > 1).any()) + code.tobytes()


def bags(blobs: list[bytes]) -> list[Bag]:
    """Shingles and weights of payloads: their number, 32-bit hashes, counts (left out if all are 1) and idf in steps."""
    out = []
    for x in blobs:
        n = int(np.frombuffer(x, np.uint32, 1)[0])
        tf = np.frombuffer(x, np.uint32, n, 4 + 4 * n) if len(x) > 4 + 5 * n else np.ones(n)
        out.append((np.frombuffer(x, np.uint32, n, 4), weights(tf, np.frombuffer(x, np.uint8, n, len(x) - n))))
    return out


def _payloads(docs: DataFrame, wanted: DataFrame, width: int, idf) -> DataFrame:
    """(node, blob, total): the weighted shingles of the texts in wanted (node, md5, doc_id), and all their weight, from a second look at docs.

    A bitmap of fixed size (2 MB) tells nearly all other texts apart before they are shingled; the join
    decides. However full the bitmap gets, the result is the same. Rows equal in doc_id and text give one payload.
    """
    h = F.xxhash64("md5", "doc_id").alias("h")
    mask = mask_of(wanted.select(h))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            some = b.filter(pa.array(in_mask(b.column("h").to_numpy(), mask.value)))
            for first, s, code, tf, per in _shingles(some, known, width, idf.value):
                ends = np.cumsum(per)
                blobs = [_blob(s[e - n : e], code[e - n : e], tf[e - n : e]) for e, n in zip(ends.tolist(), per.tolist(), strict=True)]
                total = np.bincount(np.repeat(np.arange(len(per)), per), weights(tf, code), len(per))
                rest = some.slice(first, len(per))
                yield pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("md5"), pa.array(blobs, pa.binary()), pa.array(total)], names=["doc_id", "md5", "blob", "total"])
            trim()

    own = docs.where("md5 IS NOT NULL").select("doc_id", "md5", h, "text").mapInArrow(build, "doc_id long, md5 string, blob binary, total double").alias("d")
    match = (F.col("d.md5") == F.col("w.md5")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    found = own.join(wanted.alias("w").hint("merge"), match).select("node", "blob", "total")
    return found.groupBy("node").agg(F.any_value("blob").alias("blob"), F.any_value("total").alias("total"))


def _classes(docs: DataFrame, least: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, md5) of every row, and of every distinct text its class: (md5, class_id, head, class_size), both written.

    Texts that are equal byte for byte are one class from the start. Different texts are linked if
    they meet in a band and their weighted Jaccard similarity is `least` or more, computed
    on all their shingles; classes are the connected components of links. Words are lower-cased runs
    of letters and digits; shingles are `width` words, or all words of a shorter text. The weight of a
    shingle is 1 + ln of its count, times its inverse document frequency. That is the mean of its
    words', ln((N + 1) / (df + 1)) + 1, with frequencies of all documents in 2^20 hash buckets: a
    shingle's own frequency is little but the size of its family of copies, whose shared
    text would then weigh less than its members' few own words.
    class_id is the least doc_id of the class (null only if all its doc_ids are null), head the text that has it.

    Null texts are one class each to themselves by their doc_id; empty texts and texts without words
    match equal texts only. Rows with equal doc_id and text are rows of one class. Texts of any length are
    taken whole. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    df, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(inverse_frequencies(df, n))  # 8 MB

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = _variates(bands * rows), WordHash()
        for b in batches:
            for first, s, code, tf, per in _shingles(b, known, width, idf.value):
                has = np.flatnonzero(per > 0)
                keys = banded(signatures(s, weights(tf, code), per, tables), bands, rows) if len(has) else np.zeros((0, bands), np.int64)
                own: list[np.ndarray | None] = [None] * len(per)
                for j, i in enumerate(has.tolist()):
                    own[i] = keys[j]
                rest = b.slice(first, len(per))
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in ("uid", "doc_id", "md5")), pa.array(own, pa.list_(pa.int64()))], names=["uid", "doc_id", "md5", "bands"])
            trim()

    md5 = F.md5(F.col("text").cast("binary")).alias("md5")
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), md5, "text")
    signed = materialize(own.mapInArrow(sign, "uid long, doc_id long, md5 string, bands array<long>"), "signed")
    # one node for each distinct text: the least uid of its rows
    each = [F.min("uid").alias("node"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.any_value("bands").alias("bands")]
    texts = materialize(signed.where("md5 IS NOT NULL").groupBy("md5").agg(*each), "texts")
    members = texts.select("node", F.col("bands").alias("buckets"))

    def payloads(nodes: DataFrame) -> DataFrame:
        wanted = materialize(texts.join(nodes.hint("merge"), "node", "left_semi").select("node", "md5", "doc_id"), "wanted")
        return _payloads(docs.select(F.col("doc_id").cast("long"), md5, "text"), wanted, width, idf)

    root = connected([members], payloads, bags, least)
    grouped = texts.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("md5").alias("head")))
    heads = grouped.groupBy("root").agg(first.alias("f"), F.sum("n").alias("class_size"))
    of = grouped.select("md5", "root").join(heads, "root").select("md5", F.col("f.doc_id").alias("class_id"), F.col("f.head").alias("head"), "class_size")
    of = materialize(of, "classes")
    discard(texts, root)
    return signed, of


def classes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, class_size) of every document; see `_classes`."""
    rows, of = _classes(docs, **how)
    alone = F.col("md5").isNull()
    return rows.join(of, "md5", "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """docs without near-duplicates, all columns kept: of each class the document of least doc_id stays.

    Of rows equal in doc_id and text one stays; rows with null text all stay. Columns of any name are kept.
    """
    rows, of = _classes(docs, **how)
    keep = materialize(of.where("md5 = head").select(F.col("class_id").alias("_id"), F.col("md5").alias("_k")), "keep")
    twice = rows.groupBy("doc_id", "md5").agg(F.count("*").alias("n")).where("n > 1 AND md5 IS NOT NULL").take(1)
    discard(rows, of)
    match = F.col("d._id").eqNullSafe(F.col("k._id")) & (F.col("d._k") == F.col("k._k"))
    every = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_d"), F.col("doc_id").cast("long").alias("_id"), F.md5(F.col("text").cast("binary")).alias("_k"))
    found = every.where("_k IS NOT NULL").alias("d").join(keep.alias("k"), match, "left_semi")
    if twice:
        found = found.dropDuplicates(["_id", "_k"])
    return found.union(every.where("_k IS NULL")).select("_d.*")


def op7_icws_near_dedup(docs: DataFrame) -> DataFrame:
    """Every document with its near-duplicate class. See `classes`."""
    return classes(docs).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
