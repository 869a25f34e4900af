"""Fuzzy line deduplication by MinHash over character shingles."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from prismlake.llm._links import Bag, Entries, classes, sketches
from prismlake.llm._shared import discard, in_mask, mask_of, materialize, mixed, utf8_rows

#: Bands of rows: a pair of similarity 0.8 meets in a band with probability 0.9997.
#: Fewer rows would let many lines of one language meet by chance.
BANDS, ROWS = 27, 6
#: Characters of one shingle of a normalised line.
WIDTH = 5
#: Bytes handled at once, and characters whose shingles are hashed at once (their hashes stay in the cache).
AT_ONCE, POINTS = 1 << 16, 1 << 13
#: Bytes of different lines that a task remembers.
HELD = 32 << 20
#: ASCII letters in lower case, white space as blanks.
PLAIN = bytes(0x20 if b in b"\t\n\r\x0b\x0c" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: What each character of a shingle is multiplied by.
TURNS = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def normal(line: bytes) -> bytes:
    """ASCII letters in lower case and white space as single blanks, none at the ends."""
    line = line.translate(PLAIN)
    return b" ".join(line.split()) if b"  " in line or line[:1] == b" " or line[-1:] == b" " else line


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the five-character shingles of lines one after another, and how many each line has; a shorter line is one shingle."""
    text = b"\n".join([*lines, b""])
    if text.isascii():
        point = np.frombuffer(text, np.uint8)
    else:
        point = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    n, ends = len(point), np.flatnonzero(point == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = ends - starts
    value, turned = np.zeros(n, np.uint64), np.empty(min(n, POINTS), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, POINTS):
            own = point[a : a + POINTS + WIDTH - 1].astype(np.uint64)
            for j in range(min(WIDTH, len(own))):
                some = min(POINTS, len(own) - j)
                value[a : a + some] += np.multiply(own[j : j + some], TURNS[j], out=turned[:some])
        keep = np.ones(n, bool)
        for j in range(WIDTH):
            keep[np.maximum(ends - j, starts)] = False  # windows that run over the line's end
        full = sizes >= WIDTH
        keep[starts[full]] = True
        for i in np.flatnonzero(~full).tolist():
            own = point[starts[i] : ends[i]].astype(np.uint64)
            value[starts[i]] = np.uint64(sizes[i]) + (own * TURNS[: len(own)]).sum(dtype=np.uint64)
            keep[starts[i]] = True
            keep[starts[i] + 1 : ends[i] + 1] = False
    value = value[keep]
    _mix(value)
    return value, np.where(full, sizes - WIDTH + 1, 1)


def _mix(h: np.ndarray) -> None:
    """`mixed` in place, in stretches that stay in the cache."""
    free = np.empty(min(len(h), POINTS), np.uint64)
    for a in range(0, len(h), POINTS):
        own = h[a : a + POINTS]
        other = free[: len(own)]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            own ^= np.right_shift(own, np.uint64(shift), out=other)
            own *= np.uint64(factor)
        own ^= np.right_shift(own, np.uint64(31), out=other)


def _factors(bands: int, rows: int, level: int = 0) -> np.ndarray:
    return np.random.default_rng([7, level]).integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1)


def buckets(lines: list[bytes], bands: int, rows: int, odd: np.ndarray) -> np.ndarray:
    """For each line its bucket in each band: a hash of `rows` least values under random permutations of 32-bit shingle hashes."""
    s, per = shingles(lines)
    _mix(s)
    h = (s >> np.uint64(32)).astype(np.uint32)
    start = np.cumsum(per) - per
    least = np.empty((bands * rows, len(lines)), np.uint32)
    turned = np.empty_like(h)
    for k, factor in enumerate(odd):
        np.multiply(h, factor, out=turned)
        np.minimum.reduceat(turned, start, out=least[k])
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(lines), 1)
        for r in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[r::rows])
    return key.T.view(np.int64)


def _distinct(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each normalised line, sorted, one line after another, and where each line's begin and the last ends."""
    values, per = shingles(lines)
    ends = np.cumsum(per)
    for i, j in zip((ends - per).tolist(), ends.tolist(), strict=True):
        values[i:j].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[(ends - per)[per > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)[ends - 1]])


def bags(lines: list[bytes]) -> list[Bag]:
    """The set of shingles of each normalised line; lines given several times, as the centre of a bucket is, are cut once."""
    own = {x: i for i, x in enumerate(dict.fromkeys(lines))}
    if not own:
        return []
    values, at = _distinct(list(own))
    cut = [(values[i:j], None) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [cut[own[x]] for x in lines]


def lines(docs: DataFrame) -> DataFrame:
    """Every line of every text: (uid, doc_id, line, hi, lo, n, body); hi and lo are a line's digest, and null for blank lines.

    body, the normalised line, and n are given once for each digest, as far as a task remembers: in the row of
    least (doc_id, line, uid), null doc_ids last, which stands for n rows.
    """
    names = ["uid", "doc_id", "line", "hi", "lo", "n", "body"]
    types = [pa.int64(), pa.int64(), pa.int32()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, list] = {}  # digest: (place, n, body)
        other: list[tuple[tuple, bytes | None]] = []  # (place, digest) of rows without a body
        held = 0

        def out(places: list[tuple], digests: list[bytes | None], counts: list[int | None], bodies: list[bytes | None]) -> pa.RecordBatch:
            key = np.frombuffer(b"".join([d or bytes(16) for d in digests]), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            blank = np.array([d is None for d in digests], bool)
            _, doc, line, uid = zip(*places, strict=True)
            columns = [pa.array(c, t) for c, t in zip((uid, [None if p[0] else d for p, d in zip(places, doc, strict=True)], line), types, strict=True)]
            columns += [pa.array(key[:, 0], mask=blank), pa.array(key[:, 1], mask=blank), pa.array(counts, pa.int64()), pa.array(bodies, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def plain() -> pa.RecordBatch:
            return out([p for p, _ in other], [d for _, d in other], [None] * len(other), [None] * len(other))

        def firsts() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for d, (place, n, body) in first.items():
                rows.append((place, d, n, body))
                size += len(body) + 48
                if size >= 16 * AT_ONCE:
                    yield out(*map(list, zip(*rows, strict=True)))
                    rows, size = [], 0
            if rows:
                yield out(*map(list, zip(*rows, strict=True)))
            first.clear()

        for b in batches:
            for uid, doc, t in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), utf8_rows(b.column("text")), strict=True):
                if t is None:
                    continue
                for i, line in enumerate(t.split(b"\n")):
                    norm, place = normal(line), (doc is None, doc or 0, i, uid)
                    digest = xxhash.xxh3_128_digest(norm) if norm else None
                    if not norm:
                        other.append((place, None))
                    elif (own := first.get(digest)) is None:
                        first[digest] = [place, 1, norm]
                        held += len(norm) + 16
                        if held >= HELD:
                            yield from firsts()
                            held = 0
                    else:
                        own[1] += 1
                        if place < own[0]:
                            own[0], place = place, own[0]
                        other.append((place, digest))
                    if len(other) >= 16384:
                        yield plain()
                        other.clear()
        if other:
            yield plain()
        yield from firsts()

    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text")
    return own.mapInArrow(split, "uid long, doc_id long, line int, hi long, lo long, n long, body binary")


def _cut(b: pa.RecordBatch, least: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose bodies have so many bytes or more, but for the last, and these bodies."""
    at, held, size = 0, [], 0
    for i, body in enumerate(b.column("body")):
        held.append(body.as_py())
        size += len(held[-1])
        if size >= least:
            yield b.slice(at, i + 1 - at), held
            at, held, size = i + 1, [], 0
    if held:
        yield b.slice(at), held


def _entries(bands: int, rows: int) -> Entries:
    """Buckets and nodes of texts (node, body)."""
    odd = _factors(bands, rows)

    def entries(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, own in _cut(b, AT_ONCE):
            yield buckets(own, bands, rows, odd).ravel(), np.repeat(part.column("node").to_numpy(), bands)

    return entries


def _payloads(texts: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """(node, blob, total, sketch) of some nodes: normalised lines of texts (node, body), their numbers of shingles and sketches of these.

    A bitmap of so many bits leaves out most other lines before they are dealt.
    """
    mask = mask_of(nodes.select(F.col("node").alias("h")), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_mask(b.column("node").to_numpy(), mask.value)))
            for part, own in _cut(b, AT_ONCE):
                values, at = _distinct(own)
                columns = [*part.columns, pa.array(np.diff(at).astype(np.float64)), pa.array(sketches(values, at), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "blob", "total", "sketch"])

    rows = texts.select("node", "body").mapInArrow(run, "node long, blob binary, total double, sketch binary")
    return rows.join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])


@contextlib.contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files deleted at once, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _texts(firsts: DataFrame, *key: str) -> DataFrame:
    """Rows (hi, lo, least, f, n) for each key: the greatest and the least hi, the place of the first line and how many there are.

    A task has given few rows of a line, so they are dealt at once, without adding them up where they are.
    """
    f = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "line", "uid")
    rows = firsts.select("hi", "lo", f.alias("f"), "n").repartition(*key).groupBy(*key)
    lo = [] if "hi" in key else [F.max("hi").alias("hi"), F.min("hi").alias("least")]
    return rows.agg(*lo, F.min("f").alias("f"), F.sum("n").alias("n"))


def _kept(docs: DataFrame, least: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """All lines (see `lines`), and (hi, lo, k) of those that aren't alone: the place k of the line that is kept."""
    every = materialize(lines(docs), "lines")
    firsts = every.where("n IS NOT NULL")
    texts = materialize(_texts(firsts, "lo"), "distinct")
    if not texts.where("least < hi").take(1):
        bodies, texts = firsts.select(F.col("lo").alias("node"), "body"), texts.withColumn("node", F.col("lo"))
    else:  # half of the digest doesn't tell all lines apart
        discard(texts)
        texts = materialize(_texts(firsts, "hi", "lo").withColumn("node", F.monotonically_increasing_id()), "distinct")
        bodies = firsts.select("hi", "lo", "body").join(texts.select("hi", "lo", "node").hint("merge"), ["hi", "lo"]).select("node", "body")

    n = texts.count()
    bits = 1 << min(max((4 * n).bit_length(), 24), 28)
    root = classes([(bodies, n * bands, _entries(bands, rows))], lambda nodes: _payloads(bodies, materialize(nodes, "nodes"), bits), bags, least)
    grouped = texts.select("hi", "lo", "f", "n", "node").join(root.hint("shuffle_hash"), "node", "left").where("root IS NOT NULL OR n > 1")
    grouped = materialize(grouped.withColumn("root", F.coalesce("root", "node")), "grouped")
    kept = grouped.groupBy("root").agg(F.min("f").alias("k"))
    of = materialize(grouped.select("hi", "lo", "root").join(kept.hint("shuffle_hash"), "root").select("hi", "lo", "k"), "kept")
    discard(grouped, texts)
    return every, of


def fuzzy_lines(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(uid, doc_id, line, kept_doc_id, kept_line, keep): for every line its component's line that is kept.

    Lines are parts of texts between line feeds, numbered from 0, and compared in lower case (ASCII)
    with white space as single blanks. Lines equal in that form are one from the start; different ones
    are linked if they meet in a band of MinHash values and the Jaccard similarity of their sets of
    five-character shingles (told apart by 64-bit hashes) is `least` or more. Of each connected component
    the line of least (doc_id, line) is kept, null doc_ids last; of rows equal in both, one row of the table.

    Blank lines are always kept and stand for themselves. A null text has no lines, an empty one has one
    blank line; a line may be as long as its text. An empty table gives no rows. Other columns are not read.
    """
    with _released(docs.sparkSession):
        every, of = _kept(docs, least, bands, rows)
    out = every.select("uid", "doc_id", "line", "hi", "lo").join(of.hint("shuffle_hash"), ["hi", "lo"], "left")
    alone = F.col("k").isNull()
    return out.select(
        "uid", "doc_id", "line",
        F.when(alone, F.col("doc_id")).otherwise(F.col("k.doc_id")).alias("kept_doc_id"),
        F.when(alone, F.col("line")).otherwise(F.col("k.line")).alias("kept_line"),
        (alone | ((F.col("k.uid") == F.col("uid")) & (F.col("k.line") == F.col("line")))).alias("keep"),
    )


def op6_fuzzy_lines(docs: DataFrame) -> DataFrame:
    """Every line of all documents with the line kept for its component. See `fuzzy_lines`."""
    return fuzzy_lines(docs).select("doc_id", "line", "kept_doc_id", "kept_line", "keep")
