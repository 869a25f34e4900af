"""Helpers of the corpus operators: shared work tables, words, components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, blanks the rest.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Long texts are split into words in pieces of about this many bytes.
PIECE = 1 << 20

_written: dict[tuple[str, str], list[str]] = {}
_owner: contextvars.ContextVar[str] = contextvars.ContextVar("owner", default="")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, the warehouse, or in local mode a folder for temporary files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = f"file://{tempfile.gettempdir()}/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/prismlake"


def scratch(spark: SparkSession, tag: str, swept: bool = True) -> str:
    """A new path in the shared folder, which `sweep` deletes unless told otherwise."""
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if swept:
        _written.setdefault((spark.sparkContext.applicationId, _owner.get()), []).append(path)
    return path


def materialize(df: DataFrame, tag: str, swept: bool = True) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage.

    `discard` deletes it, and `sweep` those of an owner (see `owned`) unless told otherwise.
    """
    spark = df.sparkSession
    path = scratch(spark, tag, swept)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """Work tables written inside belong to this owner."""
    before = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(before)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing reads any more; other tables are left alone."""
    for t in tables:
        path = getattr(t, "_work_path", None)
        if path:
            _delete(t.sparkSession, path)
            for own in _written.values():
                if path in own:
                    own.remove(path)


def sweep(spark: SparkSession, owner: str = "") -> None:
    """Delete the work tables of an owner in this application. Call it once everything that reads them is written."""
    for path in _written.pop((spark.sparkContext.applicationId, owner), []):
        _delete(spark, path)


def finished(spark: SparkSession, owner: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, written; all work tables behind it are deleted."""
    owner = f"{owner}-{uuid.uuid4().hex}"
    try:
        with owned(owner):
            return materialize(make(), owner, swept=False)
    finally:
        sweep(spark, owner)


def utf8_rows(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each string of an Arrow column, without decoding them; None for null."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.cast(pa.large_string())
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1].tolist() if offsets else [0]
        view = memoryview(data) if data else memoryview(b"")
        valid = part.is_valid().to_pylist()
        for i in range(len(part)):
            yield bytes(view[at[i] : at[i + 1]]) if valid[i] else None


def trim() -> None:
    """Give memory that a batch has left unused back to the system; workers are kept between stages, and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size."""
    clean, start = text.translate(WORD_BYTES), 0
    while len(clean) - start > PIECE:
        end = clean.find(b" ", start + PIECE)
        if end < 0:
            break
        yield clean[start:end].split()
        start = end
    yield clean[start:].split()


class WordHash(dict):
    """Word to a 64-bit hash, remembered for words met before."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: bytes, known: WordHash) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, p), np.uint64, len(p)) for p in word_pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mixed(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words of each text, and how many each text has.

    h: word hashes of several texts one after another; sizes: words of each. A text of fewer words,
    but not none, has one shingle of all its words.
    """
    n = len(h)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    room = np.repeat(ends, sizes) - np.arange(n)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            m = n - j
            if m <= 0:
                break
            out[:m] += np.where(room[:m] > j, mixed(h[j:] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))), 0)
    keep = room >= width
    short = (sizes > 0) & (sizes < width)
    keep[starts[short]] = True
    return mixed(out[keep]), np.where(short, 1, np.maximum(sizes - width + 1, 0))


def ranked(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Number rows from 0 in a total order: a range sort, then an offset for each partition."""
    cut = materialize(df.sort(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    first = cut.groupBy("_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n")).collect()  # one row for each partition
    before, shift = 0, {}
    for r in sorted(first, key=lambda r: r["_part"]):
        shift[r["_part"]] = before - r["_from"]
        before += r["_n"]
    if not shift:
        return cut.withColumn(name, F.lit(0).cast("long")).drop("_part", "_at")
    pairs = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv])
    return cut.withColumn(name, (F.col("_at") + pairs[F.col("_part")]).cast("long")).drop("_part", "_at")


def mask_of(hashes: DataFrame, bits: int = 1 << 24) -> Broadcast:
    """A broadcast bitmap of fixed size (2 MB) with a bit set for each hash `h`; see `in_mask`."""
    at = F.pmod(F.col("h"), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))
    packed = hashes.select((at / 64).cast("int").alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()  # at most bits / 64 rows
    mask = np.zeros(bits // 64, np.uint64)
    mask[packed.column("i").to_numpy()] = packed.column("b").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(mask)


def in_mask(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which hashes (long) may be among those of the bitmap: all that are, and others as the bitmap fills."""
    at = h % (len(mask) * 64)
    return (mask[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, root): root is the least node of its component.

    Alternating large-star and small-star steps over tables in the shared folder, until every node hangs
    on a root. Nodes without an edge to another node are absent. Hub nodes only ever meet their own
    minimum, which is combined before the shuffle; joins on a hub are left to adaptive skew handling.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("c"), F.lit(0).alias("p")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("c"), F.lit(1).alias("p")))
        if not ends.groupBy("x").agg(F.sum("c").alias("c"), F.max("p").alias("p")).where("c > 1 OR (c > 0 AND p > 0)").take(1):
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")
        discard(e)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        e = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(large)
