"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from prismlake.llm._shared import materialize, ranked

#: Ranks that one task looks up at once.
RANKS = 1 << 16


class Rooms:
    """A balanced tree of (room, bin): sorted leaves of bounded size, all at one depth, below a sorted root."""

    def __init__(self, fill: int = 512):
        self.fill, self.leaves, self.tops = fill, [], []

    def add(self, room: int, b: int) -> None:
        if not self.leaves:
            self.leaves, self.tops = [[(room, b)]], [(room, b)]
            return
        at = min(bisect_left(self.tops, (room, b)), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, (room, b))
        self.tops[at] = leaf[-1]
        if len(leaf) > self.fill:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.tops[at : at + 1] = [leaf[half - 1], leaf[-1]]

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin of least room that holds `size`; of equal rooms the first bin."""
        at = bisect_left(self.tops, (size, -1))
        if at == len(self.tops):
            return None
        leaf = self.leaves[at]
        found = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[at] = leaf[-1]
        else:
            del self.leaves[at], self.tops[at]
        return found


def best_fit(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int]] | None:
    """(bin, count) for runs (size, count) of items, sizes descending: the items in order, count of them to each bin.

    Each item goes to the open bin with the least room that holds it, found in a balanced tree. A bin that
    takes an item is the tightest for the next one of that size too, as long as that fits, so a run is
    dealt in strides. An item above the capacity gets a bin for itself. None if more than `most` bins are needed.
    """
    rooms, n, out = Rooms(), 0, []
    for size, count in runs:
        while count:
            room, b = rooms.tightest(size) or (max(capacity, size), n)
            if b == n:
                n += 1
                if most is not None and n > most:
                    return None
            take = min(count, room // size) if size > 0 else count
            out.append((b, take))
            rooms.add(room - take * size, b)
            count -= take
    return out


def fewest(runs: list[tuple[int, int]], bins: int) -> list[tuple[int, int]]:
    """A packing that needs no more than so many bins, of a capacity found by halving.

    Best fit may need more bins with a larger capacity, so a smaller capacity than the one found can do now and then; the fullest bin is then a little fuller.
    """
    total = sum(s * c for s, c in runs)
    low = -(-total // bins)
    high = low + max((s for s, _ in runs), default=0)  # with so much room no bin can be missing
    best = best_fit(runs, high)
    while low < high:
        mid = (low + high) // 2
        put = best_fit(runs, mid, bins)
        if put is None:
            low = mid + 1
        else:
            best, high = put, mid
    return best


def pack(docs: DataFrame, group: Column, size: Column, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """docs with `shard` int and `slot` long (from 0 without gaps within the shard).

    Rows of equal `group` stay together. Groups go by size, largest first, each to the shard with the least
    room that still holds it. With `shards`, a capacity that needs no more shards is sought by halving, so that
    shards come out nearly equal; with `capacity`, so many shards are opened as best fit needs. A
    group above the capacity gets a shard for itself.

    Groups of equal size are alike to best fit, so the driver packs runs (size, count): sizes that differ are
    at most the square root of twice the sum of all. Groups are ranked by (size, group) in Spark and take
    the shard of their rank. Rows are spread over (shard, salt) for the numbering of slots, so that no task
    holds a whole shard. Null groups count as one group, null or negative sizes as 0; empty input gives
    empty output. Columns of docs named shard or slot are replaced, others are kept whatever they are called.
    """
    kept = [docs[f"`{c}`"] for c in docs.columns if c not in ("shard", "slot")]
    own = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0).cast("long"))
    base = materialize(docs.select(F.struct(*kept).alias("d"), F.coalesce(F.md5(group.cast("binary")), F.lit("")).alias("g"), own.alias("b"), F.monotonically_increasing_id().alias("uid")), "sized")
    groups = base.groupBy("g").agg((-F.sum("b")).alias("less"), F.count("*").alias("n"))
    placed = ranked(groups, "less", "g")
    sizes = placed.groupBy("less").agg(F.count("*").alias("c")).orderBy("less").toArrow()
    runs = list(zip((-x for x in sizes.column("less").to_pylist()), sizes.column("c").to_pylist(), strict=True))
    put = fewest(runs, shards) if capacity is None else best_fit(runs, capacity)
    starts, at = [], 0
    for b, take in put:
        starts.append((at, at + take - 1, b))
        at += take
    ends = docs.sparkSession.createDataFrame(starts, "place long, last long, shard int")
    # each block of ranks knows the shards that begin in it and the one that it begins with
    block = lambda c: F.floor(F.col(c) / RANKS).cast("long")
    ends = ends.select(F.explode(F.sequence(block("place"), block("last"))).alias("block"), "place", "shard")
    ends = ends.select("block", F.greatest("place", F.col("block") * RANKS).alias("place"), F.lit("").alias("g"), "shard")
    both = ends.union(placed.select(block("place").alias("block"), "place", "g", F.lit(None).cast("int").alias("shard")).withColumn("g", F.concat(F.lit("="), "g")))
    last = F.last("shard", True).over(W.partitionBy("block").orderBy("place", "g").rowsBetween(W.unboundedPreceding, 0))
    of = materialize(both.withColumn("shard", last).where("g <> ''").select(F.substring("g", 2, 32).alias("g"), "shard"), "placed")
    n = base.count()
    return slotted(base.join(of, "g").select("d", "uid", "shard"), n)


def slotted(rows: DataFrame, n: int, per_task: int = 100_000) -> DataFrame:
    """d.*, shard and slot of rows (d, uid, shard): numbered from 0 in (shard, salt), after the rows of lower salts; salts are of uid, so equal rows are spread too."""
    salts = max(1, -(-n // per_task))
    rows = materialize(rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int")), "dealt")
    counts = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = W.partitionBy("shard", "salt").orderBy("uid")
    out = rows.withColumn("r", F.row_number().over(inner)).join(offsets, ["shard", "salt"])
    return out.select("d.*", "shard", (F.col("from") + F.col("r") - 1).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard: shards of nearly equal bytes, equal texts together, and so null texts.

    A size is the text's UTF-8 bytes plus 16. Columns of docs with such names are replaced, all others are kept, of whatever type.
    """
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    own = docs[f"`{text}`"]
    size = (F.coalesce(F.octet_length(own), F.lit(0)) + 16).cast("long")
    slim = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in new], size.alias("size"), F.crc32(own.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"))
    out = pack(slim, F.col(f"`{text}`"), F.col("size"), shards=shards)
    return out.withColumn("grown_shard", F.lit(None).cast(T.IntegerType()))


def op9_bin_packing(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Contract of op9: all documents in shards of nearly equal bytes; equal texts stay together, and so do null texts."""
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.md5(F.col("text").cast("binary")).alias("_text"),
    )
    out = pack(slim, F.col("_text"), F.col("size"), shards=shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
