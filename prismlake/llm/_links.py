"""From shared buckets to connected classes by exact similarity, without comparing all pairs of a large bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from prismlake.llm._shared import components, discard, materialize, mixed

#: A bucket up to so many rows and bytes is solved at once; a larger one in blocks of about that size.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Entries of buckets that one task sorts at once, about.
ENTRIES = 1 << 20
#: Bits of the sketch by which unlike sets are told apart.
BITS = 1024


class Row(NamedTuple):
    """A node in a block; mark: of a set, its number of tokens and its sketch."""

    block: int
    node: int
    root: int
    asks: bool
    mark: tuple[float, bytes] | None
    blob: pa.Scalar
    bag: tuple | None


#: Sorted distinct tokens of a payload and their weights (None: all 1).
Bag = tuple[np.ndarray, np.ndarray | None]
Bags = Callable[[list[bytes]], list[Bag]]
#: Buckets and nodes of the rows of a batch.
Entries = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def similarity(a: Bag, b: Bag, least: float = 0.0) -> float:
    """Weighted Jaccard similarity: shared weight (the lesser) over all weight (the greater); 0 if the totals rule out `least`."""
    (s, v), (t, w) = a, b
    p, q = (float(len(s)) if v is None else float(v.sum())), (float(len(t)) if w is None else float(w.sum()))
    if not p or not q or min(p, q) < (least - 1e-9) * max(p, q):
        return 0.0
    if v is None or w is None:
        both = np.concatenate([s, t])
        both.sort()
        low = float(np.count_nonzero(both[1:] == both[:-1]))
    else:
        at = np.searchsorted(t, s)
        at[at == len(t)] = 0
        hit = t[at] == s
        low = float(np.minimum(v[hit], w[at[hit]]).sum())
    return low / (p + q - low)


def _sketch(bag: Bag) -> int:
    """A bit for each token, by its hash: sets that differ in n bits differ in n tokens at least."""
    bits = np.zeros(BITS, np.uint8)
    bits[(bag[0] % np.uint64(BITS)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(bits).tobytes(), "little")


def sketches(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The sketch of each of several sets, one after another, that begin, and the last ends, at the given places."""
    out: list[bytes] = []
    for a in range(0, len(at) - 1, 256):
        own = at[a : a + 257]
        bits = np.zeros((len(own) - 1) * BITS, np.uint8)
        which = np.repeat(np.arange(0, len(bits), BITS), np.diff(own))
        bits[which + (values[own[0] : own[-1]] & np.uint64(BITS - 1)).view(np.int64)] = 1
        packed = np.packbits(bits).tobytes()
        out += [packed[i : i + BITS // 8] for i in range(0, len(packed), BITS // 8)]
    return out


def overlaps(bags: list[Bag]) -> Callable[[int], np.ndarray]:
    """Weighted Jaccard similarity of the i-th bag with each."""
    term = np.unique(np.concatenate([t for t, _ in bags]), return_inverse=True)[1] if bags else np.zeros(0, np.int64)
    w = np.concatenate([np.ones(len(t)) if v is None else v for t, v in bags]) if bags else np.zeros(0)
    per = np.array([len(t) for t, _ in bags])
    ends, owner = np.cumsum(per), np.repeat(np.arange(len(bags)), per)
    total = np.bincount(owner, w, len(bags))
    own = np.zeros(int(term.max()) + 1 if len(term) else 0)

    def match(i: int) -> np.ndarray:
        mine = slice(ends[i] - per[i], ends[i])
        own[term[mine]] = w[mine]
        low = np.bincount(owner, np.minimum(own[term], w), len(bags))
        own[term[mine]] = 0
        return low / np.maximum(total[i] + total - low, 1e-300)

    return match


def _listed(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries (bucket, node) of rows (node, buckets)."""
    buckets = b.column("buckets")
    per = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)
    yield buckets.flatten().to_numpy(), np.repeat(b.column("node").to_numpy(), per)


def _met(members: DataFrame, total: int | None = None, entries: Entries | None = None) -> DataFrame:
    """(bucket, node, n, other) of members that share a bucket with another.

    members: (node, buckets array<long>), or rows of which `entries` makes buckets and nodes; a node that repeats has
    the same buckets each time. total: entries, at least about, counted if not given.
    n is how many share it, and null where that is not known yet; in a bucket of two, one row has the other node.
    Entries are dealt to parts of about ENTRIES by a hash of the bucket, and travel as one block of bytes for each
    batch and part, so the engine moves few rows; an entry takes 16 bytes however many parts there are. A part is sorted in memory; a bucket that grows hot
    in it is given away at once, and whatever else comes for it, so no task holds a hot bucket as a whole.
    """
    if total is None:
        total = members.agg(F.coalesce(F.sum(F.greatest(F.size("buckets"), F.lit(0)).cast("long")), F.lit(0))).first()[0]
    parts = max(members.sparkSession.sparkContext.defaultParallelism, -(-total // ENTRIES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            bucket, node = (np.concatenate(c) for c in zip(*held, strict=True))
            part = (mixed(bucket.view(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
            order = np.argsort(part, kind="stable")
            part, bucket, node = part[order], bucket[order], node[order]
            start = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            own, cut = part[start].astype(np.int32), [*start.tolist(), len(order)]
            blobs = [bucket[i:j].tobytes() + (node[i:j] ^ bucket[i:j]).tobytes() for i, j in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(blobs, pa.binary())], names=["part", "entries"])

        for b in batches:
            for own in (entries or _listed)(b):
                held.append(own)
                n += len(own[0])
                if n >= 1 << 20:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, hot = None, [], 0, np.zeros(0, np.int64)

        def given(last: bool) -> tuple[pa.RecordBatch, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
            """Rows of buckets that are hot, or of all that are shared once a part ends, these buckets, and the entries that are left."""
            bucket, node = (np.concatenate(c) for c in zip(*held, strict=True))
            if last:  # most entries share not even some bits of their bucket with another
                bits = bucket & ((1 << 22) - 1)
                some = np.bincount(bits, minlength=1 << 22)[bits] > 1
                some = some | np.isin(bucket, hot) if len(hot) else some
                bucket, node = bucket[some], node[some]
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            same = np.flatnonzero(bucket[1:] == bucket[:-1])
            if len(same):  # a node that repeats counts once
                shared = np.zeros(len(bucket), bool)
                shared[same] = shared[same + 1] = True
                at = np.flatnonzero(shared)
                at = at[np.lexsort((node[order[at]], bucket[at]))]
                order[shared], own = order[at], node[order[at]]
                again = np.zeros(len(bucket), bool)
                again[np.flatnonzero(shared)[1:]] = (bucket[shared][1:] == bucket[shared][:-1]) & (own[1:] == own[:-1])
                bucket, order = bucket[~again], order[~again]
            if not len(bucket):
                none = [pa.array([], pa.int64())] * 4
                return pa.RecordBatch.from_arrays(none, names=["bucket", "node", "n", "other"]), bucket, [(bucket, bucket)]
            start = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
            count = np.diff(np.append(start, len(bucket)))
            known = np.isin(bucket[start], hot) if len(hot) else np.zeros(len(start), bool)
            full = (count >= (2 if last else ENTRIES // 64)) | known
            keep = np.repeat(full, count)
            own, mine, n = bucket[keep], node[order[keep]], np.repeat(count[full], count[full])
            open_ = np.repeat(known[full], count[full]) if last else np.ones(len(own), bool)
            two = np.flatnonzero((n[:-1] == 2) & ~open_[:-1] & (own[1:] == own[:-1]))
            other, has = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
            other[two], has[two] = mine[two + 1], True
            batch = pa.RecordBatch.from_arrays([pa.array(own), pa.array(mine), pa.array(n, mask=open_), pa.array(other, mask=~has)], names=["bucket", "node", "n", "other"])
            return batch, bucket[start[full]], [(bucket[~keep], node[order[~keep]])]

        for b in batches:
            for key, own in zip(b.column("part").to_pylist(), b.column("entries"), strict=True):
                if key != part:
                    if n:
                        yield given(True)[0]
                    part, held, n, hot = key, [], 0, np.zeros(0, np.int64)
                own = np.frombuffer(own.as_buffer(), np.int64).reshape(2, -1)
                held.append((own[0], own[1] ^ own[0]))
                n += len(own[0])
                if n > 2 * ENTRIES:
                    batch, own, held = given(False)
                    hot = np.union1d(hot, own)
                    yield batch
                    n = len(held[0][0])
        if n:
            yield given(True)[0]

    dealt = (members if entries else members.select("node", "buckets")).mapInArrow(deal, "part int, entries binary")
    sorted_ = dealt.repartitionById(parts, "part").sortWithinPartitions("part")
    return materialize(sorted_.mapInArrow(meet, "bucket long, node long, n long, other long"), "met")


def _verified(pairs: DataFrame, blobs: DataFrame, bags: Bags, least: float) -> DataFrame:
    """The pairs (a, b) whose payloads are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = bags(b.column("left").to_pylist() + b.column("right").to_pylist())
            near = np.array([similarity(x, y, least) >= least for x, y in zip(both[: len(b)], both[len(b) :], strict=True)], bool)
            yield b.select(["a", "b"]).filter(pa.array(near))

    left = blobs.select(F.col("node").alias("a"), F.col("blob").alias("left")).hint("merge")
    right = blobs.select(F.col("node").alias("b"), F.col("blob").alias("right")).hint("merge")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return materialize(both.mapInArrow(run, "a long, b long"), "links")


def _ruled_out(a: Bag, b: Bag, least: float) -> bool:
    """Whether numbers of tokens and sketches of two sets rule out that they are similar by `least`; see `_suspects`."""
    p, q = len(a[0]), len(b[0])
    return a[1] is None and (min(p, q) < (least - 1e-9) * max(p, q) or (_sketch(a) ^ _sketch(b)).bit_count() > (p + q) * (1 - least) / (1 + least) + 1e-9)


def _suspects(rows: list[Row], least: float) -> tuple[list[Row], list[tuple[int, int]]]:
    """Rows of one block in order, and pairs of different classes among them that marks don't rule out; one row that asks meets all others."""
    rows = sorted(rows, key=lambda r: (not r.asks, r.node))
    n, asking = len(rows), sum(r.asks for r in rows)
    size, root = np.array([r.mark[0] for r in rows]), np.array([r.root for r in rows])
    bits = np.frombuffer(b"".join([r.mark[1] for r in rows]), np.uint64).reshape(n, -1)
    found: list[tuple[int, int]] = []
    step = max(1, 4096 // n)
    for a in range(0, asking, step):
        p, q = size[a : min(a + step, asking), None], size[None, a:]
        near = (np.minimum(p, q) >= (least - 1e-9) * np.maximum(p, q)) & (root[a : a + len(p), None] != root[None, a:])
        i, j = np.nonzero(np.triu(near, 1))
        far = np.bitwise_count(bits[i + a] ^ bits[j + a]).sum(1, dtype=np.int64)
        left = far <= (size[i + a] + size[j + a]) * (1 - least) / (1 + least) + 1e-9
        found += zip((i[left] + a).tolist(), (j[left] + a).tolist(), strict=True)
    return rows, found


def _solve(rows: list[Row], pairs: list[tuple[int, int]], bag: Callable[[Row], Bag], least: float) -> list[tuple[int, int]]:
    """Links between classes of one block that hold a similar pair, among given pairs of rows."""
    group, found = {r.root: r.root for r in rows}, []
    for i, j in pairs:
        x, y = rows[i], rows[j]
        if group[x.root] != group[y.root] and similarity(bag(x), bag(y), least) >= least:
            found.append((x.root, y.root))
            new, old = group[x.root], group[y.root]
            group = {k: new if v == old else v for k, v in group.items()}
    return found


def _solve_weighted(rows: list[Row], bag: Callable[[Row], Bag], least: float) -> list[tuple[int, int]]:
    """As `_solve`, of weighted sets: each row that asks with all others."""
    rows = sorted(rows, key=lambda r: (not r.asks, r.node))
    group, n, found = np.unique([r.root for r in rows], return_inverse=True)[1], len(rows), []
    match = overlaps([bag(r) for r in rows]) if n > 64 else None
    for i, row in enumerate(rows):
        if not row.asks:
            break
        other = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if not len(other):
            continue
        if match:
            other = other[match(i)[other] >= least]
        for j in other.tolist():
            if group[j] != group[i] and (match or similarity(bag(row), bag(rows[j]), least) >= least):
                found.append((row.root, rows[j].root))
                group[group == group[j]] = group[i]
    return found


def _solved(rows: DataFrame, blobs: DataFrame, bags: Bags, least: float) -> DataFrame:
    """Links (a, b) between classes, by blocks: rows (block, node, root, asks); a block goes to one task, many to each.

    Of sets, only payloads that sketches leave in doubt are cut into tokens, those of a batch at once.
    """
    marked = "sketch" in blobs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Row] = []
        doubt: list[tuple[list[Row], list[tuple[int, int]]]] = []
        found: list[tuple[int, int]] = []

        def done() -> None:
            if not held:
                return
            if held[0].mark is None:
                found.extend(_solve_weighted(held, lambda r: r.bag, least))
            elif len((own := _suspects(held, least))[1]):
                doubt.append(own)

        def out() -> pa.RecordBatch:
            wanted = {r.node: r for rows, pairs in doubt for k in pairs for r in (rows[k[0]], rows[k[1]])}
            new = [r for r in wanted.values() if r.bag is None]
            known = {r.node: r.bag for r in wanted.values()} | dict(zip([r.node for r in new], bags([r.blob.as_py() for r in new]), strict=True))
            for rows, pairs in doubt:
                found.extend(_solve(rows, pairs, lambda r: known[r.node], least))
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            doubt.clear()
            found.clear()
            return batch

        for b in batches:
            blobs, node = b.column("blob"), b.column("node").to_pylist()
            if marked:
                marks = list(zip(b.column("total").to_pylist(), b.column("sketch").to_pylist(), strict=True))
                own = [None] * len(node)
            else:
                place = {k: i for i, k in enumerate(node)}
                bag = dict(zip(place, bags([blobs[i].as_py() for i in place.values()]), strict=True))
                mark = {k: (len(x[0]), _sketch(x).to_bytes(BITS // 8, "little")) if x[1] is None else None for k, x in bag.items()}
                marks, own = [mark[k] for k in node], [bag[k] for k in node]
            for row in map(Row, b.column("block").to_pylist(), node, b.column("root").to_pylist(), b.column("asks").to_pylist(), marks, blobs, own):
                if held and row.block != held[0].block:
                    done()
                    held.clear()
                    if sum(len(pairs) for _, pairs in doubt[-1:]) > 1 << 16:
                        yield out()
                held.append(row)
            yield out()
        done()
        if held:
            yield out()

    full = rows.join(blobs.hint("merge"), "node").repartition("block").sortWithinPartitions("block")
    return materialize(full.select("block", "root", "asks", *blobs.columns).mapInArrow(run, "a long, b long").distinct(), "links")


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(block, node, root, asks) of large buckets (bucket, node, root, n, bytes, main): nodes outside the main class meet all nodes, in blocks.

    Both sides are dealt to parts of about BLOCK nodes, and each part of the one meets each of the other.
    """
    rows = rows.withColumn("out", F.col("root") != F.col("main"))
    outside = rows.where("out").groupBy("bucket").agg(F.count("*").alias("k"))
    parts = lambda n, b: F.ceil(F.greatest(F.col(n) / F.lit(BLOCK / 2), F.col(b) / F.lit(BLOCK_BYTES / 2))).cast("int")
    rows = rows.join(outside.hint("merge"), "bucket").withColumn("j", parts("n", "bytes")).withColumn("i", F.least(parts("k", "bytes"), F.col("k").cast("int")))
    mine = lambda p: F.pmod(F.xxhash64("node"), F.col(p)).cast("int")
    every = lambda p: F.sequence(F.lit(0), F.col(p) - 1)
    asking = rows.where("out").select("bucket", "node", "root", mine("i").alias("x"), F.explode(every("j")).alias("y"), F.lit(True).alias("asks"))
    others = rows.select("bucket", "node", "root", F.explode(every("i")).alias("x"), mine("j").alias("y"), F.lit(False).alias("asks"))
    return asking.union(others).select(F.xxhash64("bucket", "x", "y").alias("block"), "node", "root", "asks")


def classes(members: Iterable[DataFrame | tuple[DataFrame, int] | tuple[DataFrame, int, Entries]], payloads: Callable[[DataFrame], DataFrame], bags: Bags, least: float) -> DataFrame:
    """(node, root) of nodes in a class of several: connected as all pairs that share a bucket and are similar by `least` or more.

    members: tables (node long, buckets array<long>) of disjoint sets of buckets, alone or with the number of their
    entries, or tables of which a function makes entries (see `_met`); they are looked at one after another. payloads gives (node, blob, total) for a table of nodes, total being the weight of all its tokens; for sets
    the sketch of each (see `sketches`) may come as a fourth column.

    1. In each bucket all nodes are compared with one (in a bucket of two, one with the other): the one whose buckets hold the most nodes, which is the
       centre of a family of variants. The work is linear. Links so found give classes.
    2. Buckets of one class are done, and so are pairs. What is left holds several classes, that may be
       similar elsewhere: a bucket of up to BLOCK nodes is solved in one task, comparing only nodes
       of different classes. In a larger one all nodes outside its main class meet all its nodes, in
       blocks of bounded size. Buckets of equal members are taken once.

    Every pair of a bucket is thus compared, or in one class already; size decides only where. Work is
    quadratic in the nodes of one bucket only as far as they stay unlike each other.
    """
    met = [_met(*m) if isinstance(m, tuple) else _met(m) for m in members]
    rows = met[0]
    for m in met[1:]:
        rows = rows.union(m)
    if rows.where("n IS NULL").take(1):
        # of buckets that were given away before they ended; they take the long way even if they hold no more than two
        hot = rows.where("n IS NULL").select("bucket", "node").distinct()
        crowd = hot.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket", F.greatest("c", F.lit(3)).alias("n"))
        rows = rows.where("n IS NOT NULL").union(hot.join(crowd.hint("merge"), "bucket").select("bucket", "node", "n", F.lit(None).cast("long").alias("other")))
        rows = materialize(rows, "crowded")
        discard(*met)
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    twos = rows.where("other IS NOT NULL").select(*pair("node", "other"))
    crowded = rows.where("n > 2")
    weight = crowded.groupBy("node").agg(F.sum("n").alias("w"))
    centre = crowded.join(weight.hint("shuffle_hash"), "node").groupBy("bucket").agg(F.max(F.struct("w", (-F.col("node")).alias("less"))).alias("c"))
    centre = centre.select("bucket", (-F.col("c.less")).alias("centre"))
    blobs = materialize(payloads(rows.select("node").distinct()), "blobs")
    sizes = blobs.select("node", F.length("blob").cast("long").alias("bytes"))
    pairs = crowded.join(centre.hint("merge"), "bucket").where("node <> centre").select(*pair("node", "centre")).union(twos).distinct()
    # totals too far apart rule out a pair before its payloads are moved
    total = lambda c: blobs.select(F.col("node").alias(c), F.col("total").alias(f"t{c}")).hint("shuffle_hash")
    pairs = pairs.join(total("a"), "a").join(total("b"), "b").where(F.least("ta", "tb") >= (least - 1e-9) * F.greatest("ta", "tb")).select("a", "b")
    near = _verified(pairs, blobs, bags, least)
    root = materialize(components(near), "roots")
    own = crowded.select("bucket", "node").join(root.hint("shuffle_hash"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = materialize(own.join(sizes.hint("shuffle_hash"), "node"), "own")
    discard(near, rows, *met)
    stats = own.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 31))).alias("y"),
    )
    several = stats.where("lo <> hi AND n > 2")
    once = several.groupBy("n", "first", "x", "y").agg(F.min(F.struct("bucket", "bytes")).alias("k")).select("k.bucket", "n", "k.bytes")
    once = materialize(once, "several")
    left = own.select("bucket", "node", "root").join(once.hint("merge"), "bucket")
    small = (F.col("n") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES)
    blocks = left.where(small).select(F.col("bucket").alias("block"), "node", "root", F.lit(True).alias("asks"))
    if once.where(~small).take(1):
        large = left.where(~small)
        main = large.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m")).select("bucket", F.col("m.root").alias("main"))
        blocks = blocks.union(_blocks(large.join(main.hint("merge"), "bucket"), sizes))
    more = _solved(blocks, blobs, bags, least)
    if more.take(1):
        joined = components(more).select(F.col("node").alias("root"), F.col("root").alias("higher"))
        alone = root.union(own.where("node = root").select("node", "root")).distinct().join(joined.hint("shuffle_hash"), "root", "left")
        root = materialize(alone.select("node", F.coalesce("higher", "root").alias("root")), "roots")
    discard(own, once, more, blobs)
    return root
