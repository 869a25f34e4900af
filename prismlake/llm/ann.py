"""Nearest neighbours by inner product: a vantage-point tree for each shard of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Vectors of one shard and queries of one task, about; points of one leaf of a tree.
SHARD, BLOCK, LEAF = 65_536, 262_144, 512
#: Shards at least, so that a small table is searched by several tasks too.
SHARDS = 8


class VPTree:
    """Points under Euclidean distance: each node parts its points into the nearer and the farther half from its vantage point."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        parts = [(0, len(points))]
        while max((b - a for a, b in parts), default=0) > leaf:
            vantage, rings, below = [], [], []
            for a, b in parts:
                own = self.order[a:b]
                v = self._vantage(own)
                d = _distance(points[own], v)
                sort, mid = np.argsort(d, kind="stable"), (b - a) // 2
                self.order[a:b], d = own[sort], d[sort]
                vantage.append(v)
                rings.append([(d[0], d[mid - 1]) if mid else (np.inf, -np.inf), (d[mid], d[-1])])
                below += [(a, a + mid), (a + mid, b)]
            self.levels.append((np.array(vantage), np.array(rings)))
            parts = below
        self.parts = parts

    def _vantage(self, own: np.ndarray) -> np.ndarray:
        """Of eight points the one whose distances to a spread of others vary most."""
        some = self.points[own[:: max(1, len(own) // 8)][:8]]
        others = self.points[own[:: max(1, len(own) // 128)]]
        return some[int(np.argmax([_distance(others, v).std() for v in some]))]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf the least distance that the triangle inequality allows."""
        low = np.zeros((len(queries), 1))
        square = (queries**2).sum(1)[:, None]
        for vantage, rings in self.levels:
            d = np.sqrt(np.maximum(square + (vantage**2).sum(1) - 2 * queries @ vantage.T, 0))
            own = np.maximum(d[:, :, None] - rings[:, :, 1], rings[:, :, 0] - d[:, :, None])
            low = np.maximum(low[:, :, None], own).reshape(len(queries), -1)
        return low

    def nearest(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """k nearest points of each query (-1: none) and their squared distances, unordered.

        A leaf is left out if factor times its least distance exceeds the k-th distance found so far;
        factor 1 leaves out only what can't matter, a larger one more.
        """
        low, n = self.bounds(queries), len(queries)
        found, far = np.full((n, k), -1), np.full((n, k), np.inf)
        square = (queries**2).sum(1)

        def visit(leaf: int, who: np.ndarray) -> None:
            own = self.order[slice(*self.parts[leaf])]
            if not len(own) or not len(who):
                return
            x = self.points[own]
            d = square[who, None] + (x**2).sum(1) - 2 * queries[who] @ x.T
            some = np.flatnonzero(d.min(1) < far[who].max(1))
            who, d = who[some], d[some]
            every = np.concatenate([far[who], d], 1)
            index = np.concatenate([found[who], np.broadcast_to(own, d.shape)], 1)
            best = np.argpartition(every, k - 1, 1)[:, :k]
            far[who], found[who] = np.take_along_axis(every, best, 1), np.take_along_axis(index, best, 1)

        first = np.argsort(low, 1, kind="stable")[:, :2]
        for turn in range(first.shape[1]):
            for leaf in np.unique(first[:, turn]).tolist():
                visit(leaf, np.flatnonzero(first[:, turn] == leaf))
        seen = np.zeros(low.shape, bool)
        np.put_along_axis(seen, first, True, 1)
        for leaf in range(len(self.parts)):
            reach = np.sqrt(np.maximum(far.max(1), 0))
            visit(leaf, np.flatnonzero(~seen[:, leaf] & (low[:, leaf] * factor <= reach + 1e-9)))
        return found, far

    def largest(self, queries: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """For each query all points whose inner product may be among the k largest, ties and near ties of the k-th included.

        Points lie on one sphere and queries are 0 in the last coordinate, so that the nearest point is the one of
        largest inner product. Distances only leave out leaves, as in `nearest`, within what rounding can do to them.
        """
        low, n = self.bounds(queries), len(queries)
        q2 = (queries**2).sum(1)
        norms = np.sqrt((self.points[:, :-1] ** 2).sum(1))
        sphere = float((self.points**2).sum(1).max(initial=0))
        eps = np.finfo(np.float64).eps * 4 * (queries.shape[1] + 4)
        best, held = np.full((n, k), -np.inf), []
        slack = 2 * np.sqrt(eps * (q2 + sphere)) + 1e-9

        def visit(leaf: int, who: np.ndarray) -> None:
            own = self.order[slice(*self.parts[leaf])]
            if not len(own) or not len(who):
                return
            s = queries[who] @ self.points[own].T
            best[who] = np.partition(np.concatenate([best[who], s], 1), -k, 1)[:, -k:]
            wide = eps * np.sqrt(q2[who])[:, None]
            i, j = np.nonzero(s + wide * norms[own] >= best[who].min(1)[:, None] - wide * norms.max())
            held.append((who[i], own[j], s[i, j]))

        first = np.argsort(low, 1, kind="stable")[:, :2]
        for turn in range(first.shape[1]):
            for leaf in np.unique(first[:, turn]).tolist():
                visit(leaf, np.flatnonzero(first[:, turn] == leaf))
        seen = np.zeros(low.shape, bool)
        np.put_along_axis(seen, first, True, 1)
        for leaf in range(len(self.parts)):
            reach = np.sqrt(np.maximum(q2 + sphere - 2 * best.min(1), 0))
            visit(leaf, np.flatnonzero(~seen[:, leaf] & (low[:, leaf] * factor <= reach + slack)))
        who, point, s = (np.concatenate(x) for x in zip(*held, strict=True))
        wide = eps * np.sqrt(q2)[who]
        keep = s + wide * norms[point] >= best.min(1)[who] - wide * norms.max()
        who, point = who[keep], point[keep]
        order = np.argsort(who, kind="stable")
        return np.split(point[order], np.searchsorted(who[order], np.arange(1, n)))


def _distance(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - v) ** 2).sum(1))


class Shard:
    """A tree of the vectors of one shard; of rows with the same id the one of least vector counts, equal vectors are one point."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        self.ids, x = ids[new], x[new]
        _, at, which = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.owners = np.argsort(which, kind="stable")  # the ids of a point, the least first
        self.first = np.searchsorted(which[self.owners], np.arange(len(at) + 1))
        self.points = x[at]
        # a further coordinate makes the nearest point the one of largest inner product
        square = (self.points**2).sum(1)
        self.tree = VPTree(np.hstack([self.points, np.sqrt(np.maximum(square.max() - square, 0))[:, None]]))

    def nearest(self, qid: np.ndarray, q: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """[query ids, vec_ids, scores] of the k nearest of each query but itself."""
        first, out = self.first, []
        # one more than asked for, since a query isn't its own neighbour
        for i, row in enumerate(self.tree.largest(np.hstack([q, np.zeros((len(q), 1))]), k + 1, factor)):
            mine = np.concatenate([self.ids[self.owners[first[p] : min(first[p] + k + 1, first[p + 1])]] for p in row.tolist()])
            # summed from the first component to the last
            score = np.add.accumulate(self.points[row] * q[i], 1)[:, -1]
            score = np.repeat(score, np.minimum(first[row + 1] - first[row], k + 1))
            keep = mine != qid[i]
            mine, score = mine[keep], score[keep]
            best = np.lexsort((mine, -score))[:k]
            out.append((np.full(len(best), qid[i]), mine[best], score[best]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def _search(k: int, factor: float):
    """Over rows sorted by (dim, shard, block, asks): build a tree of a shard's vectors once, then answer its queries as they come."""
    names = ["query_id", "vec_id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard, last = None, [], None, None
        for b in batches:
            where = np.stack([b.column(c).to_numpy() for c in ("dim", "shard", "block", "asks")], 1).astype(np.int64)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
                if hi <= lo:
                    continue
                *own, asks = where[lo].tolist()
                part = b.slice(lo, hi - lo)
                ids, x = part.column("vec_id").to_numpy(), part.column("embedding").flatten().to_numpy().reshape(hi - lo, own[0])
                if own != key:
                    key, held, shard, last = own, [], None, None
                if not asks:
                    held.append((ids, x))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = Shard(*(np.concatenate(c) for c in zip(*held, strict=True))), []
                # rows of equal id follow each other, the least vector first
                new = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
                last = ids[-1]
                ids, x = ids[new], x[new]
                for a in range(0, len(ids), 512):
                    found = shard.nearest(ids[a : a + 512], x[a : a + 512], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

    return search


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product for each query, but for its own id.

    Vectors are dealt to shards by a hash of vec_id, each with a vantage-point tree of its own; queries
    go to every shard, and the shards' lists are merged. A task builds the tree of a shard once and answers
    queries as they come, up to about BLOCK; more queries are more tasks for each shard. `factor` relaxes the
    pruning by the triangle inequality; 1 is exact search, which the query uses. Ties go to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with null
    vec_id; vectors only meet vectors of their length. Of rows with equal vec_id the least vector counts.
    An empty table gives no rows. Other columns are not read.
    """
    own = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(*own)
    q = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(*own)
    shards, blocks = max(SHARDS, -(-v.count() // SHARD)), max(1, -(-q.count() // BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", spread(blocks)).withColumn("asks", F.lit(0))
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", spread(shards)).withColumn("asks", F.lit(1))
    rows = v.unionByName(q).withColumn("dim", F.size("embedding")).select("dim", "shard", "block", "asks", "vec_id", "embedding")
    key = ["dim", "shard", "block"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "asks", "vec_id", "embedding")
    near = rows.mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_vp_tree(embeddings: DataFrame) -> DataFrame:
    """Contract of op1: 20 nearest of every vector whose id is divisible by 20. See `search` for odd rows."""
    return search(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
