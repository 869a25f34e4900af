"""Faces to people, by leaders within components of similar faces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prismlake.sources.tables import cut

# fixed values: when a face joins a person
ALONE, BEST, SECOND, SUGGEST, KEPT = 0.70, 0.64, 0.54, 0.58, 6
SCHEMA = "face_id long, leader long, score double, suggested long, suggested_score double, place long"
#: Faces of one block of the similarity join.
BLOCK = 4096
#: At most so many components, of so many faces at least, are compared by their centres first.
CELLS, CELL_LEAST = 256, 64
#: Scores of a matrix product that are so near are summed again, each in the same order.
TIE = 1e-9
#: Scores that a task of the fold holds at once.
SCORES = 1 << 23


def _matrix(vectors: pd.Series, width: int = 0, whole: bool = False) -> np.ndarray:
    """Vectors as rows, filled up with zeros, so that a dot product is one over the shorter length; one that holds NaN is like nothing, unless `whole`."""
    x = np.zeros((len(vectors), max([width, *map(len, vectors)])))
    for row, v in zip(x, vectors, strict=True):
        row[: len(v)] = v
    if not whole:
        x[np.isnan(x).any(1)] = 0
    return x


def _met(rows: DataFrame, meet, schema: str) -> DataFrame:
    """`meet` for each pair of blocks of rows (face_id, embedding, own, others), with columns own, i and j.

    own is a row's block, others are those that it meets; if one block names another, that one names it too. Each pair of blocks is one task, which holds two blocks.
    """
    every = rows.withColumn("other", F.explode("others"))
    every = every.select("face_id", "embedding", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return every.groupBy("i", "j").applyInPandas(meet, schema)


def _dealt(blocks: int, first: int = 0) -> Column:
    """The block of a face, by hash, of some that begin with the first."""
    return (F.lit(first) + F.pmod(F.xxhash64("face_id"), F.lit(max(blocks, 1)))).cast("int")


def similar_pairs(faces: DataFrame, least: float = SUGGEST, block: int = BLOCK) -> DataFrame:
    """(a, b, score) of faces (face_id, embedding) whose dot product, over the shorter length, is `least` or more, a < b.

    An exact similarity join in blocks. Work grows with the square of the faces, as all are compared; so do the
    pairs of many alike faces, for which `similar_links` gives what hangs together instead.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, side, i, j = pdf["face_id"].to_numpy(), pdf["own"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        x, left, right = _matrix(pdf["embedding"]), np.flatnonzero(side == i), np.flatnonzero(side == j)
        s = x[left] @ x[right].T
        p, q = np.nonzero(s >= least)
        a, b = ids[left[p]], ids[right[q]]
        keep = a < b if i == j else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": s[p, q][keep]})

    rows = faces.where("face_id IS NOT NULL AND embedding IS NOT NULL").select("face_id", "embedding")
    k = max(1, -(-rows.count() // block))
    return _met(rows.withColumns({"own": _dealt(k), "others": F.sequence(F.lit(0), F.lit(k - 1))}), meet, "a long, b long, score double")


def similar_links(faces: DataFrame, least: float = SUGGEST, block: int = BLOCK, old: str | None = None) -> DataFrame:
    """(a, b): links of faces (face_id, embedding) that join exactly what pairs of dot product `least` or more join.

    Each two blocks give a spanning forest of their pairs, fewer links than they have faces, so that a person with many faces gives
    links in proportion to faces times blocks and not to pairs. Faces that are `old` (a boolean column) aren't compared with each other.

    1. Every block meets itself and the first block, which makes most of what hangs together components. The work is linear.
    2. Of the largest components no pair is compared within one, and none between two where a bound by their centres rules out
       `least`. All that is left meets: faces of small components meet all others, which is quadratic in their number.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, side, i, j = pdf["face_id"].to_numpy(), pdf["own"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        x, left, right = _matrix(pdf["embedding"]), np.flatnonzero(side == i), np.flatnonzero(side == j)
        like = np.concatenate([x[left[a : a + 512]] @ x[right].T >= least for a in range(0, len(left), 512)]) if len(left) else np.zeros((0, len(right)), bool)
        links = [np.zeros((2, 0), ids.dtype)]

        def reach(front: np.ndarray, like: np.ndarray, seen: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
            free = np.flatnonzero(~seen)
            s = like[np.ix_(front, free)]
            hit = s.any(0) if len(front) else np.zeros(len(free), bool)
            new = free[hit]
            links.append(np.stack([ids[mine[front[s[:, hit].argmax(0)]]], ids[theirs[new]]]) if len(new) else links[0])
            seen[new] = True
            return new

        # breadth first: a face is reached once, by the first face that it resembles
        seen = np.zeros(len(left), bool)
        other = seen if i == j else np.zeros(len(right), bool)
        for root in np.flatnonzero(like.any(1)).tolist():
            if seen[root]:
                continue
            seen[root], front = True, np.array([root])
            while len(front):
                front = reach(front, like, other, left, right)
                if i != j:
                    front = reach(front, like.T, seen, right, left)
        a, b = np.concatenate(links, 1)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    rows = faces.where("face_id IS NOT NULL AND embedding IS NOT NULL").select("face_id", "embedding", (F.col(old) if old else F.lit(False)).alias("old"))
    n = {r["old"]: r["n"] for r in rows.groupBy("old").agg(F.count("*").alias("n")).collect()}  # two rows
    new, known, k = rows.where("NOT old"), rows.where("old"), max(1, -(-n.get(False, 0) // block))
    dealt = new.withColumn("own", _dealt(k))
    to_old = [*range(-(-n.get(True, 0) // block))]
    if k == 1 and not to_old:
        return _met(dealt.withColumn("others", F.array(F.lit(0))), meet, "a long, b long")
    first = dealt.withColumn("others", F.when(F.col("own") == 0, F.sequence(F.lit(0), F.lit(k - 1))).otherwise(F.array(F.lit(0), F.col("own"))))
    root = components(_met(first, meet, "a long, b long"))
    cells, apart = _cells(new, root, least) if k > 1 else ([], None)
    of = new.join(root.select(F.col("node").alias("face_id"), "root"), "face_id", "left").join(F.broadcast(new.sparkSession.createDataFrame([(r, i) for i, (r, _) in enumerate(cells)], "root long, cell int")), "root", "left")
    sizes = [m for _, m in cells] + [n.get(False, 0) - sum(m for _, m in cells)]
    count = [-(-m // block) for m in sizes]
    start = np.concatenate([[0], np.cumsum(count)]).tolist()
    blocks = [list(range(a, a + m)) for a, m in zip(start, count, strict=False)]
    olds, rest = [start[-1] + i for i in to_old], len(cells)
    meets = [sorted({b for j, own in enumerate(blocks) if j == rest or i == rest or i != j and not apart[i, j] for b in own} | set(olds)) for i in range(rest + 1)] if k > 1 else [olds] * (rest + 1)
    places = new.sparkSession.createDataFrame([(i, start[i], max(count[i], 1), m) for i, m in enumerate(meets)], "cell int, start int, count int, others array<int>")
    of = of.withColumn("cell", F.coalesce("cell", F.lit(rest))).join(F.broadcast(places), "cell").withColumn("own", (F.col("start") + F.pmod(F.xxhash64("face_id"), F.col("count"))).cast("int"))
    of = of.select("face_id", "embedding", "own", "others").where(F.size("others") > 0)
    if to_old:
        of = of.union(known.select("face_id", "embedding", _dealt(len(olds), start[-1]).alias("own"), F.sequence(F.lit(0), F.lit(max(start[-1], 1) - 1)).alias("others")))
    return root.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).union(_met(of, meet, "a long, b long"))


def _cells(faces: DataFrame, root: DataFrame, least: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The largest components (root, faces), CELLS at most, and for each two of them whether no faces of both can have a dot product of `least`.

    With c and d the centres of two components, a face of each is c + p and d + q, so their product is c(d + q) + d(c + p) - cd + pq: at most the
    greatest product of the one centre with a face of the other, both ways, less that of the centres, and the greatest |p| times the greatest |q|.
    """
    found = root.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= CELL_LEAST).orderBy(F.desc("n"), "root").limit(CELLS).collect()  # at most CELLS rows
    cells = [(r["root"], r["n"]) for r in found]
    if len(cells) < 2:
        return cells, np.zeros((len(cells), len(cells)), bool)
    own = root.join(F.broadcast(faces.sparkSession.createDataFrame([(r, i) for i, (r, _) in enumerate(cells)], "root long, cell int")), "root")
    own = cut(faces.select("face_id", "embedding").join(own.select(F.col("node").alias("face_id"), "cell"), "face_id").select("cell", "embedding"))

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, cell = _matrix(b["embedding"]), b["cell"].to_numpy()
            yield pd.DataFrame([(int(c), x[cell == c].sum(0)) for c in np.unique(cell)], columns=["cell", "v"])

    def widest(fold):
        return lambda pdf: pd.DataFrame([(pdf["cell"].iloc[0], fold(_matrix(pdf["v"], whole=True)))], columns=["cell", "v"])

    sums = own.mapInPandas(total, "cell int, v array<double>").groupBy("cell").applyInPandas(widest(lambda x: x.sum(0)), "cell int, v array<double>").toPandas().sort_values("cell")  # a row for each cell
    centres = _matrix(sums["v"], whole=True) / np.array([n for _, n in cells])[:, None]

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, cell = _matrix(b["embedding"], centres.shape[1]), b["cell"].to_numpy()
            far = np.linalg.norm(x - centres[cell], axis=1)
            s = np.column_stack([x @ centres.T, far])
            # products may be below 0, so that filling up with zeros doesn't do: all rows have one length
            yield pd.DataFrame([(int(c), s[cell == c].max(0)) for c in np.unique(cell)], columns=["cell", "v"])

    most = own.mapInPandas(reach, "cell int, v array<double>").groupBy("cell").applyInPandas(widest(lambda x: x.max(0)), "cell int, v array<double>").toPandas().sort_values("cell")
    most = _matrix(most["v"], whole=True)
    near, far = most[:, :-1], most[:, -1]
    return cells, near + near.T - centres @ centres.T + np.outer(far, far) < least - TIE


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): each node with the least node that it hangs together with.

    In each round a node takes the least root among its neighbours, and then that root's own; rounds are few,
    since roots jump. Every round is written.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        up = new.select(F.col("node").alias("new"), F.col("new").alias("top"))
        new = cut(new.join(up, "new").select("node", "root", F.least("new", "top").alias("new")))
        roots = new.select("node", F.col("new").alias("root"))
        if not new.where("root <> new").take(1):
            return roots


def _dots(v: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Dot products with vectors, summed in one order whatever else is asked: equal vectors have equal ones."""
    return np.ascontiguousarray(known * v).sum(-1)


class _People:
    """People in order of coming, with up to six known faces of each."""

    def __init__(self, width: int = 0):
        self.ids, self.at, self.rank = [], {}, []
        self.known, self.faces, self.count = np.zeros((KEPT, 0, width)), np.zeros((KEPT, 0), np.int64), np.zeros(0, np.int64)

    def widen(self, width: int) -> None:
        if width > self.known.shape[2]:
            self.known = np.pad(self.known, ((0, 0), (0, 0), (0, width - self.known.shape[2])))

    def add(self, person: int, face: int, v: np.ndarray, rank: tuple = (2, 0)) -> tuple[int, int | None]:
        """Let a face stand for a person, who may be new: the person's number, and the face's place among the person's faces, or None if all are taken."""
        if person not in self.at:
            self.at[person] = len(self.ids)
            self.ids.append(person)
            self.rank.append(rank)
            if len(self.ids) > len(self.count):
                more = max(4, len(self.count))
                self.known = np.concatenate([self.known, np.zeros((KEPT, more, self.known.shape[2]))], 1)
                self.faces, self.count = np.concatenate([self.faces, np.zeros((KEPT, more), np.int64)], 1), np.concatenate([self.count, np.zeros(more, np.int64)])
        i = self.at[person]
        place = int(self.count[i])
        if place == KEPT:
            return i, None
        self.known[place, i, : len(v)] = v
        self.faces[place, i] = face
        self.count[i] += 1
        return i, place

    def scores(self, x: np.ndarray, more: int = 0) -> np.ndarray:
        """Products of vectors with each known face: place by vector by person, with room for more people."""
        n = len(self.ids)
        s = np.full((KEPT, len(x), n + more), -np.inf)
        for k in range(KEPT):
            if n and (there := self.count[:n] > k).any():
                np.matmul(x, self.known[k, :n].T, out=s[k, :, :n])
                s[k, :, :n][:, ~there] = -np.inf
        return s

    def first(self, among: np.ndarray, best: np.ndarray, v: np.ndarray) -> tuple[int, float, int]:
        """Of some people that of best score, who came first among equal ones, the score, and the known face that has it."""
        among = among[best[among] >= best[among].max() - TIE]
        s = np.where(np.arange(KEPT)[:, None] < self.count[among], _dots(v, self.known[:, among]), -np.inf)
        p = int(s.max(0).argmax())
        return int(among[p]), float(s[:, p].max()), int(self.faces[int(s[:, p].argmax()), among[p]])

    def match(self, s: np.ndarray, best: np.ndarray, v: np.ndarray) -> tuple[tuple[int, float, int] | None, tuple[int, float, int] | None]:
        """The accepted person of best score, and else the closest one, from the scores of a face by place and person and the best of each person."""
        if not len(best) or best.max() < SUGGEST - TIE:
            return None, None
        who = np.flatnonzero(best >= BEST)
        if len(who):
            who = who[(best[who] >= ALONE) | (np.partition(s[:, who], KEPT - 2, 0)[KEPT - 2] >= SECOND)]
        if len(who):
            return self.first(who, best, v), None
        return None, self.first(np.arange(len(best)), best, v)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Assign faces in order: each joins the accepted person of best score or opens one, whose id is its own.

    Rows with a person are faces that stand for people already; must-link groups, if rows tell them (free, group_id), follow their first face. Rows come
    sorted by component and order, so only the people of one component are held. FOUND, if given, is what a face finds among people whose faces are
    complete. Scores of some faces with all people are one matrix product; those with people that these faces change are put in as they change.
    """
    block, people, groups = None, _People(), {}
    for pdf in batches:
        out, x, n = [], _matrix(pdf["embedding"]), len(pdf)
        blocks, faces, old = pdf["block"].to_numpy(), pdf["face_id"].to_numpy(), pdf["old"].to_numpy(bool)
        free, group = pdf["free"].to_numpy(bool) if "free" in pdf else np.ones(n, bool), pdf.get("group_id")
        person, kind, rank = (pdf[c].tolist() if c in pdf else [0] * n for c in ("person_id", "kind", "rank"))
        finds = [list(zip(*(pdf[c].tolist() for c in f), strict=True)) if f[0] in pdf else [(-np.inf, 0, 0, 0)] * n for f in FOUND]
        at = 0
        for end in (np.flatnonzero(np.append((blocks[1:] != blocks[:-1]) | (old[1:] != old[:-1]) | (free[1:] != free[:-1]), True)) + 1 if n else np.zeros(0, int)).tolist():
            if blocks[at] != block:
                block, people, groups = blocks[at], _People(x.shape[1]), {}
            people.widen(x.shape[1])
            for i in range(at, end if old[at] or not free[at] else at):
                if old[i]:
                    people.add(int(person[i]), int(faces[i]), x[i], (kind[i], rank[i]))
                else:
                    leader = groups.setdefault(group.iloc[i], int(faces[i]))
                    out.append((int(faces[i]), leader, 1.0, None, None, people.add(leader, int(faces[i]), x[i], (1, 0))[1]))
                at = i + 1
            while at < end:
                m = min(end - at, 512, max(1, SCORES // (KEPT * (len(people.ids) + 512))))
                v = np.pad(x[at : at + m], ((0, 0), (0, people.known.shape[2] - x.shape[1])))
                s = people.scores(v, m)
                best, own = s.max(0), v @ v.T if m > 1 else None
                for r in range(m):
                    face, there = int(faces[at + r]), len(people.ids)
                    hit, near = people.match(s[:, r, :there], best[r, :there], v[r])
                    hit = _sooner(hit and (hit[1], *people.rank[hit[0]], people.ids[hit[0]]), finds[0][at + r])
                    near = _sooner(near and (near[1], *people.rank[near[0]], near[2]), finds[1][at + r])
                    leader, score = (int(hit[3]), hit[0]) if hit else (face, 1.0)
                    place = None
                    if not hit or leader in people.at:
                        p, place = people.add(leader, face, v[r])
                        if place is not None and r + 1 < m:
                            s[place, r + 1 :, p] = own[r, r + 1 :]
                            np.maximum(best[r + 1 :, p], own[r, r + 1 :], out=best[r + 1 :, p])
                    near = None if hit or not near or near[0] < SUGGEST else near
                    out.append((face, leader, score, near and int(near[3]), near and near[0], place))
                at += m
        yield pd.DataFrame(out, columns=["face_id", "leader", "score", "suggested", "suggested_score", "place"]).astype({"suggested": "Int64", "suggested_score": "Float64", "place": "Int64"})


def _sooner(own: tuple | None, other: tuple) -> tuple | None:
    """The better of two finds (score, kind, rank, id), the sooner one of equal scores; a score of -inf is no find."""
    if other[0] == -np.inf:
        return own
    return other if own is None or other[0] > own[0] or other[0] == own[0] and other[1:3] < own[1:3] else own


#: What a face finds among complete people: an accepted person, and the closest known face.
FOUND = [[f"{c}_{x}" for x in ("score", "kind", "rank", "id")] for c in ("hit", "near")]


def _complete(faces: DataFrame, people: DataFrame, block: int) -> DataFrame:
    """(face_id, FOUND): for faces (face_id, embedding) the accepted person of best score among people whose six faces are known, else the closest known face of these.

    people: (person_id, kind, rank, place, face_id, embedding). Who has six faces gets no more, so what a face finds among
    them doesn't depend on the faces before it. Blocks of faces meet blocks of people, two in a task.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["there", "kind", "rank", "place", "face_id"], ignore_index=True)
        out, known, x, there = [], _People(), _matrix(pdf["embedding"]), pdf["there"].to_numpy(bool)
        known.widen(x.shape[1])
        for i, p, f, k, r in zip(np.flatnonzero(there).tolist(), *(pdf.loc[there, c].tolist() for c in ("person_id", "face_id", "kind", "rank")), strict=True):
            known.add(p, f, x[i], (k, r))
        n, ids, none = int((~there).sum()), pdf["face_id"].tolist(), (-np.inf, 0, 0, 0)
        step = max(1, min(512, SCORES // (KEPT * max(len(known.ids), 1))))
        for a in range(0, n if known.ids else 0, step):
            s = known.scores(x[a : min(a + step, n)])
            best = s.max(0)
            for r in np.flatnonzero(best.max(1) >= SUGGEST - TIE).tolist():
                hit, near = known.match(s[:, r], best[r], x[a + r])
                out.append((ids[a + r], *((hit[1], *known.rank[hit[0]], known.ids[hit[0]]) if hit else none), *((near[1], *known.rank[near[0]], near[2]) if near else none)))
        return pd.DataFrame(out, columns=["face_id", *FOUND[0], *FOUND[1]])

    n, k = faces.count(), people.select("person_id").distinct().count()
    i, j = max(1, -(-n // block)), max(1, -(-k * KEPT // (4 * block)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = faces.select("face_id", "embedding", F.lit(False).alias("there"), *[F.lit(0).cast(t).alias(c) for c, t in (("person_id", "long"), ("kind", "int"), ("rank", "long"), ("place", "int"))], _dealt(i).alias("i"), every(j).alias("j"))
    right = people.select("face_id", "embedding", F.lit(True).alias("there"), "person_id", "kind", "rank", F.coalesce("place", F.lit(-1)).alias("place"), every(i).alias("i"), F.pmod(F.xxhash64("person_id"), F.lit(j)).cast("int").alias("j"))
    met = left.union(right).groupBy("i", "j").applyInPandas(meet, "face_id long, " + ", ".join(f"{a} double, {b} int, {c} long, {d} long" for a, b, c, d in FOUND))
    best = [F.max(F.struct(a, (-F.col(b)).alias(b), (-F.col(c)).alias(c), d)).alias(a) for a, b, c, d in FOUND]
    # an accepted person and a closer face of one that isn't accepted may come from different blocks
    return met.groupBy("face_id").agg(*best).select("face_id", *[x for a, b, c, d in FOUND for x in (F.col(f"{a}.{a}").alias(a), (-F.col(f"{a}.{b}")).alias(b), (-F.col(f"{a}.{c}")).alias(c), F.col(f"{a}.{d}").alias(d))])


def leaders(faces: DataFrame, known: DataFrame | None = None, ignored: DataFrame | None = None, hidden: DataFrame | None = None, order: list[Column] | None = None, block: int | None = None) -> DataFrame:
    """(face_id, leader, score, suggested, suggested_score, place) of faces (face_id, quality, embedding, group_id).

    Must-link groups come first, then faces by quality, or in another order given, face_id last; each joins the person whose known faces it
    resembles enough or opens one, and the first six faces of a person become known, with `place` 0 to 5. A person is called by its
    first face. A face that opens one, but comes near a known face, has that face as suggestion. With `known` (person_id, face_id, place, embedding) people are there already, and faces join
    them; leave hidden people out of it, so that they don't grow. The people of `hidden` groups (group_id) don't either. Faces of `ignored` (face_id)
    and faces with null vectors take no part, nor do known ones as new faces.

    Faces only matter to each other above the least score that is looked at. So links above it are found first, and each
    component of links and of people with less than six faces is folded by itself, with the result of one fold over
    all faces. People with six faces, of groups or known, don't change: every face looks for them by itself, and they join no components. A component is read as a
    sorted stream, of which a task holds the people found so far, each by six faces; components without a new face aren't read.
    """
    by = [c.alias(f"_order{i}") for i, c in enumerate(order or [-F.col("quality").cast("double")])]
    orders, block = [f"_order{i}" for i in range(len(by))], block or BLOCK
    rows = faces.where("face_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("face_id").cast("long").alias("face_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("group_id").cast("long").alias("group_id"), *by)
    rows = rows if ignored is None else rows.join(ignored.select("face_id"), "face_id", "left_anti")
    none = rows.sparkSession.createDataFrame([], "face_id long, person_id long, place int, embedding array<double>")
    there = none if known is None else known.where("embedding IS NOT NULL").select(F.col("face_id").cast("long").alias("face_id"), F.col("person_id").cast("long").alias("person_id"), F.col("place").cast("int").alias("place"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut(rows if known is None else rows.join(there.select("face_id"), "face_id", "left_anti"))
    free, grouped = rows.where("group_id IS NULL"), rows.where("group_id IS NOT NULL")

    # a group is called by its first face, and its first six are known, whatever else there is
    head = grouped.groupBy("group_id").agg(F.min(F.struct(*orders, "face_id")).alias("head"), F.count("*").alias("n"))
    head = cut(head.orderBy("head").select("group_id", F.col("head.face_id").alias("leader"), F.monotonically_increasing_id().alias("rank")))
    place = F.row_number().over(W.partitionBy("group_id").orderBy(*orders, "face_id")) - 1
    six = grouped.withColumn("place", place).where(F.col("place") < KEPT).select("group_id", "face_id", "place", "embedding")
    six = cut(six.join(head, "group_id"))
    placed = grouped.select("face_id", "group_id").join(head, "group_id").join(six.select("face_id", "place"), "face_id", "left")
    whole = placed.select("face_id", "leader", F.lit(1.0).alias("score"), F.lit(None).cast("long").alias("suggested"), F.lit(None).cast("double").alias("suggested_score"), F.col("place").cast("long").alias("place"))

    shown = six if hidden is None else six.join(hidden.select("group_id").distinct(), "group_id", "left_anti")
    people = there.select("person_id", F.lit(0).alias("kind"), F.col("person_id").alias("rank"), "place", "face_id", "embedding")
    people = people.union(shown.select(F.col("leader").alias("person_id"), F.lit(1).alias("kind"), "rank", "place", "face_id", "embedding"))
    people = cut(people.join(people.groupBy("person_id").agg(F.count("*").alias("n")), "person_id"))
    full, growing = people.where(F.col("n") >= KEPT), people.where(F.col("n") < KEPT)

    linked = growing.join(growing.groupBy("person_id").agg(F.min("face_id").alias("a")), "person_id").where("a <> face_id").select("a", F.col("face_id").alias("b"))
    both = free.select("face_id", "embedding", *orders).withColumn("old", F.lit(False))
    both = both.unionByName(growing.select("face_id", "embedding", "person_id", "kind", "rank", "place").withColumn("old", F.lit(True)), allowMissingColumns=True)
    root = components(similar_links(both, block=block, old="old").union(linked))
    both = both.join(root.select(F.col("node").alias("face_id"), "root"), "face_id", "left").withColumn("block", F.coalesce("root", "face_id"))
    both = both.join(both.where("NOT old").select("block").distinct(), "block", "left_semi")
    if full.take(1):
        both = both.join(_complete(free.select("face_id", "embedding"), full, block), "face_id", "left")
        both = both.withColumns({c: F.coalesce(c, F.lit(-np.inf if c == f[0] else 0)) for f in FOUND for c in f})
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("person_id", "kind", "rank")})
    # dealt by a key of its own: a shuffle by block itself would be taken from the joins above, and these may be read anew by pieces of blocks
    both = both.repartition(F.xxhash64("block")).sortWithinPartitions("block", F.desc("old"), "kind", "rank", "place", *orders, "face_id")
    return both.select("block", "face_id", "old", "person_id", "kind", "rank", "embedding", *[c for f in FOUND for c in f if c in both.columns]).mapInPandas(_fold, SCHEMA).union(whole)


def representatives(assigned: DataFrame, faces: DataFrame, n: int = KEPT) -> DataFrame:
    """(leader, face_id): each person's n faces of best quality."""
    from prismlake.operators.ordering import top_per_group

    both = assigned.select("leader", "face_id").join(faces.select("face_id", "quality"), "face_id")
    return top_per_group(both, ["leader"], [F.desc("quality"), F.col("face_id")], n).select("leader", "face_id")


def kept_boxes(boxes: DataFrame, overlap: float = 0.4) -> DataFrame:
    """Greedy non-maximum suppression: (file_id, box_id) of boxes (file_id, box_id, x, y, w, h, score); images are small groups."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True], ignore_index=True)
        x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
        chosen: list[int] = []
        for i in range(len(pdf)):
            c = np.array(chosen, int)
            ix = np.clip(np.minimum(x[i] + w[i], x[c] + w[c]) - np.maximum(x[i], x[c]), 0, None)
            iy = np.clip(np.minimum(y[i] + h[i], y[c] + h[c]) - np.maximum(y[i], y[c]), 0, None)
            both = ix * iy
            union = w[i] * h[i] + w[c] * h[c] - both
            if not (both >= overlap * np.where(union > 0, union, np.inf)).any():
                chosen.append(i)
        return pdf.loc[chosen, ["file_id", "box_id"]]

    return boxes.groupBy("file_id").applyInPandas(keep, "file_id long, box_id long")
