"""Mixing sources to target weights by pivotal dependent rounding of copy numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from prismlake.llm._shared import materialize, ranked, utf8_rows

#: Rows of one leaf of the reduction tree, and residuals of one inner node.
LEAF, FAN_IN = 8192, 1024

#: Bytes that are no white space count as part of a word: 1 for them, 0 for \x20 and \x09-\x0D.
_INK = np.ones(256, np.uint8)
_INK[[0x20, *range(0x09, 0x0E)]] = 0


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column, a text, by its number of words: a byte of a word after none of a word begins one."""
    for b in batches:
        n = []
        for text in utf8_rows(b.column(b.num_columns - 1)):
            ink = _INK[np.frombuffer(text or b"", np.uint8)]
            n.append(int(np.count_nonzero(ink[1:] > ink[:-1])) + int(len(ink) > 0 and ink[0]))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "size"])


def targets(sizes: DataFrame, weights: list[float], share: float, ceiling: float) -> DataFrame:
    """(source, source_size) with `target`: share * total split by weight, never above ceiling * source_size.

    Sources weigh as `weights` repeated in order of code point, null last. What a source cannot take
    is shared anew by weight among the others until none is above its ceiling; each turn is one
    aggregate over the table of sources, and each turn fills a source, so few turns are needed.
    """
    order = ranked(sizes.withColumn("_null", F.col("source").isNull().cast("int")), "_null", "source").drop("_null")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(order.withColumn("_w", w).drop("place"), "sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    goal, rate = min(share, ceiling) * total, -1.0
    while True:
        full = F.lit(rate) * F.col("_w") > F.lit(ceiling) * F.col("source_size") if rate >= 0 else F.lit(False)
        taken, w_open = table.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0))).first()
        last, rate = rate, (goal - ceiling * taken) / w_open if w_open else rate
        if rate <= last or not w_open:
            break
    return table.withColumn("target", F.least(F.lit(max(rate, 0.0)) * F.col("_w"), F.lit(float(ceiling)) * F.col("source_size"))).drop("_w")


def _pivotal(p: np.ndarray, size: np.ndarray, key: list[bytes], seed: int) -> tuple[np.ndarray, int, float]:
    """Round fractions in the order given: the running one and the next trade words until one is 0 or 1.

    Mass is p * size, so the sum of words is kept by every trade; which way words go is drawn so that
    each fraction is kept in expectation. Returns the decisions, the index of the one left open (-1:
    none) and its fraction. Randomness comes from the keys alone, so a rerun decides alike.
    """
    out, open_at, q, sq = np.zeros(len(p), np.int8), -1, 0.0, 0.0
    for i, (x, sx) in enumerate(zip(p.tolist(), size.tolist(), strict=True)):
        if sx <= 0 or x <= 1e-9 or x >= 1 - 1e-9:
            out[i] = sx > 0 and x > 0.5
            continue
        if open_at < 0:
            open_at, q, sq = i, x, float(sx)
            continue
        to_open, to_next = min(x * sx, (1 - q) * sq), min(q * sq, (1 - x) * sx)
        u = xxhash.xxh64_intdigest(key[i], seed=seed) / 2**64
        moved = to_open if u * (to_open + to_next) < to_next else -to_next
        q, x = q + moved / sq, x - moved / sx
        if 1e-9 < x < 1 - 1e-9:  # the running one is settled
            out[open_at], open_at, q, sq = q > 0.5, i, x, float(sx)
            continue
        out[i] = x > 0.5
        if q <= 1e-9 or q >= 1 - 1e-9:
            out[open_at], open_at = q > 0.5, -1
    return out, open_at, q


def _node(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        """Decide the rows of one node, largest first, but for the one that is left open."""
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable", ignore_index=True)
        out, open_at, q = _pivotal(pdf["p"].to_numpy(), pdf["size"].to_numpy(), [str(k).encode() for k in pdf["key"]], level)
        last = np.arange(len(pdf)) == open_at
        return pdf.assign(extra=out, open=last, p=np.where(last, q, out.astype(float)))

    return decide


def mix(sized: DataFrame, weights: list[float], share: float, ceiling: float) -> DataFrame:
    """sized (source, size, key, ...) with source_size, target and copies: target / source_size rounded up or down.

    The whole part of that rate is copied outright. Fractions are rounded by the pivotal method: rows
    of one source and size class are dealt to leaves of about 8192 rows, each leaf decides all its rows
    but one, largest first, and what is left open goes up a tree of nodes until one row of each source
    is left, which goes to the nearer side. But for that row every row's chance is exactly its fraction, and
    words are traded, so the words copied from a source differ from its target by half that row at most.

    sized must come from a written table, so that it reads the same twice. Rows of size 0 get no
    copy; a null source is a source. Randomness comes from `key` alone.
    """
    sums = sized.groupBy("source", F.floor(F.log2(F.col("size") + 1) * 4).cast("int").alias("_class")).agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))
    classes = materialize(sums, "classes")
    goals = targets(classes.groupBy("source").agg(F.sum("_b").alias("source_size")), weights, share, ceiling)
    same = lambda a, b, *c: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.lit(True) if not c else F.col(f"{a}._class") == F.col(f"{b}._class"))
    plan = classes.alias("c").join(goals.alias("g"), same("c", "g"), "left").select("c.source", "c._class", "c._n", "g.source_size", "g.target")
    plan = materialize(plan, "plan")
    few = plan.count() <= 100_000  # sources times at most 100 size classes; broadcast only when that small
    rows = sized.withColumn("_class", F.floor(F.log2(F.col("size") + 1) * 4).cast("int")).alias("r")
    rows = rows.join((F.broadcast(plan) if few else plan).alias("c"), same("r", "c", 1), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    leaf = F.xxhash64(F.coalesce(F.col("r.source"), F.lit("")), F.col("r.source").isNull(), F.col("r._class"), F.pmod(F.xxhash64("key", F.lit(5)), F.ceil(F.col("_n") / LEAF).cast("long")))
    columns = [F.col(f"r.{c}") for c in sized.columns]
    rows = rows.select(*columns, "source_size", "target", F.floor(rate).cast("long").alias("_whole"), (rate - F.floor(rate)).alias("p"), leaf.alias("leaf"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    done = materialize(rows.groupBy("leaf").applyInPandas(_node(0), fields + ", extra byte, open boolean"), "leaves")
    # the tree: each round leaves at most one open row for each node
    left = done.where("open").select("leaf", "source", "size", "key", "p")
    ends, level = None, 0
    while True:
        many = left.groupBy("source").agg(F.count("*").alias("_n"))
        more = many.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
        if more <= 1:
            break
        level += 1
        up = left.alias("l").join(many.alias("m"), F.col("l.source").eqNullSafe(F.col("m.source"))).select("l.*", F.pmod(F.xxhash64("l.leaf", F.lit(level)), F.ceil(F.col("_n") / FAN_IN).cast("long")).alias("node"))
        step = materialize(up.groupBy("source", "node").applyInPandas(_node(level), "leaf long, source string, size long, key string, p double, node long, extra byte, open boolean"), "node")
        shut = step.where("not open").select("leaf", F.col("extra").alias("_e"))
        ends = shut if ends is None else ends.union(shut)
        left = step.where("open").drop("extra", "open", "node")
    shut = left.select("leaf", (F.col("p") >= 0.5).cast("byte").alias("_e"))
    ends = shut if ends is None else ends.union(shut)
    out = done.join(ends, "leaf", "left").withColumn("copies", F.col("_whole") + F.when(F.col("open"), F.col("_e")).otherwise(F.col("extra")))
    return out.drop("_whole", "p", "leaf", "extra", "open", "_e")


def _key() -> Column:
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("binary")), F.lit("null"))
    return F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), part("text"), part("source"))


def copies(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, copies) of every row of docs, size being its number of words.

    key tells doc_id, text and source, nulls too. A null text, an empty one or one of white space has size 0 and
    gets no copy; a null source is the last source; rows of equal key are rounded each by itself.
    Texts of any length are counted whole. Empty input gives no rows. Other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), _key().alias("key"), "text")
    sized = materialize(slim.mapInArrow(word_counts, "doc_id long, source string, key string, size long"), "words")
    return mix(sized, list(weights), share, ceiling).withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0).cast("long")))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as its copies say; rows that are equal in doc_id, text and source count as equal in all.

    Rows without words get no copy. Columns of any name are kept as they are.
    """
    taken = materialize(copies(docs, **how).groupBy("key").agg(F.sum("copies").alias("c"), F.count("*").alias("n")).where("c > 0"), "taken")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d"), _key().alias("key")).join(taken, "key")
    if taken.where("n > 1").take(1):
        rows = rows.dropDuplicates(["key"])
    return rows.select("d", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).select("d.*")


def op2_pivotal_mix(docs: DataFrame) -> DataFrame:
    """Contract of op2: what a mix of all documents takes of each. See `copies` for odd rows."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
