"""Quality by hierarchical empirical Bayes: a document's own evidence beside what its host and path are like."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prismlake.llm._shared import materialize, utf8_rows, word_pieces

_UPPER, _LETTER, _DIGIT, _SPACE, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x61:0x7B] = _LETTER
_CLASS[0x80:] = _LETTER
_CLASS[0x41:0x5B] = _UPPER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE

FEATURES = ("words", "word_bytes", "upper", "digit", "symbol", "distinct_words", "commonest_word", "distinct_lines", "line_words")
BINS = 12


def _share(x: float) -> int:
    """Bins of a share of 0 to 1, finer towards 0."""
    return int(min(BINS - 1, np.sqrt(max(x, 0.0)) * BINS))


def describe(text: bytes) -> list[int]:
    """The bin of each feature over the whole text."""
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=5)
    ink = max(int(kinds.sum() - kinds[_SPACE]), 1)
    count: dict[bytes, int] = {}
    n = 0
    for piece in word_pieces(text):
        n += len(piece)
        for w in piece:
            count[w] = count.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    top = max(count.values(), default=0)
    return [
        int(min(BINS - 1, np.log2(n + 1))),
        int(min(BINS - 1, (kinds[_UPPER] + kinds[_LETTER] + kinds[_DIGIT]) / max(n, 1))),
        _share(kinds[_UPPER] / ink),
        _share(kinds[_DIGIT] / ink),
        _share(kinds[_OTHER] / ink),
        # against what a text of that length has as a rule (the number of distinct words grows as a power)
        int(min(BINS - 1, 6 * len(count) / max(n, 1) ** 0.8)),
        _share(top / max(n, 1)),
        _share(len(set(lines)) / max(len(lines), 1)),
        int(min(BINS - 1, np.log2(n / max(len(lines), 1) + 1))),
    ]


def described(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = [describe(t or b"") for t in utf8_rows(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "host", "path")), pa.array(bins, pa.list_(pa.int32()))], names=["doc_id", "host", "path", "bins"])

    own = docs.select(F.col("doc_id").cast("long"), host.alias("host"), path.alias("path"), "text")
    return own.mapInArrow(run, "doc_id long, host string, path string, bins array<int>")


def learn_evidence(rows: DataFrame, labels: DataFrame, learnt_from: Column) -> tuple[np.ndarray, float, float]:
    """Log-likelihood ratios by feature and bin from counts over labelled rows, the global rate, and a factor for dependence.

    The sum of ratios of dependent features claims too much; the factor that fits the labels best by
    likelihood, out of a few, tempers it.
    """
    own = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(learnt_from).groupBy("doc_id").agg(F.avg("quality").alias("y")).where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
    seen = rows.join(own, "doc_id")
    counts = seen.select("y", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "y").agg(F.count("*").alias("n")).collect()  # features * bins * 2 rows at most
    table = np.full((len(FEATURES), BINS, 2), 0.5)
    for r in counts:
        table[r["f"], r["b"], r["y"]] += r["n"]
    rate = table / table.sum(1, keepdims=True)
    llr = np.log(rate[:, :, 1] / rate[:, :, 0])
    n1, n0 = (table[0, :, y].sum() - BINS / 2 for y in (1, 0))
    base = (n1 + 0.5) / (n1 + n0 + 1)
    prior = float(np.log(base / (1 - base)))
    tried = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0)
    chance = [F.lit(prior) + F.lit(f) * F.col("e") for f in tried]
    losses = [F.avg(F.when(F.col("y") == 1, F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))).alias(f"l{i}") for i, z in enumerate(chance)]
    found = seen.select("y", evidence(llr).alias("e")).agg(*losses).first()
    factor = min(zip(found, tried, strict=True))[1] if found[0] is not None else 1.0
    return llr, float(base), factor


def evidence(llr: np.ndarray) -> Column:
    """Sum over features of the ratio of the row's bin, from one literal table."""
    flat = F.array(*[F.lit(float(x)) for x in llr.ravel()])
    return F.aggregate(F.transform("bins", lambda b, i: F.get(flat, i * BINS + b)), F.lit(0.0), lambda a, x: a + x)


def _shrunk(groups: DataFrame, n: str, s: str, prior: Column, out: str) -> tuple[DataFrame, float]:
    """groups with (s + m * prior) / (n + m), and m: the weight of the prior from the spread of the groups' rates, by moments.

    The less the rates of large groups differ beyond what chance makes of them, the more a group is drawn to the prior.
    """
    rate, p = F.col(s) / F.col(n), prior
    between = F.sum(F.col(n) * F.pow(rate - p, 2)) / F.sum(n)
    chance = F.sum(p * (1 - p)) / F.sum(n)
    typical = F.sum(F.col(n) * p * (1 - p)) / F.sum(n)
    v = groups.where(F.col(n) > 0).agg(between.alias("b"), chance.alias("c"), typical.alias("t")).first()
    spread = max((v["b"] or 0.0) - (v["c"] or 0.0), 1e-6)
    m = float(min(max((v["t"] or 0.25) / spread - 1, 1.0), 1e6))
    return groups.withColumn(out, (F.col(s) + m * p) / (F.col(n) + m)), m


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, learnt_from: Column, threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, score, keep) of every document.

    A naive Bayes classifier over binned features of whole texts, counted by grouped aggregation over
    the labelled rows that learnt_from allows, gives each document a tempered log-likelihood ratio.
    With the global rate that is a first chance; chances are summed by host and by path, the host's
    rate is drawn to the global one and the path's to its host's, each as strongly as the spread between
    groups says (empirical Bayes by moments), so sparse sites stay near the prior. The document's
    score joins its path's rate, less its own share, with its evidence.

    Null and empty texts have bins of their own; null hosts and paths are groups; without labels of
    both kinds the evidence is weak and all scores lie near the global rate. Repeated rows count each. Texts of
    any length are taken whole; equal rows get equal scores; an empty table gives no rows. Other columns are not read.
    """
    rows = materialize(described(docs, host, path), "described")
    llr, base, factor = learn_evidence(rows, labels, learnt_from)
    logit = lambda p: F.log(p / (1 - p))
    z0 = float(np.log(base / (1 - base)))
    rows = rows.select("doc_id", "host", "path", (F.lit(factor) * evidence(llr)).alias("evidence"))
    rows = rows.withColumn("p", 1 / (1 + F.exp(-(F.lit(z0) + F.col("evidence")))))
    rows = materialize(rows, "evidence")
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    hosts, _ = _shrunk(materialize(hosts, "hosts"), "hn", "hs", F.lit(base), "host_rate")
    same = lambda a, b, *c: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in c]
    both = paths.alias("p").join(hosts.alias("h"), same("p", "h", "host"), "left").select("p.*", "host_rate")
    both, m = _shrunk(materialize(both, "paths"), "n", "s", F.col("host_rate"), "path_rate")
    both = both.select("host", "path", "host_rate", "path_rate", "n", "s")
    out = rows.alias("r").join(both.alias("b"), same("r", "b", "host", "path"), "left")
    rest = (F.col("s") - F.col("p") + m * F.col("host_rate")) / (F.col("n") - 1 + m)
    rest = F.least(F.greatest(rest, F.lit(1e-4)), F.lit(1 - 1e-4))
    z = logit(rest) + F.col("evidence")
    out = out.select("r.doc_id", "r.host", "r.path", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)


def op5_bayes_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of all documents: the host is the source, the path its part in one language; a third of ids by crc32 is held out."""
    learnt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    return score(docs, labels, F.col("source"), F.col("lang"), learnt).withColumn("held_out", F.coalesce(~learnt, F.lit(False)))
