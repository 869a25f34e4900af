"""From documents to shards of training data: toxicity, near-duplicates, benchmark leaks, mixing, sharding."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismlake.llm import decontam, mixture, near_dedup, sharding, toxicity
from prismlake.llm._shared import discard, materialize, owned, sweep, table

#: Work tables of a stage belong to this owner; the next stage, whose input is written by then, deletes them.
OWNER = "pipeline"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, OWNER)
        with owned(OWNER):
            return f(spark, docs, sf_dir)

    return run


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that none meets a column that an operator adds."""
    rest = [docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0).alias("none")])).alias("rest"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in columns])


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go.

    Null and empty texts and texts without a known word share one score, below the threshold unless such examples
    are mostly toxic; equal texts stay or go together, and repeated rows stay repeated. Without usable labels all stay. An
    empty table stays empty. All columns are kept.
    """
    scored = toxicity.score(_packed(docs), table(spark, sf_dir, "labels"), keep_text=True)
    return _unpacked(scored.where("predicted = 0"), docs.columns)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of least doc_id stays.

    Rows with null texts all stay; empty texts are one class, and so are other equal texts without words. Of
    rows equal in doc_id and text one stays. An empty table stays empty. All columns are kept.
    """
    return near_dedup.representatives(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go.

    Null and empty texts have no words and stay; equal texts stay or go together, and repeated rows stay repeated.
    An empty table stays empty; with an empty benchmark all stay. All columns are kept.
    """
    found = decontam.scan(_packed(docs), table(spark, sf_dir, "benchmark"), keep_text=True)
    return _unpacked(found.where(~decontam.contaminated(decontam.n_hit(), F.col("n_words"))), docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it: 0 to 2 rows.

    Documents without words, as null and empty texts, are taken no time; a null source is a source; repeated rows
    are taken each by itself. An empty table stays empty. All columns are kept.
    """
    return mixture.repeated(docs)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes, as op9 gives them; copies of a text stay together.

    Null texts are one group, and so are empty ones; repeated rows get a slot each. An empty table stays empty. All columns are
    kept, but for those named as one that is added: size, text_crc32, law, shard, slot, grown_shard.
    """
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result written and read again, and deleted once the next is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name, swept=False)
        discard(before)
    sweep(spark, OWNER)
    return docs


#: The stages weigh, draw and search in ways that SQL can't express.
ORACLE_SQL = None
