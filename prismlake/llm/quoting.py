"""Quotation linking: replies to the messages they quote, in reply order and without the quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from prismlake.llm._shared import discard, materialize

_MARKS = re.compile(r"^(?:[ \t]*>)+")
_INTRO = re.compile(r"^.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:\s*$")
#: Passages of fewer words are too common to tell which conversation they come from.
LEAST_WORDS = 3


def passages(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages: (level, passage) of consecutive lines with as many quote marks."""
    own, _, quoted = parts(text)
    return own, quoted


def parts(text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
    """As `passages`, with the own text also cut where quotes were removed."""
    own: list[str] = []
    cuts: list[int] = []
    quoted: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m.group().count(">") if m else 0
        if not level:
            own.append(line)
        elif level == last and quoted:
            quoted[-1][1].append(line[m.end() :])
        else:
            if own and not last and _INTRO.match(own[-1]):
                own.pop()  # the line that says who is quoted
            quoted.append((level, [line[m.end() :]]))
            cuts.append(len(own))
        last = level
    pieces = ["\n".join(own[a:b]) for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True) if a < b]
    return "\n".join(own).strip("\n"), pieces, [(k, "\n".join(x)) for k, x in quoted]


def grains(passage: str) -> set[str]:
    """What a passage may be quoted by: itself, its paragraphs, lines and sentences, normalised."""
    paragraphs = re.split(r"\n\s*\n", passage)
    sentences = [x for p in paragraphs for x in re.split(r"(?<=[.!?])\s+", p)]
    return {n for x in (passage, *paragraphs, *passage.split("\n"), *sentences) if (n := normal(x))}


def normal(passage: str) -> str:
    """Letters and digits in lower case, one blank between words."""
    return " ".join(re.findall(r"\w+", passage.lower()))


def _hash(norm: str) -> bytes:
    return xxhash.xxh3_128_digest(norm.encode("utf-8", "replace"))


def _asked(quoted: str) -> list[dict]:
    """The grains of a quoted passage; those of few words only if it has no others."""
    whole = normal(quoted)
    size = {n: n.count(" ") + 1 for n in grains(quoted)}
    return [{"hash": _hash(n), "words": k} for n, k in sorted(size.items()) if k >= LEAST_WORDS or n == whole]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, quotes, said = [], [], []
        for t in b.column("text").to_pylist():
            own, pieces, quoted = parts(t or "")
            text.append(None if t is None else own)
            quotes.append([{"level": k, "grains": g} for k, q in quoted if (g := _asked(q))])
            said.append(sorted({_hash(n) for p in (own, *pieces) for n in grains(p)}))
        kinds = pa.list_(pa.struct([("level", pa.int32()), ("grains", pa.list_(pa.struct([("hash", pa.binary()), ("words", pa.int32())])))]))
        yield pa.RecordBatch.from_arrays([*b.select(["conv_id", "turn", "role"]).columns, pa.array(text, pa.string()), pa.array(quotes, kinds), pa.array(said, pa.list_(pa.binary()))], names=["conv_id", "turn", "role", "text", "quotes", "said"])


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, parent_conv, parent_turn, thread_conv, thread_turn, depth, quotes, linked) of every message.

    text is without quoted lines and the lines that announce them. Each quoted passage, its paragraphs,
    lines and sentences are normalised, hashed and joined to the messages that say them as a whole, between
    removed quotes, in a paragraph, a line or a sentence: first to the latest earlier turn of the same
    conversation, else to the first message with it in an earlier one. The longest match of a passage
    counts. The message of the lowest quote level found is the parent (ties: the first quoted). thread_conv
    and thread_turn are the head that the chain of parents ends with, depth the steps to it. What is
    quoted comes before the quote, so sorting by thread_conv, thread_turn, conv_id and turn gives each thread in
    reply order; messages without a found quote are heads.

    Passages of under three words are linked as a whole within their conversation only. Null texts stay null, empty ones
    say nothing; messages with null conv_id or turn are heads and never parents; repeated rows are rows of one message,
    each with its links. Texts of any length are taken whole; an empty table gives no rows; other columns are not read.
    Hot passages meet a conversation's asking messages by one sorted pass, and others by one candidate.
    """
    rows = materialize(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("text").cast("string")).mapInArrow(_parsed, "conv_id long, turn long, role string, text string, quotes array<struct<level: int, grains: array<struct<hash: binary, words: int>>>>, said array<binary>"), "messages")
    key = "conv_id IS NOT NULL AND turn IS NOT NULL"
    asked = rows.where(key).where("size(quotes) > 0").select("conv_id", "turn", F.posexplode("quotes").alias("at", "q"))
    asked = asked.select("conv_id", "turn", "at", F.col("q.level").alias("level"), F.explode("q.grains").alias("g")).select("conv_id", "turn", "at", "level", "g.hash", "g.words")
    asked = materialize(asked.distinct(), "quotes")
    said = rows.where(key).select("conv_id", "turn", F.explode("said").alias("hash"))
    said = materialize(said.join(asked.select("hash").distinct(), "hash", "left_semi").distinct(), "said")
    first = said.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("o"))
    # in each conversation the latest turn before the asking one that says the same
    events = asked.withColumn("said", F.lit(None).cast("long")).unionByName(said.withColumn("said", F.col("turn")), allowMissingColumns=True)
    earlier = W.partitionBy("hash", "conv_id").orderBy("turn", F.col("said").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    near = events.withColumn("parent_turn", F.last("said", True).over(earlier)).where("at IS NOT NULL AND parent_turn IS NOT NULL")
    near = near.select(*asked.columns, F.col("conv_id").alias("parent_conv"), "parent_turn")
    quote = ["conv_id", "turn", "at", "level"]
    rest = asked.where(F.col("words") >= LEAST_WORDS).join(near.select(*quote, "hash"), [*quote, "hash"], "left_anti")
    # a message in an earlier conversation only, so that chains end
    far = rest.join(first, "hash").where("o.conv_id < conv_id").select(*asked.columns, F.col("o.conv_id").alias("parent_conv"), F.col("o.turn").alias("parent_turn"))
    found = near.withColumn("far", F.lit(0)).union(far.withColumn("far", F.lit(1)))
    longest = F.min(F.struct((-F.col("words")).alias("w"), "far", (-F.col("parent_turn")).alias("t"), "parent_conv", "parent_turn")).alias("b")
    found = found.groupBy(*quote).agg(longest).select(*quote, "b.parent_conv", "b.parent_turn")
    parents = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "at", "parent_conv", "parent_turn")).alias("p"), F.count("*").alias("linked"))
    parents = materialize(parents.select("conv_id", "turn", F.col("p.parent_conv").alias("parent_conv"), F.col("p.parent_turn").alias("parent_turn"), "linked"), "parents")
    # steps up to the head, doubled in each round
    chains = materialize(parents.select("conv_id", "turn", F.col("parent_conv").alias("up_conv"), F.col("parent_turn").alias("up_turn"), F.lit(1).alias("depth")), "chains")
    while True:
        up = chains.select(F.col("conv_id").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("next_conv"), F.col("up_turn").alias("next_turn"), F.col("depth").alias("more"))
        on = chains.join(up, ["up_conv", "up_turn"], "left")
        new = on.select("conv_id", "turn", F.coalesce("next_conv", "up_conv").alias("up_conv"), F.coalesce("next_turn", "up_turn").alias("up_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("grew"))
        new = materialize(new, "chains")
        discard(chains)
        chains = new.drop("grew")
        chains._work_path = new._work_path
        if not new.where("grew").take(1):
            break
    heads = chains.select("conv_id", "turn", F.col("up_conv").alias("head_conv"), F.col("up_turn").alias("head_turn"), "depth")
    out = rows.join(parents, ["conv_id", "turn"], "left").join(heads, ["conv_id", "turn"], "left")
    thread = [F.coalesce("head_conv", "conv_id").alias("thread_conv"), F.coalesce("head_turn", "turn").alias("thread_turn")]
    return out.select("conv_id", "turn", "role", "text", "parent_conv", "parent_turn", *thread, F.coalesce("depth", F.lit(0)).alias("depth"), F.size("quotes").alias("quotes"), F.coalesce("linked", F.lit(0)).cast("int").alias("linked"))


def conversations(messages: DataFrame) -> DataFrame:
    """Messages formatted for chat training, to be sorted by thread_conv, thread_turn, conv_id and turn: each as <|role|>, its text and <|end|>."""
    return linked(messages).withColumn("formatted", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n")))


def op3_quote_links(messages: DataFrame) -> DataFrame:
    """All messages in reply order without quotes, with their links. See `linked`."""
    return conversations(messages)
