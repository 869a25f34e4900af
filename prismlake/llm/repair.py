"""Conversation structure repair: cheapest edits to a grammar of roles, by a recursive DuckDB query inside hash-partitioned batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from prismlake.llm._shared import utf8_rows

#: Rows and bytes of text that a task looks at together, about.
BATCH_ROWS, BATCH_BYTES = 1 << 15, 1 << 25
#: Rows of one piece of a conversation; pieces are walked side by side, longer conversations have several.
PIECE_ROWS = 128
BLANKS = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
# grammar states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, role) to the state that the role leads to; roles are numbered as the states that they end in.
NEXT = {(START, SYSTEM): SYSTEM, (START, USER): USER, (SYSTEM, USER): USER, (ASSISTANT, USER): USER, (USER, ASSISTANT): ASSISTANT}
#: What a state still lacks: inserted turns up to the end of an answer.
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5


def _given(state: int) -> int:
    """The role that a rerole or an insertion gives in a state."""
    return ASSISTANT if state == USER else USER


def _moves() -> list[tuple[int, int, int | None, bool, int, str]]:
    """(state, next state, role asked for, stays, cost, letters) of every way past one row: up to two insertions, then an edit."""
    out = []
    for source in range(4):
        at, cost, letters = source, 0, ""
        for _ in range(3):
            out.append((source, at, None, False, cost + DELETE, letters + "D"))
            out += [(source, NEXT[at, r], r, True, cost, letters + "K") for r in (SYSTEM, USER, ASSISTANT) if (at, r) in NEXT]
            out.append((source, _given(at), None, True, cost + REROLE, letters + "R"))
            at, cost, letters = _given(at), cost + INSERT, letters + "I"
    return out


_WALK = f"""
WITH RECURSIVE walk AS (
  SELECT piece, source, 0 AS i, source AS state, {{'cost': 0, 'audit': ''}} AS best FROM sources
  UNION ALL
  SELECT w.piece, w.source, w.i + 1, m.target, min({{'cost': w.best.cost + m.cost + CASE WHEN m.stays AND s.fault = {TRUNCATED} THEN {CUT_OFF} ELSE 0 END, 'audit': w.best.audit || m.letters}})
  FROM walk AS w JOIN steps AS s ON s.piece = w.piece AND s.i = w.i
  JOIN moves AS m ON m.state = w.state AND (m.role IS NULL OR m.role = s.role) AND (NOT m.stays OR s.fault NOT IN ({BLANK}, {DUPLICATE}))
  GROUP BY w.piece, w.source, w.i, m.target
)
SELECT w.piece, w.source, w.state, w.best.cost, w.best.audit FROM walk AS w JOIN (SELECT piece, count(*) AS n FROM steps GROUP BY piece) AS p ON p.piece = w.piece AND p.n = w.i
"""


class _Walker:
    """Walks all pieces of a batch at once: a recursion takes every piece one turn on and keeps the least (cost, audit) of each state."""

    def __init__(self):
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute("CREATE TABLE moves (state INT, target INT, role INT, stays BOOLEAN, cost INT, letters VARCHAR)")
        self.con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", _moves())

    def walk(self, piece: np.ndarray, place: np.ndarray, role: np.ndarray, fault: np.ndarray, sources: list[tuple[int, int]]) -> dict[int, list[tuple[int, int, int, str]]]:
        """Piece to (source, state, cost, audit) for every source asked for and state that can be reached."""
        self.con.register("steps", pa.table({"piece": piece, "i": place.astype(np.int32), "role": role.astype(np.int32), "fault": fault.astype(np.int32)}))
        self.con.register("sources", pa.table({"piece": pa.array([p for p, _ in sources], pa.int64()), "source": pa.array([s for _, s in sources], pa.int32())}))
        out: dict[int, list[tuple[int, int, int, str]]] = {}
        for p, *rest in self.con.execute(_WALK).fetchall():
            out.setdefault(p, []).append(tuple(rest))
        return out


class _Path:
    """A way to a grammar state: its cost, edits, the hash of what it has repaired, and the picks of earlier batches."""

    def __init__(self, cost: int = 0, audit: str = "", sha=None, any_turn: bool = False, picks: tuple = ()):
        self.cost, self.audit, self.sha, self.any_turn, self.picks = cost, audit, sha or hashlib.sha256(), any_turn, picks

    def extended(self, state: int, cost: int, audit: str, rows: list[tuple[bytes, int, bytes]], picks: tuple) -> tuple[_Path, list[dict]]:
        """This path with a batch's edits made to its rows (role, its number, text), and the turns that they give."""
        out, turns, first, at = _Path(self.cost + cost, self.audit + audit, self.sha.copy(), self.any_turn, picks), [], True, iter(rows)
        for letter in audit:
            role, number, text = (b"", 0, b"") if letter == "I" else next(at)
            if letter == "D":
                continue
            if letter != "K":
                number = _given(state)
                role = b"user" if number == USER else b"assistant"
            state = NEXT[state, number]
            turns.append({"role": role, "text": text, "edit": letter})
        for t in turns:
            out.sha.update(b"%s%s:%s" % (b"\n" if out.any_turn or not first else b"", t["role"], t["text"]))
            first = False
        out.any_turn |= bool(turns)
        return out, turns


class _Open:
    """A conversation up to where a batch ended: the way to each grammar state, and what has been counted."""

    def __init__(self, conv):
        self.conv, self.paths, self.batch = conv, {START: _Path()}, 0
        self.faults, self.illegal, self.last = np.zeros(4, np.int64), 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def count(self, turns: list[int | None], initials: list[str], faults: np.ndarray) -> None:
        self.faults += np.bincount(faults, minlength=4)
        for a, b in zip([self.last, *initials], initials, strict=False):
            self.illegal += a is not None and a + b not in ("su", "ua", "au")
        self.last = initials[-1] if initials else self.last
        for t in turns:
            if t is not None and t != self.turn:
                self.low, self.high, self.turn = t if self.low is None else self.low, t, t
                self.turns += 1

    def through(self, pieces: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
        """(origin, state, cost, audit) of the cheapest way from the states before the batch to each state after it."""
        ways = {s: (p.cost, p.audit, s, 0, "") for s, p in self.paths.items()}
        for piece in pieces:
            new: dict[int, tuple] = {}
            for source, state, cost, audit in piece:
                if source in ways:
                    total, whole, origin, c, a = ways[source]
                    way = (total + cost, whole + audit, origin, c + cost, a + audit)
                    if state not in new or way[:2] < new[state][:2]:
                        new[state] = way
            ways = new
        return [(origin, state, c, a) for state, (_, _, origin, c, a) in ways.items()]


_SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "picks", "batch", "state", "turns"]
_SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, picks array<struct<batch: int, state: int>>, batch int, state int, turns array<struct<role: string, text: string, edit: string>>"


class _Task:
    """Sorted rows in, conversations out. A conversation that a batch ends in goes on with one path for each grammar state."""

    def __init__(self, with_turns: bool):
        self.walker, self.open, self.with_turns, self.out = _Walker(), None, with_turns, []

    def take(self, ids: list, kept: np.ndarray, turn: list, role: list[bytes], initial: list[str], number: np.ndarray, fault: np.ndarray, text: list[bytes]) -> None:
        """Rows of one batch; all but its last conversation are finished."""
        edge = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
        runs, piece, place, sources = [], [], [], []
        for a, b in zip([0, *edge], [*edge, len(ids)], strict=True):
            at = a + np.flatnonzero(kept[a:b])
            conv = self.open if self.open and not a and self.open.conv == ids[a] else _Open(ids[a])
            n = -(-len(at) // PIECE_ROWS)
            base = len(sources) and sources[-1][0] + 1
            piece.append(base + np.arange(len(at)) // PIECE_ROWS)
            place.append(np.arange(len(at)) % PIECE_ROWS)
            sources += [(base + k, s) for k in range(n) for s in (range(4) if k else conv.paths)]
            runs.append((conv, at, range(base, base + n)))
        if self.open and runs[0][0] is not self.open:
            self.finish(self.open)
        at = np.concatenate([r[1] for r in runs])
        walked = self.walker.walk(np.concatenate(piece), np.concatenate(place), number[at], fault[at], sources) if len(at) else {}
        for k, (conv, at, pieces) in enumerate(runs):
            own = at.tolist()
            conv.count([turn[i] for i in own], [initial[i] for i in own], fault[at])
            rows = [(role[i], int(number[i]), text[i]) for i in own]
            ways = conv.through([walked[p] for p in pieces])
            if k == len(runs) - 1:
                self.carry(conv, ways, rows)
            else:
                self.finish(conv, ways, rows)

    def carry(self, conv: _Open, ways: list, rows: list) -> None:
        """Go on with one path for each state; the turns of each are given out, and which of them count is known at the end."""
        paths = {}
        for origin, state, cost, audit in ways:
            picks = (conv.paths[origin].picks, (conv.batch, state))
            paths[state], turns = conv.paths[origin].extended(origin, cost, audit, rows, picks)
            if self.with_turns and turns:
                self.out.append((conv.conv, {"batch": conv.batch, "state": state, "turns": turns}))
        conv.paths, conv.batch, self.open = paths, conv.batch + 1, conv

    def finish(self, conv: _Open, ways: list | None = None, rows: list | None = None) -> None:
        """Insert what the grammar still lacks and give out the conversation."""
        ends = []
        for origin, state, cost, audit in ways if ways is not None else [(s, s, 0, "") for s in conv.paths]:
            lacks, path = TO_END[state], conv.paths[origin]
            ends.append((path.cost + cost + INSERT * lacks, path.audit + audit + "I" * lacks, origin, cost + INSERT * lacks, audit + "I" * lacks))
        _, _, origin, cost, audit = min(ends)
        best, turns = conv.paths[origin].extended(origin, cost, audit, rows or [], ())
        picks, chain = [{"batch": conv.batch, "state": -1}], conv.paths[origin].picks
        while chain:
            chain, (batch, state) = chain
            picks.append({"batch": batch, "state": state})
        if self.with_turns and turns:
            self.out.append((conv.conv, {"batch": conv.batch, "state": -1, "turns": turns}))
        gaps = 0 if conv.low is None else conv.high - conv.low + 1 - conv.turns
        _, blank, duplicate, truncated = conv.faults.tolist()
        self.out.append((conv.conv, dict(zip(_SUMMARY, (gaps, blank, duplicate, truncated, conv.illegal, best.cost, best.audit, best.sha.hexdigest(), picks), strict=False))))
        self.open = None

    def taken(self, kind: pa.DataType) -> pa.RecordBatch:
        pick, turn = pa.struct([("batch", pa.int32()), ("state", pa.int32())]), pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        types = {"audit": pa.string(), "repaired_sha256": pa.string(), "picks": pa.list_(pick), "batch": pa.int32(), "state": pa.int32(), "turns": pa.list_(turn)}
        for _, r in self.out:
            for t in r.get("turns", ()):
                t["role"], t["text"] = (t[c].decode("utf-8", "replace") for c in ("role", "text"))
        columns = [pa.array([c for c, _ in self.out], kind), *[pa.array([r.get(n) for _, r in self.out], types.get(n, pa.int64())) for n in _SUMMARY]]
        self.out = []
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_SUMMARY])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at, kept): rows as a fixed damage leaves them; rows that it drops stay with `kept` false.

    crc32 of `conv_id:turn` modulo 20 tells: 0 drops a row, 1 empties its text, 2 takes . ! ? out, 3 repeats it, 4
    makes its role user. Nulls are one space, but for null turns and conv_ids, which stay null outside that key.
    """
    own = lambda c: conversations[f"`{c}`"]
    rows = conversations.select(own("conv_id").alias("conv_id"), own("turn").cast("long").alias("turn"), *[F.coalesce(own(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("harm", (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).cast("int"))
    harm = F.col("harm")
    rows = rows.withColumns({"role": F.when(harm == 4, F.lit("user")).otherwise(F.col("role")), "text": F.when(harm == 1, F.lit("")).when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0), F.when(harm == 3, 1).otherwise(0))).alias("at"), (harm != 0).alias("kept"))


def repaired(rows: DataFrame, turns: bool = True, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Cheapest repairs of conversations (conv_id, turn, role, text, at, kept), see `damaged`; rows that aren't kept only name their conversation.

    Role initials must read `(s?(ua)+)?`. Keeping a row costs 0, making its role user or assistant 1, deleting it 2, inserting
    an empty turn of user or assistant 5; blank and duplicate rows must be deleted, truncated ones that stay cost 5
    more. Among cheapest edits the string of their initials decides, the least first.

    Gives one row for each conversation with gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and
    picks, and, where asked for, rows with turns, array<struct<role, text, edit>>, of batch and state; those that picks name, in
    order of batch, are the repaired conversation (`conversation_turns` joins them; one row, but for long conversations).

    Rows are dealt by conv_id and sorted, so a task reads conversations as a stream and holds one batch. Conversations of
    a batch, cut into pieces of 128 rows, are walked by one recursive query: each recursion takes all of them one turn on. Pieces
    other than a first start in every state and are chained. What a batch doesn't finish goes on with a cost, audit and hash for each
    state, so a conversation may be of any length; being hashed in order, it is read by one task.

    Rows of equal turn are ordered by role and text; null turns come first; null conv_ids are one conversation. Roles whose initial isn't
    s, u or a, empty ones too, can't be kept. An empty table gives no rows; other columns aren't read.
    """
    solid, initial = F.rtrim(F.col("text"), F.lit(BLANKS)), F.substring("role", 1, 1)
    order = [F.col("turn").asc_nulls_first(), F.col("at")]
    again = F.row_number().over(W.partitionBy("conv_id", "kept", "role", "text").orderBy(*order)) > 1
    fault = F.when(solid == "", BLANK).when(again, DUPLICATE).when(F.substring(solid, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    number = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START)
    dealt = rows.repartition("conv_id").select("conv_id", "kept", "turn", "role", initial.alias("initial"), number.alias("number"), fault.alias("fault"), "text", "at")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "at").drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, kind = _Task(turns), [], None

        def take() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            column = lambda c: t.column(c).to_pylist()
            task.take(column("conv_id"), np.array(column("kept"), bool), column("turn"), list(utf8_rows(t.column("role"))), column("initial"), np.array(column("number")), np.array(column("fault")), list(utf8_rows(t.column("text"))))
            return task.taken(kind)

        for whole in batches:
            kind = whole.schema.field("conv_id").type
            for a in range(0, whole.num_rows, batch_rows):
                b = whole.slice(a, batch_rows)
                if held and (sum(h.num_rows for h in held) + b.num_rows > batch_rows or sum(h.get_total_buffer_size() for h in held) > BATCH_BYTES):
                    yield take()
                    held = []
                held.append(b)
        if held:
            yield take()
        if task.open:
            task.finish(task.open)
            yield task.taken(kind)

    return dealt.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_SCHEMA}")


def conversation_turns(found: DataFrame) -> DataFrame:
    """(conv_id, batch, turns) of `repaired(turns=True)`: what the picks of each conversation name; conversations without turns are absent."""
    picks = found.where("picks IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.explode("picks").alias("p")).select("_conv", F.col("p.batch").alias("_batch"), F.col("p.state").alias("_state"))
    parts = found.where("turns IS NOT NULL")
    return parts.join(picks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("batch") == F.col("_batch")) & (F.col("state") == F.col("_state"))).select("conv_id", "batch", "turns")


def op13_repair(conversations: DataFrame) -> DataFrame:
    """Contract of op13: damaged conversations and their cheapest repairs. See `damaged` and `repaired` for odd rows."""
    return repaired(damaged(conversations), turns=False).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
