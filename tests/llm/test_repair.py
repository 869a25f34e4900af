"""Conversation repair against every possible edit of small conversations, and a plain loop over long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from prismlake.llm import repair

ROWS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def harmed(rows):
    """Rows after damage by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        own += [(turn, "user" if x == 4 else role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    return {c: sorted(r, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())) for c, r in out.items()}


def faults_of(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        solid = text.strip(SPACE)
        out.append("blank" if not solid else "duplicate" if any(r[1:] == (role, text) for r in rows[:i]) else "truncated" if solid[-1] not in ".!?" else None)
    return out


def counted(rows, faults):
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs))


def every(rows, faults, inserts=3):
    """The cheapest of all edits, each tried: (cost, audit, repaired)."""
    best = None

    def go(i, cost, audit, out, left):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and GRAMMAR.match("".join(r[:1] or "?" for r, _ in out)):
            mine = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
            best = min(best, mine) if best else mine
        if left:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (role, "")], left - 1)
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", out, left)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                go(i + 1, cost + more, audit + "K", [*out, (role, text)], left)
                for r in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", [*out, (r, text)], left)

    go(0, 0, "", [], inserts)
    return best


def one_by_one(rows, faults):
    """The cheapest edits by a plain loop over states."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    name = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def inserted(states):
        for _ in range(2):
            for s, (c, a, o) in list(states.items()):
                for r in "ua":
                    if (s, r) in after:
                        new, t = (c + 5, a + "I", (*o, f"{name[r]}:")), after[s, r]
                        states[t] = min(states.get(t, new), new)
        return states

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (c, a, o) in inserted(states).items():
            options = [(s, (c + 2, a + "D", o))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                options += [(after[s, role[:1]], (c + more, a + "K", (*o, f"{role}:{text}")))] if (s, role[:1]) in after else []
                options += [(after[s, r], (c + more + 1, a + "R", (*o, f"{name[r]}:{text}"))) for r in "ua" if (s, r) in after]
            for t, x in options:
                new[t] = min(new.get(t, x), x)
        states = new
    c, a, o = min(x for s, x in inserted(states).items() if s in ("", "a"))
    return c, a, "\n".join(o)


def expected(rows, solve):
    out = []
    for conv, own in harmed(rows).items():
        faults = faults_of(own)
        cost, audit, body = solve(own, faults)
        out.append((conv, *counted(own, faults), cost, audit, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def test_equals_all_edits_of_small_conversations(spark):
    rng = random.Random(2)
    texts = ["A b.", "What?", "cut off", "", " \t\n", None, "é!", "A b. ", "x. ", "nel.\u0085"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "s", "umbrella"]
    rows = [(conv, rng.choice([None, -3, 2, 5, 5, 9]) if conv % 3 else t, rng.choices(roles, [6, 6, 3, 1, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for conv in range(60) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 1, "assistant", "Hi.")]
    assert got(repair.op13_repair(spark.createDataFrame(rows, ROWS))) == expected(rows, every)


@pytest.mark.parametrize("batch_rows", [37, 700, 1 << 15])
def test_long_conversations_across_batches_and_pieces(spark, batch_rows):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system", "odd"]), rng.choice([f"Text {t}.", f"cut {t}", "Same?", ""])) for t in range(1500)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"{c} {t}.") for c in (1, 2, 8, 9) for t in range(0, 40, 1 + c % 2)]
    found = repair.repaired(repair.damaged(spark.createDataFrame(rows, ROWS).repartition(5)), batch_rows=batch_rows).cache()
    assert got(found.where("picks IS NOT NULL")) == expected(rows, one_by_one)
    parts = {}
    for r in sorted(repair.conversation_turns(found).collect(), key=lambda r: (r["conv_id"], r["batch"])):
        parts.setdefault(r["conv_id"], []).extend(f"{t['role']}:{t['text']}" for t in r["turns"])
    bodies = {r["conv_id"]: r["repaired_sha256"] for r in found.where("picks IS NOT NULL").collect()}
    assert {c: hashlib.sha256("\n".join(p).encode()).hexdigest() for c, p in parts.items()} == bodies


def test_nothing_left_empty_tables_and_extra_columns(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", True, "x", 1)], ROWS + ", kept boolean, number string, `a.b` int")
    assert got(repair.op13_repair(df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(repair.op13_repair(spark.createDataFrame([], ROWS))) == []


def test_a_very_long_text(spark):
    rows = [(1, 1, "user", "a" * 3_000_000 + "."), (1, 2, "assistant", "b. " * 900_000)]
    assert got(repair.op13_repair(spark.createDataFrame(rows, ROWS))) == expected(rows, one_by_one)
