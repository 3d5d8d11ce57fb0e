"""Conversation repair against enumeration of all edit lists and against a plain program."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from weighyard.llm import conversation_repair as repair
from weighyard.llm.turn_grammar import TOPS, Row, parse

TYPES = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def enumerated(rows):
    """The least (cost, audit) over all edit lists with at most three inserts, and its role initials."""
    best = (2 * len(rows), "D" * len(rows), "")

    def go(at, cost, audit, roles, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit, roles))
        if inserts < 3:
            for role in "ua":
                go(at, cost + 5, audit + "I", roles + role, inserts + 1)
        if at < len(rows):
            row = rows[at]
            go(at + 1, cost + 2, audit + "D", roles, inserts)
            if not row.must_go:
                more = 5 if row.truncated else 0
                go(at + 1, cost + more, audit + "K", roles + row.initial, inserts)
                for role in "ua":
                    go(at + 1, cost + more + 1, audit + "R", roles + role, inserts)

    go(0, 0, "", "", 0)
    return best


def test_parser_finds_the_cheapest_edits():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [Row(rng.choice("suasuauPt "), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 6))]
        cost, audit, roles = parse(rows)
        assert (cost, audit, roles.replace("-", "")) == enumerated(rows), rows


def test_stacks_are_few():
    assert len(TOPS) == 10


def plain(rows, damaged=True):
    """The contract, one conversation at a time."""
    def shown(value):
        return " " if value is None else str(value)

    found = defaultdict(list)
    for conv, turn, role, text in rows:
        own = found[conv]
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        known = [r[0] for r in own if r[0] is not None]
        seen, parsed, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = text.strip(" \t\n\r\x0b\x0c")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            parsed.append(Row(role[:1] or " ", fault in (0, 1), fault == 2))
        cost, audit, roles = parse(parsed)
        lines, left = [], iter(own)
        for action, given in zip(audit, roles):
            role, text = (NAMES[given], "") if action == "I" else next(left)[1:]
            if action != "D":
                lines.append(f"{NAMES[given] if action == 'R' else role}:{text}")
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts,
                     sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(parsed, parsed[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def reported(df, block_rows=repair.BLOCK_ROWS, damaged=True):
    rows = repair.turns(df)
    found = repair.repair_report(repair.damage(rows) if damaged else rows, rows, block_rows).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert reported(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_long_conversation_in_blocks_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(7, n // 2 if n % 7 else None, rng.choice(["user", "assistant", "system", None, "", "tool", "Player"]),
             rng.choice(["Hi.", "x", "", None, " \t", "End! \n", f"t{n}.", f"t{n}", f"w{n}?"])) for n in range(1500)]
    rows += [(None, None, None, None), (None, 3, "user", "Q."), (None, 4, "assistant", "A."), (8, 0, "user", "Only.")]
    df = spark.createDataFrame(rows, TYPES).repartition(5)
    assert reported(df, block_rows=41) == plain(rows)
    assert reported(df, block_rows=41, damaged=False) == plain(rows, damaged=False)


def test_many_copies_of_one_row(spark):
    rows = [(1, 0, "user", "Q.")] * 3000 + [(1, 1, "assistant", "A.")] * 10
    assert reported(spark.createDataFrame(rows, TYPES), block_rows=16, damaged=False) == plain(rows, damaged=False)


def test_dropped_conversation_has_zeros(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    found = reported(spark.createDataFrame([(5, turn, "user", "Q.")], TYPES))
    assert found == {5: (0, 0, 0, 0, 0, 0, "", empty)}


def test_empty_table_and_clashing_columns(spark):
    assert reported(spark.createDataFrame([], TYPES)) == {}
    df = spark.createDataFrame([(1, 0, "user", "Q.", 5, "x"), (1, 1, "user", "A.", 6, "y")],
                               TYPES + ", copies int, digest string")
    assert reported(df, damaged=False)[1][4:6] == (1, 1)


def test_repaired_rows_have_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Q."), (1, 2, "user", "A."), (1, 3, "user", "More?")]
    repaired, report = repair.repair(repair.turns(spark.createDataFrame(rows, TYPES)))
    found = [tuple(r) for r in repaired.orderBy("part", "block", "edit").select("role", "text", "action").collect()]
    # KKRD, KKDR and KDKR cost the same; KDKR is first in ASCII.
    assert report.first().audit == "KDKR"
    assert found == [("system", "Be kind.", "K"), ("user", "A.", "K"), ("assistant", "More?", "R")]
