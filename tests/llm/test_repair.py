"""Repair of conversations: against an enumeration of all edits, a plain walk of whole tables, and odd rows."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest

from cytoframe.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def enumerated(rows):
    """Least (cost, edits) and the repaired turns of rows (letter, gone, unfinished, role, text), over all strings of edits with at most two inserts in each gap."""
    best = None

    def grow(i, roles, cost, edits, out, since):
        nonlocal best
        if best is not None and cost > best[0] or not any(GRAMMAR.fullmatch(roles + end) for end in ("", "a", "ua")):
            return
        if i == len(rows) and GRAMMAR.fullmatch(roles) and (best is None or (cost, edits) < best[:2]):
            best = (cost, edits, out)
        if since < 2:
            for r in ("user", "assistant"):
                grow(i, roles + r[0], cost + 3, edits + "I", [*out, (r, "")], since + 1)
        if i < len(rows):
            letter, gone, unfinished, role, text = rows[i]
            grow(i + 1, roles, cost + 4, edits + "D", out, 0)
            if not gone:
                more = 3 * unfinished
                if letter in ("s", "u", "a"):
                    grow(i + 1, roles + letter, cost + more, edits + "K", [*out, (role, text)], 0)
                for r in ("user", "assistant"):
                    grow(i + 1, roles + r[0], cost + 3 + more, edits + "R", [*out, (r, text)], 0)

    grow(0, "", 0, "", [], 0)
    return best


def plain(rows):
    """The report of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, work = set(), [], []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        work.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, work


def damaged(table):
    out = defaultdict(list)
    for conv, turn, role, text in table:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out[conv] += [row] * (2 if kind == 3 else 1)
    return out


def viterbi(work):
    """As ``enumerated``, layer by layer with whole strings and no state dropped; for conversations of any length."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def better(layer, state, value):
        if state not in layer or value[:2] < layer[state][:2]:
            layer[state] = value

    def closed(layer):
        for _ in range(2):
            for state, (c, e, out) in [*layer.items()]:
                for r in ("user", "assistant"):
                    if (state, r[0]) in step:
                        better(layer, step[state, r[0]], (c + 3, e + "I", [*out, (r, "")]))
        return layer

    layer = closed({"": (0, "", [])})
    for letter, gone, unfinished, role, text in work:
        new = {}
        for state, (c, e, out) in layer.items():
            better(new, state, (c + 4, e + "D", out))
            if not gone:
                if (state, letter) in step:
                    better(new, step[state, letter], (c + 3 * unfinished, e + "K", [*out, (role, text)]))
                for r in ("user", "assistant"):
                    if (state, r[0]) in step:
                        better(new, step[state, r[0]], (c + 3 + 3 * unfinished, e + "R", [*out, (r, text)]))
        layer = closed(new)
    return min(layer[s] for s in ("", "a") if s in layer)


def expected(table, solve):
    out = []
    for conv, rows in damaged(table).items():
        *facts, work = plain(rows)
        cost, edits, kept = solve(work) if rows else (0, "", [])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, *facts, cost, edits, digest))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_table_equals_the_plain_walk(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_repair(spark, data)) == expected(rows, viterbi)


def odd_table():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "", "tool", "ua", "User"]
    texts = ["one.", "two!", "three", "", " \n", None, "four. ", "five? ", "six. ", "é.", "dots...", "long " * 5_000 + "."]
    turns = [*range(-2, 5), None, None]
    table = []
    for conv in [*range(90), None, -5]:
        table += [(conv, rng.choice(turns), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 4))]
    return table + [(700, 1, "user", "same."), (700, 1, "user", "same."), (700, 2, "user", "same.")]


CLASH = ", again boolean, audit string, _key string, is_turn int"


def test_odd_rows_equal_the_enumeration(spark):
    table = odd_table()
    frame = spark.createDataFrame([(*r, True, "x", "k", 7) for r in table], "conv_id bigint, turn bigint, role string, text string" + CLASH)
    assert got(repair.repair_report(frame, repair.damage(frame))) == expected(table, enumerated)
    none = frame.where("false")
    assert repair.repair_report(none, repair.damage(none)).count() == 0


def test_shuffled_join_of_repeated_turns(spark, monkeypatch):
    monkeypatch.setattr(repair, "MOST_REPEATED", 0)
    table = [(k % 3, t, "user" if t % 2 else "assistant", f"say {t % 5}.") for k in range(3) for t in range(40)]
    frame = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string")
    assert got(repair.repair_report(frame, repair.damage(frame))) == expected(table, viterbi)


@pytest.mark.parametrize("letters", ["ua", "x", "u", "sua", "uuaa", "axu"])
def test_long_conversations_share_their_beginnings(letters):
    rng = random.Random(letters)
    work = [(rng.choice(letters) if rng.random() < 0.5 else letters[i % len(letters)], rng.random() < 0.1, rng.random() < 0.2, "r", "t") for i in range(1_500)]
    walk = repair.Walk()
    for letter, gone, unfinished, _, _ in work:
        walk.turn(letter, gone, unfinished)
    assert walk.end() == viterbi(work)[:2]


def test_turns_carry_out_the_edits(spark):
    table = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Yes."), (1, 4, "assistant", "  ")]
    turns = repair.turns_of(spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string"))
    rows = repair.repaired_turns(turns, repair.conversation_audits(turns)).collect()
    edits = "".join(r.edit for r in rows)
    assert edits == "KKIKKD" and [r.seq for r in rows] == [0, 1, 2, 3, 4, None]
    assert [(r.role, r.text) for r in rows if r.seq is not None][2] == ("assistant", "")
