r"""Chat formatting in budgeted windows of whole turns.

Prefix sums of turn tokens choose the spans: a window opens with the conversation's system turn, repeats a
limited stretch of the turns before, and takes as many new turns as its budget allows (always one; turns are
never cut). Only new assistant texts stand under the loss mask; what a window repeats is context.

A turn is written as ``### role: text </turn>`` and a line break. Inside a text every ``\\``, ``#`` and
``</turn`` gets a backslash before it, so that no text can look like a marker and
``parse_windows`` gives back roles and texts exactly.

The rows of a conversation are grouped by its id and walked in order of turn; the walk keeps one window and
the history budget in memory, so a conversation of any length passes through a task as a stream.

Defined results: a null text counts as empty, a null role as ``user``; a null turn number sorts first; rows that
repeat a turn number follow each other ordered by role and text; rows without a conversation id form one of
their own; an empty table gives an empty table; columns beside the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens (words and signs) of a window, and of the history it repeats.
BUDGET = 512
HISTORY = 128
TOKEN = re.compile(r"\w+|[^\w\s]")
SPECIAL = re.compile(r"\\|#|</turn")
ESCAPED = re.compile(r"\\(</turn|\\|#)")
TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*+): ((?:[^\\#<]++|\\(?:</turn|[\\#])|<(?!/turn))*+)</turn>\n")

WINDOWS = "conv_id bigint, window bigint, first_new bigint, n_turns bigint, n_context bigint, text string, loss_starts array<bigint>, loss_ends array<bigint>"


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\:#]", r"\\\g<0>", role).replace("\n", r"\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends in it."""
    head, body = f"### {escape_role(role)}: ", escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


@dataclass
class Open:
    """The window that is being filled."""

    conv: int | None
    number: int = 0
    first_new: int = 0
    parts: list = field(default_factory=list)  # of context, then of new turns: (role, text, tokens, is new)
    prefix: int = 0

    def row(self) -> tuple:
        text, starts, ends, at = [], [], [], 0
        for role, body, _, new in self.parts:
            shown, a, b = render(role, body)
            if new and role == "assistant":
                starts.append(at + a)
                ends.append(at + b)
            text.append(shown)
            at += len(shown)
        fresh = sum(p[3] for p in self.parts)
        return (self.conv, self.number, self.first_new, fresh, len(self.parts) - fresh, "".join(text), starts, ends)


def walk(rows: Iterator[tuple], budget: int, history: int) -> Iterator[tuple]:
    """Windows of rows (conv_id, role, text) that come by conversation and turn."""
    now: Open | None = None
    system: tuple | None = None
    for conv, role, text in rows:
        role, text = role if role is not None else "user", text if text is not None else ""
        cost = len(TOKEN.findall(text)) + 4
        if now is None or conv != now.conv:
            if now is not None:
                yield now.row()
            now, system = Open(conv), None
        fresh = [p for p in now.parts if p[3]]
        if fresh and now.prefix + cost > budget:
            yield now.row()
            keep = [system] if system else []
            spent, back = 0, []
            for p in reversed(fresh):
                if spent + p[2] > history or (system and p is system):
                    break
                spent += p[2]
                back.append(p)
            context = [(*p[:3], False) for p in (*keep, *reversed(back))]
            now = Open(conv, now.number + 1, now.first_new + len(fresh), context, sum(p[2] for p in context))
        part = (role, text, cost, True)
        if role == "system" and system is None and not now.number and not fresh:
            system = part
        now.parts.append(part)
        now.prefix += cost
    if now is not None:
        yield now.row()


def format_windows(conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of each conversation: text, new and repeated turns, and the spans (code points) under the loss mask."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist())

        some: list[tuple] = []
        for row in walk(each(), budget, history):
            some.append(row)
            if len(some) >= 500:
                yield _batch(some, names)
                some = []
        if some:
            yield _batch(some, names)

    return dealt.mapInArrow(run, WINDOWS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int64())] * 2
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=names)


def parse_window(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2][:-1])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"text after the last turn at {at}")
    return out


def window_digests(windows: DataFrame) -> DataFrame:
    """Read back from the windows, for each conversation: its turns, what is under the loss mask, and the size.

    The windows of a conversation are hashed in order as they stream by.
    """
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        turns = loss = None
        for batch in batches:
            for w in batch.to_pylist():
                if not out or out[-1][0] != w["conv_id"]:
                    if out:
                        out[-1][2], out[-1][4] = turns.hexdigest(), loss.hexdigest()
                        if len(out) >= 2_000:
                            yield _digests(out)
                            out = []
                    out.append([w["conv_id"], 0, "", 0, "", 0, 0])
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                row = out[-1]
                for role, text in parse_window(w["text"])[w["n_context"] :]:
                    turns.update(f"{role}\n{text}\n".encode())
                    row[1] += 1
                for a, b in zip(w["loss_starts"], w["loss_ends"]):
                    masked = unescape(w["text"][a:b])
                    loss.update(masked.encode())
                    row[3] += len(masked)
                row[5] += len(w["text"])
                row[6] += 1
        if out:
            out[-1][2], out[-1][4] = turns.hexdigest(), loss.hexdigest()
            yield _digests(out)

    return dealt.mapInArrow(run, schema)


def _digests(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=names)
