"""Conversations repaired to a grammar of roles by the cheapest edits.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in pairs, told by the first letters of
roles. Each turn is kept (0), given the other role (3) or deleted (4, the only choice for blank and repeated turns); empty turns may be
inserted anywhere (3); a turn that ends without a full stop and stays costs 3 more. Of the cheapest ways the one whose edits (K, R, D, I) come first in ASCII is taken.

A conversation's turns stream by in order. Over four states of the grammar (nothing yet, after the system turn, after a user's,
after an assistant's) each turn opens a layer that carries the least (cost, edits) of every state; inserts, two at most one after another, close it. Equal costs
mean that neither string of edits begins the other, so comparing what has been written so far decides as the whole would. States that another one beats whatever
follows are dropped, and what all strings share is set aside, so a layer is short however long the conversation.

Texts are streamed twice: once for edits, then, behind a row with their conversation's edits, to carry them out. Repeated turns are found before:
those of one number of a turn stand side by side, those of different numbers come from a grouping by conversation and digest that is summed before the shuffle.

Defined results: a null role or text counts as one space; turns without a number come first, turns of one number by role, then text; rows without a
conversation id form one conversation; an empty table gives an empty table; columns beside the four named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.llm.common import discard, stored

#: Costs of edits, and of a turn that stays unfinished.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn whose role begins with the letter, by the state before.
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What a turn becomes that is given a role or inserted.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Letters that strings of edits grow to before their shared beginning is set aside.
SHARE_FROM = 512
#: Digests of repeated turns that are broadcast at most; beyond, they are joined by a shuffle.
MOST_REPEATED = 200_000
BATCH_ROWS, BATCH_CHARS = 5_000, 2_000_000

BLANK = r"\A[\x20\x09-\x0D]*\z"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"

AUDIT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = "conv_id bigint, seq bigint, edit string, role string, text string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as one space where a string is meant."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))


def damage(conversations: DataFrame, *, kinds: int = 20) -> DataFrame:
    """turns_of with some turns dropped, emptied, without full stops, twice or under the wrong role, by a checksum of conversation and turn."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % kinds
    rows = turns_of(conversations).withColumn("_kind", kind).where("_kind <> 0")
    changed = rows.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    changed = changed.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    return changed.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def _key() -> Column:
    """A digest of role and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 32))


def seen_before(turns: DataFrame) -> DataFrame:
    """turns with again: whether a turn of a lower number has the same role and text."""
    rows = turns.withColumn("_key", _key())
    # null, the lowest number, is no value to min and max
    first = F.when(F.count("turn") < F.count("*"), F.lit(None)).otherwise(F.min("turn"))
    repeated = rows.groupBy("conv_id", "_key").agg(first.alias("_first"), F.max("turn").alias("_last"), F.count("*").alias("_n")).where("_n > 1 and not (_first <=> _last)")
    few = repeated.select("conv_id", "_key", "_first", F.lit(True).alias("_known"))
    few = stored(few, "repeated-turns")
    small = few.limit(MOST_REPEATED + 1).count() <= MOST_REPEATED
    b = (F.broadcast(few) if small else few).withColumnsRenamed({"conv_id": "_conv", "_key": "_other"})
    on = rows["conv_id"].eqNullSafe(b["_conv"]) & (rows["_key"] == b["_other"])
    later = F.col("turn").isNotNull() & (F.col("_first").isNull() | (F.col("turn") > F.col("_first")))
    out = rows.join(b, on, "left").withColumn("again", F.coalesce(F.col("_known") & later, F.lit(False))).drop("_key", "_conv", "_other", "_first", "_known")
    out._stored = few
    return out


class Walk:
    """The layers of one conversation."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}
        self.shared: list[str] = []
        self.close()

    def close(self) -> None:
        """Inserted turns: a user's after any state but a user's, then an assistant's."""
        best = self.best
        user = min((c + INSERT, e + "I") for s, (c, e) in best.items() if s != USER) if len(best) > 1 or USER not in best else None
        if user and (USER not in best or user < best[USER]):
            best[USER] = user
        cost, edits = best[USER]
        assistant = (cost + INSERT, edits + "I")
        if ASSISTANT not in best or assistant < best[ASSISTANT]:
            best[ASSISTANT] = assistant
        # after an assistant's turn all goes on as at the start, but that a system turn must go, and as after a system turn
        least = best[ASSISTANT][0]
        if START in best and best[START][0] > least + DELETE:
            del best[START]
        if SYSTEM in best and best[SYSTEM][0] > least:
            del best[SYSTEM]
        if min(len(e) for _, e in best.values()) > SHARE_FROM:
            head = commonprefix([e for _, e in best.values()])
            if head:
                self.shared.append(head)
                self.best = {s: (c, e[len(head) :]) for s, (c, e) in best.items()}

    def turn(self, letter: str, gone: bool, unfinished: bool) -> None:
        stay = UNFINISHED if unfinished else 0
        layer: dict[int, tuple[int, str]] = {}
        for state, (cost, edits) in self.best.items():
            ways = [(state, cost + DELETE, "D")]
            if not gone:
                if (kept := GRAMMAR.get((state, letter))) is not None:
                    ways.append((kept, cost + stay, "K"))
                ways.append((NEXT[state], cost + REROLE + stay, "R"))
            for to, c, edit in ways:
                if to not in layer or (c, edits + edit) < layer[to]:
                    layer[to] = (c, edits + edit)
        self.best = layer
        self.close()

    def end(self) -> tuple[int, str]:
        cost, edits = min(self.best[s] for s in (START, ASSISTANT) if s in self.best)
        return cost, "".join(self.shared) + edits


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 1_000):
            some = b.slice(at, 1_000)
            yield from zip(*(some.column(n).to_pylist() for n in names))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _batched(make: Callable[[Iterator[tuple]], Iterator[tuple]], names: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches from one over rows; batches end at so many rows or characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for row in make(_columns(batches, names)):
            some.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(some) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield _table(some, schema)
                some, size = [], 0
        if some:
            yield _table(some, schema)

    return run


def _audits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row of AUDIT for each conversation of rows (conv_id, turn, role, text, again, blank, finished) that come in order."""
    now = None

    def done() -> tuple:
        cost, audit = walk.end()
        gaps = high - low + 1 - distinct if distinct else 0
        return (now[0], gaps, n_blank, n_again, n_open, illegal, cost, audit)

    for conv, turn, role, text, again, blank, finished in rows:
        if now is None or conv != now[0]:
            if now is not None:
                yield done()
            now, before, walk = (conv,), None, Walk()
            low = high = last = None
            distinct = n_blank = n_again = n_open = illegal = 0
        same = before is not None and (before[0], before[1], before[2]) == (turn, role, text)
        again = again or same
        letter = role[:1]
        if turn is not None and turn != last:
            low, high, last, distinct = turn if low is None else low, turn, turn, distinct + 1
        if before is not None and (before[1][:1], letter) not in (("s", "u"), ("u", "a"), ("a", "u")):
            illegal += 1
        n_blank += blank
        n_again += again and not blank
        n_open += not (blank or again or finished)
        walk.turn(letter, blank or again, not finished)
        before = (turn, role, text)
    if now is not None:
        yield done()


def conversation_audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, the string of edits, of each conversation in turns.

    gaps: numbers of turns that are missing between the first and the last; blank, duplicate and truncated: turns by their first fault;
    illegal: neighbours whose roles may not follow each other. turns as ``turns_of`` gives them.
    """
    marked = seen_before(turns)
    rows = marked.withColumn("blank", F.col("text").rlike(BLANK)).withColumn("finished", F.col("text").rlike(FINISHED))
    names = ["conv_id", "turn", "role", "text", "again", "blank", "finished"]
    dealt = rows.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
    out = dealt.mapInArrow(_batched(_audits, names, schema), AUDIT)
    out._stored = marked._stored
    return out


def _carried_out(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of REPAIRED: the edits of each conversation, which come first (as text, without a role), on the turns after them."""
    conv, edits, at, seq, state = None, "", 0, 0, START
    deleted = lambda role, text: (conv, None, "D", role, text)

    def inserted() -> Iterator[tuple]:
        nonlocal at, seq, state
        while at < len(edits) and edits[at] == "I":
            state = NEXT[state]
            yield (conv, seq, "I", NAMES[state], "")
            at, seq = at + 1, seq + 1

    for conv, is_turn, role, text in rows:
        if not is_turn:
            edits, at, seq, state = text, 0, 0, START
            yield from inserted()
            continue
        edit, at = edits[at], at + 1
        if edit == "D":
            yield deleted(role, text)
        else:
            state = GRAMMAR[state, role[:1]] if edit == "K" else NEXT[state]
            yield (conv, seq, edit, role if edit == "K" else NAMES[state], text)
            seq += 1
        yield from inserted()


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, seq, edit, role, text: every edit in order; deleted turns have no seq. A conversation's rows follow each other in one partition."""
    none = F.lit(None)
    heads = audits.select("conv_id", F.lit(0).alias("is_turn"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"))
    rows = heads.unionByName(turns.select("conv_id", F.lit(1).alias("is_turn"), "turn", "role", "text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", F.col("turn").asc_nulls_first(), "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return dealt.mapInArrow(_batched(_carried_out, ["conv_id", "is_turn", "role", "text"], schema), REPAIRED)


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    now, digest, first = None, None, True
    for conv, seq, role, text in rows:
        if now is None or conv != now[0]:
            if now is not None:
                yield (now[0], digest.hexdigest())
            now, digest, first = (conv,), hashlib.sha256(), True
        if seq is not None:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
    if now is not None:
        yield (now[0], digest.hexdigest())


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of what ``repaired_turns`` gives, whose order it goes by: the digest of role:text of the repaired turns, a line each."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return repaired.select("conv_id", "seq", "role", "text").mapInArrow(_batched(_digests, ["conv_id", "seq", "role", "text"], schema), "conv_id bigint, repaired_sha256 string")


def repair_report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation of conversations, repaired from turns: audit columns and repaired_sha256; zeros, no edits and the empty digest where no turn is left."""
    audits = conversation_audits(turns)
    repeated, audits = audits._stored, stored(audits, "audits")
    discard(repeated)
    digests = repaired_digests(repaired_turns(turns, audits))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    facts = audits.withColumnRenamed("conv_id", "_a")
    ends = digests.withColumnRenamed("conv_id", "_d")
    joined = every.join(facts, F.col("conv_id").eqNullSafe(F.col("_a")), "left").join(ends, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
