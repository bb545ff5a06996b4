"""Exact encoding and decoding by a public vocabulary of merged pieces with byte fallback, by backtracking.

The model's merging joins, of all neighbours whose joined text is a piece, those of the highest score. A sequence of
pieces is its result if each two neighbours stand as they are when their own texts are merged again. So a word is
encoded from the left: an Aho-Corasick automaton gives the longest piece at each place, neighbours are checked by
merging both again in step, and where a piece may not follow, the next shorter one is tried, at last the place before; a
bitfield keeps places that have failed, so none is tried twice.

Texts are cut into words where no piece reaches across: before a run of spaces, and around signs that the vocabulary lacks, which
become bytes. Runs of spaces are the one exception to the rule of neighbours, as their pieces have one score: what
merging leaves of a run is merged plainly, once for each length of a run. Distinct words of a slice are encoded once; nothing is shuffled.

The model file's place is a parameter; of its normalisers only the identity is taken. Defined results: a null text counts as empty (no ids, decoded
text empty); an empty table gives an empty table; repeated rows give repeated rows; columns beside the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.llm.common import parts

#: What stands for a space inside pieces.
SPACE = "▁"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: What an unknown id is decoded to.
UNKNOWN_TEXT = " ⁇ "
#: Distinct words that a task remembers between slices, and checked neighbours.
MAX_WORDS = 250_000
MAX_PAIRS = 400_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """A vocabulary, and what a task remembers of words and neighbours."""

    def __init__(self, model: bytes):
        found: list[tuple[str, float, int]] = []
        rules = {3: 1, 4: 1, 5: 1}  # dummy prefix, fewer spaces, spaces escaped
        for no, value in fields(model):
            if no == 1:
                f = dict(fields(value))
                found.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif no == 3:
                f = dict(fields(value))
                rules |= {k: f[k] for k in rules if k in f}
                if f.get(2):
                    raise ValueError("the model changes characters before it merges")
        if rules[4] or not rules[5] or any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for *_, kind in found):
            raise ValueError("the model has rules or kinds of pieces that this encoder doesn't know")
        self.prefix = bool(rules[3])
        self.text = [p for p, _, _ in found]
        self.score = {p: s for p, s, kind in found if kind == NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(found) if kind == NORMAL}
        byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(found) if kind == BYTE}
        if len(byte_ids) < 256:
            raise ValueError("the model has no piece for some bytes")
        self.bytes = [byte_ids[b] for b in range(256)]
        self.shown = [{UNKNOWN: UNKNOWN_TEXT, CONTROL: ""}.get(kind, p.replace(SPACE, " ")).encode() if kind != BYTE else bytes([int(p[3:5], 16)]) for p, _, kind in found]
        if any(re.search(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}[^{SPACE}]", p) for p in self.id):
            raise ValueError("pieces reach across the borders of words")
        scores = [s for p, s in self.score.items() if len(p) > 1 and p.strip(SPACE)]
        if len(scores) != len(set(scores)) or scores and min(scores) <= max((s for p, s in self.score.items() if len(p) > 1 and not p.strip(SPACE)), default=-np.inf):
            raise ValueError("pieces of equal score that aren't runs of spaces")
        signs = "".join(map(re.escape, sorted(p for p in self.id if len(p) == 1 and p != SPACE)))
        self.words = re.compile(f"{SPACE}+[{signs}]*|[{signs}]+|[^{SPACE}{signs}]")
        self.signs = {p for p in self.id if len(p) == 1}
        self.trace: dict[int, list[tuple[float, str, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.history(i)[-1][1] == p:  # pieces that merging makes
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = [*map(len, self.text)]
        #: Of each piece the longest one that begins it, or -1.
        self.shorter = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.automaton), -1) for p in self.text]
        self.spaces: dict[int, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        """Lets go what was remembered of words and neighbours."""
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def history(self, token: int) -> list[tuple[float, str, str]]:
        """How a piece's own text is merged: (score of the next merge, first symbol, last symbol) before each merge and at the end."""
        if (out := self.trace.get(token)) is None:
            out, now = [], list(self.text[token])
            while True:
                best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(now, now[1:]))), default=(-np.inf, 0))
                out.append((best[0], now[0], now[-1]))
                if best[0] == -np.inf:
                    break
                now[-best[1] : 2 - best[1]] = ["".join(now[-best[1] : 2 - best[1]])]
            self.trace[token] = out
        return out

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the texts of two pieces, side by side, gives the two: no merge goes across their border."""
        if (yes := self.pairs.get((left, right))) is None:
            a, b, i, j = self.history(left), self.history(right), 0, 0
            while True:
                ahead, behind = a[i][0], b[j][0]
                across = self.score.get(a[i][2] + b[j][1], -np.inf)
                # of equal scores the leftmost is merged first
                if across > ahead and across >= behind:
                    yes = False
                    break
                if ahead == behind == -np.inf:
                    yes = True
                    break
                if ahead >= behind:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = yes
        return yes

    def backtrack(self, word: str, out: list[int], at: int, token: int) -> list[int]:
        """Ids of a word of known signs, of which pieces up to a place have been taken and a piece may not follow there."""
        automaton, size, shorter, pairs, n = self.automaton, self.size, self.shorter, self.pairs, len(word)
        failed = bytearray(n // 8 + 1)
        while True:
            end = at + size[token]
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or ((yes := pairs.get((out[-1], token))) or yes is None and self.follows(out[-1], token))):
                out.append(token)
                if end == n:
                    return out
                at, token = end, next(automaton.iter_long(word, end))[1]
            elif (less := shorter[token]) >= 0:
                token = less
            else:
                # no piece goes on from here: back to the piece before
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= size[token]

    def plain(self, word: str) -> list[int]:
        """Ids of a word of known signs: the longest pieces as far as each may follow the one before, from there on by backtracking."""
        out = [token for _, token in self.automaton.iter_long(word)]
        pairs = self.pairs
        for i, pair in enumerate(zip(out, out[1:])):
            if not (yes := pairs.get(pair)) and (yes is False or not self.follows(*pair)):
                return self.backtrack(word, out[: i + 1], sum(map(self.size.__getitem__, out[: i + 1])), out[i + 1])
        return out

    def run_of_spaces(self, n: int) -> list[int]:
        """Ids of n spaces alone, by plain merging: the leftmost of equal scores first."""
        if n not in self.spaces:
            size, after, before = [1] * n, [*range(1, n), -1], [*range(-1, n - 1)]
            heap = [(-self.score[SPACE * 2], i, 2) for i in range(n - 1)] if SPACE * 2 in self.score else []
            heapq.heapify(heap)
            while heap:
                _, i, both = heapq.heappop(heap)
                j = after[i]
                if not size[i] or j < 0 or size[i] + size[j] != both:
                    continue
                size[i], size[j], after[i] = both, 0, after[j]
                if after[i] >= 0:
                    before[after[i]] = i
                for left, right in ((before[i], i), (i, after[i])):
                    if left >= 0 and right >= 0 and (p := SPACE * (size[left] + size[right])) in self.score:
                        heapq.heappush(heap, (-self.score[p], left, len(p)))
            if len(self.spaces) >= 1_000:
                self.spaces.clear()
            self.spaces[n] = [self.id[SPACE * s] for s in size if s]
        return self.spaces[n]

    def encode_word(self, word: str) -> list[int]:
        if word[0] != SPACE:
            return self.plain(word) if word[0] in self.signs else [self.bytes[b] for b in word.encode()]
        rest = word.lstrip(SPACE)
        n = len(word) - len(rest)
        if n == 1 and rest:
            return self.plain(word)
        own = self.plain(SPACE + rest) if rest else []
        # a last space that stays alone is one of the run
        return self.run_of_spaces(n) + own[1:] if not own or self.text[own[0]] == SPACE else self.run_of_spaces(n - 1) + own

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.words.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        new: dict[str, bytes] = {}
        known, older = self.known, self.older
        for word in set().union(*split):
            if word not in known:
                if (ids := older.get(word)) is None:
                    ids = array("i", self.encode_word(word)).tobytes()
                new[word] = ids
        if len(known) + len(new) > MAX_WORDS:
            # words of this slice stay; those not met since the last change of generations go
            self.older, self.known = known, {w: x for words in split for w in words if (x := known.get(w)) is not None}
        self.known |= new
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), "<i4") for x in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that aren't UTF-8 become U+FFFD, one each; the space before the first piece goes."""
        data = b"".join(map(self.shown.__getitem__, ids.tolist()))
        if self.prefix and data[:1] == b" " and self.text[next(i for i in ids.tolist() if self.shown[i])].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="one-by-one")


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def load_pieces(model: bytes) -> Pieces:
    import codecs

    codecs.register_error("one-by-one", _one_by_one)
    return _loaded(model)


_loaded = lru_cache(1)(Pieces)


def encode_pieces(df: DataFrame, model: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, ids (array of int) and decoded (string), a row for each row of df.

    model: the path of the model file on the driver; its content (under 1 MB) goes to the tasks as a broadcast.
    """
    with open(model, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*(T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    source = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(content.value)
        try:
            for batch, texts in parts(batches, "text"):
                found = pieces.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array(map(pieces.decode, found), pa.string())], names=schema.names)
        finally:
            pieces.forget()  # workers outlive their tasks

    return source.mapInArrow(run, schema).toDF(*keys, "ids", "decoded")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids in decimal and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
