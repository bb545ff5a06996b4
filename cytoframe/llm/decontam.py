"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping pieces of PIECE characters. If a region of a document matches a piece
of m characters within e edits, the two share at least m - q + 1 - q * e character q-grams, all within a band of
diagonals (place in the document less place in the piece) no wider than e. So each task counts shared q-grams by
document, piece and overlapping diagonal band, keeps the bands that reach the bound, and verifies those
by an alignment that is restricted to the band. Before diagonals are looked at, a document must have that many
q-grams of any piece within one window of a piece's length, which follows from the same bound.

A quote of a part of an item is surely found from 172 characters on (without edits, signs and white space as one); shorter parts are found where they
nearly cover a piece; items of under PIECE characters are found whole.

Texts are compared lower-cased, with runs of signs and white space as one space; offsets refer to the text as it is.
The benchmark goes to the tasks in blocks of BLOCK_CHARS characters at most, each one pass over the documents; the
documents are never shuffled.

Defined results: null and empty texts match nothing; benchmark items without a letter or digit match nothing;
items shorter than a q-gram match only as whole words; an item without an id gives rows with a null item_id and drops documents like
any other; equal items each give their row (those without an id one row together); repeated rows give
repeated rows; an empty table gives an empty table; other columns are ignored (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.llm.common import parts

Q = 12
PIECE = 120
ERRORS = 0.06
#: Characters of benchmark text that one pass takes.
BLOCK_CHARS = 4_000_000
#: Bits of a group's table at most, which has four for each q-gram.
BITS = 25
SIGNS = re.compile(r"[\W_]+")
_B = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(3)]


def normal(text: str) -> str:
    return SIGNS.sub(" ", text.lower()).strip()


def _offsets(text: str) -> tuple[str, list[int]]:
    """The normal text, and for each of its characters the place in text it comes from (and one past the end)."""
    out, at = [], []
    for m in re.finditer(r"[\W_]+|[^\W_]+", text):
        if SIGNS.fullmatch(m.group()):
            if out:
                out.append(" ")
                at.append(m.start())
        else:
            for i, c in enumerate(m.group(), m.start()):
                for x in c.lower():
                    out.append(x)
                    at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), [*at, at[-1] + 1 if at else 0]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def qgrams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 12 characters from each place on: of 1, 2, 4 and 8, then 8 and 4 together."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    h = c + np.uint64(1)
    h = h[:-1] * _B[0] + h[1:]
    four = h[:-2] * _B[1] + h[2:]
    eight = four[:-4] * _B[2] + four[4:]
    return eight[:-4] * _B[2] + four[8:]


_letters: dict[int, bool] = {}


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The normal texts' characters end to end, and where each begins (and the end), without making the strings."""
    low = [t.lower() for t in texts]
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in low])
    plane = np.zeros(int(c.max()) + 1 if len(c) else 1, bool)
    for x in np.flatnonzero(np.bincount(c, minlength=len(plane))).tolist():
        if (yes := _letters.get(x)) is None:
            yes = _letters[x] = not SIGNS.match(chr(x))
        plane[x] = yes
    word = plane[c]
    follows = np.zeros(len(c), bool)
    follows[:-1] = word[1:]
    follows[ends[(ends > 0) & (ends <= len(c))] - 1] = False
    keep = word | follows  # of each run of signs the last, if a letter comes next
    out = np.where(word, c, 32)[keep].astype(np.uint64)
    counts = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    first = counts[:-1][counts[:-1] < counts[1:]]
    lead = first[out[first] == 32]
    if len(lead):
        counts = counts - np.searchsorted(lead, counts)
        out = np.delete(out, lead)
    return out, counts


@dataclass
class Piece:
    item: int
    text: str
    errors: int
    least: int


def cut_pieces(items: list[tuple[int, str]]) -> list[Piece]:
    """Pieces of the normal texts: windows of PIECE characters every half of it, shorter texts whole."""
    out = []
    for item, text in items:
        text = normal(text or "")
        if not text:
            continue
        spans = [(0, len(text))] if len(text) <= PIECE else [(a, a + PIECE) for a in range(0, len(text) - PIECE, PIECE // 2)] + [(len(text) - PIECE, len(text))]
        for a, b in spans:
            m = b - a
            errors = max(0, min(int(m * ERRORS), (m - Q + 1 - 4) // Q))
            out.append(Piece(item, text[a:b], errors, m - Q + 1 - Q * errors))
    return out


class Group:
    """Q-grams of pieces of about one length: sorted hashes, their places, and a table of bits, sized by them, to pass over most others."""

    def __init__(self, pieces: list[Piece], numbers: list[int]):
        grams = [qgrams(codes(p.text)) for p in pieces]
        self.hashes = np.concatenate(grams)
        self.piece = np.repeat(np.array(numbers), [len(g) for g in grams])
        self.place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.piece, self.place = self.hashes[order], self.piece[order], self.place[order]
        self.shift = np.uint64(64 - min(max(int(np.ceil(np.log2(4 * len(self.hashes)))), 16), BITS))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.hashes >> self.shift] = True
        self.least = min(p.least for p in pieces)
        self.window = max(len(p.text) + p.errors for p in pieces)


class Index:
    """The pieces, grouped by the number of q-grams they ask for, so that one short item doesn't loosen the search for long ones."""

    def __init__(self, items: list[tuple[int, str]]):
        self.pieces = cut_pieces(items)
        self.short = [p for p in self.pieces if len(p.text) < Q]
        long = [(p, i) for i, p in enumerate(self.pieces) if len(p.text) >= Q]
        split: dict[int, list[tuple[Piece, int]]] = {}
        for p, i in long:
            split.setdefault(p.least.bit_length(), []).append((p, i))
        self.groups = [Group([p for p, _ in x], [i for _, i in x]) for _, x in sorted(split.items())]
        self.band = max((p.errors for p, _ in long), default=0) + 1
        self.leasts = np.array([p.least for p in self.pieces], np.int64)

    def candidates(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, piece, first diagonal of the band) that reach the lemma's bound; bands are two widths wide and overlap."""
        if not self.groups:
            return []
        c, starts = packed(texts)
        h = qgrams(c)
        if not len(h):
            return []
        # no q-gram goes over a text's end
        over = (starts[1:-1, None] - np.arange(1, Q)).ravel()
        over = over[(over >= 0) & (over < len(h))]
        return [found for group in self.groups for found in self._of_group(group, h, starts, over)]

    def _of_group(self, group: Group, h: np.ndarray, starts: np.ndarray, over: np.ndarray) -> list[tuple[int, int, int]]:
        maybe = group.bits[h >> group.shift]
        maybe[over] = False
        hit = np.flatnonzero(maybe)
        hit = hit[_dense(hit, group)]
        low = np.searchsorted(group.hashes, h[hit])
        real = low < len(group.hashes)
        real[real] = group.hashes[low[real]] == h[hit[real]]
        hit, low = hit[real], low[real]
        dense = _dense(hit, group)
        hit, low = hit[dense], low[dense]
        if not len(hit):
            return []
        size = np.searchsorted(group.hashes, h[hit], side="right") - low
        total = int(size.sum())
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
        where, piece = np.repeat(hit, size), group.piece[at]
        owner_of = np.searchsorted(starts[1:], where, side="right")
        diagonal = where - starts[owner_of] - group.place[at]
        width = self.band
        n, span = len(self.pieces), int(np.diff(starts).max()) // width + PIECE // width + 4
        bins = diagonal // width + PIECE // width + 2
        key = (owner_of * n + piece) * span + bins
        keys, count = np.unique(key, return_counts=True)
        # band b holds the diagonals of bins b and b + 1; a bin alone is in the bands that begin at it and before it
        bands, where_to = np.unique(np.concatenate([keys, keys - 1]), return_inverse=True)
        sums = np.bincount(where_to, weights=np.concatenate([count, count])).astype(np.int64)
        pieces = bands // span % n
        good = sums >= self.leasts[pieces]
        first = (bands[good] % span - PIECE // width - 2) * width
        return [(int(t), int(p), int(d)) for t, p, d in zip(bands[good] // (span * n), pieces[good], first)]


def _dense(hit: np.ndarray, group: Group) -> np.ndarray:
    """Whether each place lies in some window of a piece's length with as many of the places as any piece of the group asks for."""
    ends = np.searchsorted(hit, hit + group.window)
    begin = np.flatnonzero(ends - np.arange(len(hit)) >= group.least)
    edge = np.bincount(begin, minlength=len(hit) + 1) - np.bincount(ends[begin], minlength=len(hit) + 1)
    return np.cumsum(edge)[: len(hit)] > 0


def band_search(piece: str, text: str, first: int, width: int, errors: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of piece in text that begins near diagonals first to first + width.

    Semi-global alignment by bit vectors over the band's stretch of text alone (free ends in the text).
    """
    low, high = max(0, first - errors), min(len(text), first + width + len(piece) + errors)
    best = _last_column(piece, text[low:high], errors)
    if best is None:
        return None
    edits, end = best
    back = _last_column(piece[::-1], text[max(low, low + end - len(piece) - errors) : low + end][::-1], edits)
    return edits, low + end - back[1] if back else low, low + end


def _last_column(piece: str, text: str, errors: int) -> tuple[int, int] | None:
    """Least edits, and the first end in text that has them, of piece against any stretch of text; None if over errors."""
    m = len(piece)
    peq: dict[str, int] = {}
    for i, c in enumerate(piece):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = errors + 1, -1
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j
    return (best, end) if best <= errors else None


def find_matches(index: Index, texts: list[str]) -> dict[int, dict[int, list[tuple[int, int, int]]]]:
    """text -> item -> (start, end, edits) of verified regions, in code points of the text as it is."""
    hits: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
    plain: dict[int, str] = {}
    for t, p, first in index.candidates(texts):
        if t not in plain:
            plain[t] = normal(texts[t])
        piece = index.pieces[p]
        got = band_search(piece.text, plain[t], first, 2 * index.band, piece.errors)
        if got:
            hits.setdefault(t, {}).setdefault(piece.item, []).append((got[1], got[2], got[0]))
    for t, text in enumerate(map(normal, texts)) if index.short else ():
        for piece in index.short:
            for m in re.finditer(rf"(?<!\S){re.escape(piece.text)}(?!\S)", text):
                hits.setdefault(t, {}).setdefault(piece.item, []).append((m.start(), m.end(), 0))
    out = {}
    for t, items in hits.items():
        _, at = _offsets(texts[t])
        out[t] = {i: sorted({(at[a], at[b - 1] + 1, e) for a, b, e in spans}) for i, spans in items.items()}
    return out


MATCH = "array<struct<item_id: bigint, start: bigint, end: bigint, edits: bigint>>"
_KIND = pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "start", "end", "edits")]))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in order of id, in blocks of BLOCK_CHARS characters at most (one item at least)."""
    block: list[tuple[int, str]] = []
    size = 0
    items = benchmark.select(F.col("item_id").cast("bigint").alias("i"), F.col("text").alias("t")).orderBy("i", "t")
    for r in items.toLocalIterator():
        n = len(r.t or "")
        if block and size + n > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block:
        yield block


def with_matches(df: DataFrame, items: list[tuple[int, str]], column: str, text: str = "text") -> DataFrame:
    """df and a column of the verified regions of each row's text."""
    sent = df.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([*df.schema.fields, T.StructField(column, T._parse_datatype_string(MATCH))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch, texts in parts(batches, text):
            index = index or Index(sent.value)
            found = find_matches(index, texts)
            rows = [[{"item_id": i, "start": a, "end": b, "edits": e} for i, spans in found[t].items() for a, b, e in spans] if t in found else [] for t in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _KIND)], names=[*batch.schema.names, column])

    return df.mapInArrow(run, schema)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_regions, start and end (first and last code point, end exclusive) and least edits; a row for each document and item that match."""
    docs = documents.select(F.col("doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").alias("text"))
    found = [with_matches(docs, block, "m").select("doc_id", "row", F.explode("m").alias("m")) for block in _blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_regions bigint, start bigint, end bigint, edits bigint")
    rows = reduce(DataFrame.unionByName, found)
    return (
        rows.groupBy("doc_id", "row", "m.item_id")
        .agg(F.count("*").alias("n_regions"), F.min("m.start").alias("start"), F.max("m.end").alias("end"), F.min("m.edits").alias("edits"))
        .drop("row")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that match no item, with all their columns."""
    out = documents
    names = documents.columns
    for block in _blocks(benchmark):
        plain = out.toDF(*[f"c{i}" for i in range(len(names))])
        marked = with_matches(plain, block, "m", f"c{names.index('text')}")
        out = marked.where(F.size("m") == 0).drop("m").toDF(*names)
    return out
