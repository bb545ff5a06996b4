"""Array helpers that take all rows of a batch at once: ranges end to end, alignment operations as places, digests, and texts of numbers and letters."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Messages of digests that are worked out at a time.
LANES = 65_536


def ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, number) of begin, begin + 1, ... of all ranges end to end."""
    owner = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    return owner, np.arange(int(ends[-1]) if len(ends) else 0) + (begin - ends + size)[owner]


def _ops(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), "M" if o in "=X" else o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]


def parsed_cigars(cigars: pa.Array) -> pa.Array:
    """Alignments given as texts, as ``columns.parse_cigar`` has them; each different one is taken apart once."""
    coded = cigars.dictionary_encode()
    kind = pa.list_(pa.struct([("len", pa.int32()), ("op", pa.string())]))
    return pa.array([[{"len": n, "op": o} for n, o in _ops(x)] for x in coded.dictionary.to_pylist()], kind).take(coded.indices)


@lru_cache(50_000)
def _placed(cigar: str) -> tuple[np.ndarray, ...]:
    """op, query (from 0; -1 in a gap), offset from the read's begin, change of length ahead and whether it is the last place, for each place of an alignment."""
    ops = _ops(cigar)
    rows: list[tuple[np.ndarray, ...]] = []
    q = r = 0
    for i, (n, o) in enumerate(ops):
        if o in "MDN" or o == "S" and i:
            k = np.arange(n)
            ahead, last = np.zeros(n, np.int32), np.zeros(n, bool)
            if n:
                after, size = (ops[i + 1][1], ops[i + 1][0]) if i + 1 < len(ops) else ("", 0)
                ahead[-1] = size if after == "I" else -size if after == "D" and o != "D" else 0
                last[-1] = i == len(ops) - 1
            rows.append((np.full(n, ord(o), np.uint8), (q + k if o in "MS" else np.full(n, -1)).astype(np.int32), (r + k).astype(np.int64), ahead, last))
            r += n
        q += n if o in "MIS" else 0
    none = (np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(none, *rows))


@dataclass
class Places:
    """Places that reads take on the reference, read by read: which read, operation, read base (-1 in a gap), offset from the read's begin, change of length ahead, whether it is the last."""

    read: np.ndarray
    op: np.ndarray
    query: np.ndarray
    offset: np.ndarray
    ahead: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, cigars: pa.Array, ops: str) -> Places:
        """cigars: texts of a batch. As ``pileup.expand_reads`` places them: a first soft clip takes no place, later ones do."""
        coded = cigars.dictionary_encode()
        wanted = [ord(o) for o in ops]
        each = []
        for text in coded.dictionary.to_pylist():
            found = _placed(text)
            keep = np.isin(found[0], wanted)
            each.append(found if keep.all() else tuple(x[keep] for x in found))
        each = each or [_placed("")]
        size = np.array([len(x[0]) for x in each], np.int64)
        which = coded.indices.fill_null(len(each)).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.append(size, 0)  # of reads without an alignment
        begin = np.cumsum(size) - size
        read, at = ranges(begin[which], size[which])
        op, query, offset, ahead, last = (np.concatenate(x)[at] for x in zip(*each))
        return cls(read, op, query, offset, ahead, last)

    def where(self, keep: np.ndarray) -> Places:
        return Places(self.read[keep], self.op[keep], self.query[keep], self.offset[keep], self.ahead[keep], self.last[keep])


_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _blocks_digest(words: np.ndarray) -> list[np.ndarray]:
    """MD5 state of messages of one block. words: (16, messages), as the block has them."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    empty = [not w.any() for w in words]
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f), np.add(f, _SINES[i], out=f)
        if not empty[g]:
            np.add(f, words[g], out=f)
        s = _SHIFTS[i // 16 * 16 + i % 4]
        np.right_shift(f, np.uint32(32 - s), out=t), np.left_shift(f, np.uint32(s), out=f), np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [x + y for x, y in zip((a, b, c, d), _START)]


def digests(texts: pa.Array, which: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second half, as whole numbers that sort like them, of the MD5 digest of each texts[which] followed by a number's digits."""
    raw = texts.cast(pa.binary()).to_pylist()
    size = np.array([len(x) for x in raw], np.int64)
    high, low = np.empty(len(which), np.uint64), np.empty(len(which), np.uint64)
    if len(which) and (int(size.max(initial=0)) > 50 or int(number.max(initial=0)) > 9_999):
        found = np.frombuffer(b"".join(hashlib.md5(raw[w] + b"%d" % n).digest() for w, n in zip(which.tolist(), number.tolist())), ">u8").reshape(-1, 2)
        return found[:, 0].astype(np.uint64), found[:, 1].astype(np.uint64)
    heads = np.frombuffer(b"".join(x.ljust(64, b"\0") for x in raw), np.uint8).reshape(-1, 64)
    for at in range(0, len(which), LANES):
        some, digits = which[at : at + LANES], number[at : at + LANES].astype(np.int64)
        block, row, end = heads[some], np.arange(len(some)), size[some].copy()
        for tens in (1_000, 100, 10, 1):
            has = digits >= tens if tens > 1 else np.ones(len(digits), bool)
            who = row if has.all() else row[has]
            if len(who):
                block[who, end[who]] = 48 + digits[who] // tens % 10
                end[who] += 1
        block[row, end] = 0x80
        block[:, 56], block[:, 57] = (end * 8) & 255, (end * 8) >> 8
        a, b, c, d = (x.byteswap().astype(np.uint64) for x in _blocks_digest(np.ascontiguousarray(block.view("<u4").T)))
        high[at : at + LANES], low[at : at + LANES] = a << np.uint64(32) | b, c << np.uint64(32) | d
    return high, low


def count_texts(owner: np.ndarray, n: int, run: np.ndarray, mark: np.ndarray, letter: np.ndarray) -> pa.Array:
    """For each of n owners the text of its pieces end to end: a number (none below 0), ^ where marked and a letter (none at 0). owner: rising."""
    width = np.ones(len(run), np.int64)
    for tens in range(1, len(str(int(run.max(initial=0))))):
        width += run >= 10**tens
    width = np.where(run < 0, 0, width)
    size = width + mark + (letter > 0)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    begin = end - size
    left = run.copy()
    for k in range(int(width.max(initial=0))):
        has = width > k
        out[(begin + width - 1 - k)[has]] = 48 + left[has] % 10
        left //= 10
    out[(begin + width)[mark]] = ord("^")
    has = letter > 0
    out[(begin + width + mark)[has]] = letter[has]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, size, n).astype(np.int64))])
    return pa.StringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))


def joined_letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all strings end to end (null is empty), and where each string begins, with the end."""
    filled = column.cast(pa.string()).fill_null("")
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int32)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64) if len(filled) else np.zeros(1, np.int64)
    letters = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return letters.copy(), at - at[0]
