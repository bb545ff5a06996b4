"""Byte-pair encoding and decoding by traversal of a prefix-sharing trie.

The distinct words of a slice of texts, sorted, are the leaves of a trie of symbols in depth-first order. A walk over
them gives each node the last token of the encoding of its prefix: the one vocabulary token that ends there and may
follow the last token stated at the node where it begins (two tokens may stand together if encoding their joined
symbols gives those two again). Only the path to the word at hand is held. So a prefix that many words share is encoded
once, and a word's tokens are read off by stepping back from its leaf. The tokens that can end at a node are known by the
longest end of its prefix that begins a token. Each task works on its own slices; nothing is shuffled, and the words a
task remembers are bounded.

The vocabulary is a public JSON file whose place is a parameter: NFC, white space runs to one space, lower case,
a split into contractions, letters, single digits and other signs, bytes as symbols, an end-of-word suffix.
Strings of the file's special tokens inside a text become those tokens. Decoding joins token strings by spaces.

Defined results: a null text counts as empty (no tokens, decoded text empty); an empty table gives an empty
table; repeated rows give repeated rows. Input columns other than the named ones are ignored by ``encode_texts``.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.llm.common import parts

#: Unicode White_Space, which the vocabulary's normaliser turns into spaces.
SPACE = "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


# --- fixed values: code points that the pattern library takes for letters or digits and the vocabulary's library doesn't yet ---
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de "
    "1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
#: Capitals that the vocabulary's library lowers and Python doesn't yet: single ones, and runs with what is added.
CAPITALS = "1c89:1c8a a7cb:264 a7cc:a7cd a7ce:a7cf a7d2:a7d3 a7d4:a7d5 a7da:a7db a7dc:19b"
CAPITAL_RUNS = "10d50-10d65:20 16ea0-16eb8:1b"
# --- end of fixed values ---
LOWER = {int(a, 16): int(b, 16) for a, b in (x.split(":") for x in CAPITALS.split())}
LOWER |= {c: c + int(d, 16) for r, d in (x.split(":") for x in CAPITAL_RUNS.split()) for c in range(int(r[:5], 16), int(r[6:], 16) + 1)}
_RANGES = "".join("-".join(chr(int(c, 16)) for c in span.split("-")) for span in NEWER.split())
HAS_NEWER = regex.compile(f"[{_RANGES}{''.join(map(chr, LOWER))}]")
#: PIECES with those taken for signs.
OLD_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_RANGES}]]+|[\p{{N}}--[{_RANGES}]]|(?:[^{SPACE}\p{{L}}\p{{N}}]|[{_RANGES}])+", regex.V1)

#: Words whose encodings a task keeps between slices; beyond it starts again.
MAX_WORDS = 250_000
#: Pairs of tokens, and ends of prefixes with a symbol more, that a task remembers; beyond it starts again.
MAX_PAIRS, MAX_STEPS = 400_000, 100_000


@lru_cache(1)
def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as sequences of symbols; symbol b is a byte, 256 + b the same byte at a word's end."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        sign = {c: b for b, c in byte_signs().items()}

        def symbols(token: str) -> str:
            end = token.endswith(suffix) and token != suffix
            codes = [sign[c] for c in (token[: -len(suffix)] if end else token)]
            return "".join(map(chr, [*codes[:-1], codes[-1] + 256] if end else codes))

        self.tokens = {symbols(t): i for t, i in model["vocab"].items()}
        self.symbols = {i: s for s, i in self.tokens.items()}
        #: What tokens begin with.
        self.begins = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.sizes = {i: len(s) for i, s in self.symbols.items()}
        ids = model["vocab"]
        self.merges = {(ids[a], ids[b]): (rank, ids[a.removesuffix(suffix) + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.whole: dict[int, bool] = {}
        self.forget()
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def forget(self) -> None:
        """Lets go what was remembered of words and pairs of tokens."""
        #: Whether the second token may follow the first, by both in one number.
        self.pairs: dict[int, bool] = {}
        self.steps: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}
        #: Packed ids of words met lately, in two generations of MAX_WORDS at most.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, symbols: str) -> list[int]:
        """Plain merging by rank: the definition, used for single tokens and pairs of tokens only."""
        out = [self.tokens[s] for s in symbols]
        get = self.merges.get
        found = [get(p) for p in zip(out, out[1:])]
        while True:
            best = None
            for i, merge in enumerate(found):
                if merge is not None and (best is None or merge < best):
                    best, at = merge, i
            if best is None:
                return out
            out[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = get((out[at - 1], out[at]))
            if at < len(found):
                found[at] = get((out[at], out[at + 1]))

    def stands(self, token: int) -> bool:
        """Whether the token's own symbols are encoded as this token."""
        if (yes := self.whole.get(token)) is None:
            yes = self.whole[token] = self.merged(self.symbols[token]) == [token]
        return yes

    def follows(self, left: int, right: int) -> bool:
        """Whether right may stand after left."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        yes = self.pairs[left << 32 | right] = self.merged(self.symbols[left] + self.symbols[right]) == [left, right]
        return yes

    def step(self, end: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """The longest end of the symbols that begins a token, and the tokens that end there with their sizes, longest first."""
        if len(self.steps) >= MAX_STEPS:
            self.steps.clear()
        at = next(i for i in range(len(end) + 1) if end[i:] in self.begins)
        ending = [(self.tokens[end[i:]], len(end) - i) for i in range(at, len(end)) if end[i:] in self.tokens]
        found = self.steps[end] = end[at:], tuple(x for x in ending if self.stands(x[0]))
        return found

    def pieces(self, text: str, pattern: regex.Pattern = PIECES) -> list[str]:
        """The words of a text; special tokens come as they are, after a NUL and a mark."""
        if self.special_split and any(s in text for s in self.special):
            out: list[str] = []
            for i, part in enumerate(self.special_split.split(text)):
                out += ["\0special\0" + part] if i % 2 else self.pieces_plain(part, pattern)
            return out
        return self.pieces_plain(text, pattern)

    @staticmethod
    def pieces_plain(text: str, pattern: regex.Pattern = PIECES) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            # each code point is lowered alone: no special form of sigma at a word's end
            text = text.replace("Σ", "σ")
        text = text.lower()
        return pattern.findall(text if pattern is PIECES else text.translate(LOWER))

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of words: sorted, last-token states along the path to each, tokens read back from its leaf."""
        out: dict[str, bytes] = {}
        rows = []
        for word in words:
            if word.startswith("\0special\0") and word[9:] in self.special:
                out[word] = pack("<I", self.special[word[9:]])
                continue
            data = word.encode().decode("latin-1")
            rows.append((data[:-1] + chr(ord(data[-1]) + 256), word))
        rows.sort()
        sizes, pairs, steps = self.sizes, self.pairs, self.steps
        before = ""
        ends = [""]  # of the prefix of each length of the word at hand, the longest end that begins a token
        last: list[int] = []  # of the prefix of each length, the last token
        for symbols, word in rows:
            shared = 0
            for x, y in zip(symbols, before):
                if x != y:
                    break
                shared += 1
            before = symbols
            del last[shared:], ends[shared + 1 :]
            end = ends[-1]
            for depth in range(shared, len(symbols)):
                key = end + symbols[depth]
                end, ending = steps.get(key) or self.step(key)
                for token, size in ending:
                    if size > depth:
                        break  # the whole prefix
                    left = last[depth - size]
                    yes = pairs.get(left << 32 | token)
                    if yes or yes is None and self.follows(left, token):
                        break
                ends.append(end)
                last.append(token)
            found = []
            depth = len(symbols)
            while depth:
                token = last[depth - 1]
                found.append(token)
                depth -= sizes[token]
            found.reverse()
            out[word] = pack(f"<{len(found)}I", *found)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        words = set().union(*split)
        if odd := {w for w in words if not w.isascii() and HAS_NEWER.search(w)}:
            split = [x if odd.isdisjoint(x) else self.pieces(t, OLD_PIECES) for x, t in zip(split, texts)]
            words = set().union(*split)
        new = {w for w in words if w not in self.known}
        back = {w: self.older[w] for w in new if w in self.older}
        gc.disable()  # many small tuples and numbers without cycles
        try:
            back |= self.learn(new - back.keys())
        finally:
            gc.enable()
        if len(self.known) + len(back) > MAX_WORDS:
            # words of this slice stay; those not met since the last change of generations go
            self.older, self.known = self.known, {w: x for w in words if (x := self.known.get(w))}
        self.known |= back
        return [b"".join(map(self.known.__getitem__, x)) for x in split]

    def decode(self, ids: bytes) -> str:
        """The tokens of packed ids, joined by spaces (the vocabulary has no decoder of its own)."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def load_vocabulary(text: str) -> Vocabulary:
    return Vocabulary(json.loads(text))


def encode_texts(df: DataFrame, vocabulary: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, token_ids (binary, little-endian unsigned 32-bit ids) and decoded (string), a row for each row of df.

    vocabulary: the path of the JSON file on the driver; its content (under 2 MB) goes to the tasks as a broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    source = df.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load_vocabulary(spec.value)
        try:
            for batch, texts in parts(batches, "__text"):
                ids = vocab.encode(texts)
                columns = [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(map(vocab.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "token_ids", "decoded"])
        finally:
            vocab.forget()  # workers outlive their tasks

    return source.mapInArrow(run, schema)


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
