"""Toxicity: a linear-chain conditional random field over tokens.

Labels are given for documents, the chain works on tokens. In a clean document every token is clean; in a toxic one at
least one token is toxic, which one isn't known. So the labels of tokens are expected ones: in each round forward and backward messages
give every token the probability of being toxic, first by the chain alone, then given the document's label, and the weights move by
the difference of the expected counts (the gradient of the labels' likelihood). No word list is mined or given. A document is a
row of segments of SEGMENT tokens in training; words, their beginnings and ends count as features if enough documents have them.

Over a whole text, the messages give every token the probability of being toxic; runs of tokens at 0.5 or more are the
offending spans (code points). A document's score is the largest probability that a stretch of SEGMENT tokens holds a toxic one,
so that it doesn't grow with the length of a text.

Labels are read only from the rows given as training rows; the score of a document depends on its text alone.
Training uses a bounded sample (MAX_DOCUMENTS rows, chosen by hashes, of at most MAX_TOKENS tokens each); scoring is one pass
over each task's own rows, without a shuffle, linear in the text.

Defined results: a null or empty text has the score 0 and no spans; with no toxic label in the sample every
score is 0; repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.llm.common import parts

TOKEN = re.compile(r"\w+")
#: Labelled rows that the model is trained on at most, and tokens that each of them may have.
MAX_DOCUMENTS = 4_000
MAX_TOKENS = 2_000
SEGMENT = 48
#: A feature counts if so many documents of the sample (or such a fraction of them) have it.
LEAST_DOCUMENTS = 4
LEAST_FRACTION = 0.002
FOLDS = 5
MAX_WORDS = 400_000


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def token_features(word: str) -> tuple[str, ...]:
    """The word and its beginnings."""
    return ("w" + word, "4" + word[:4], "5" + word[:5])


@dataclass
class Chain:
    """Weights: bias and features raise the odds of state 1; moves are log weights from state to state."""

    bias: float = -10.0
    weights: dict[str, float] = field(default_factory=dict)
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # 0-0, 0-1, 1-0, 1-1

    def emission(self, word: str) -> float:
        """Odds of state 1 against state 0 that the token itself gives."""
        get = self.weights.get
        return math.exp(max(-40.0, min(40.0, self.bias + sum(get(f, 0.0) for f in token_features(word)))))


def messages(odds: np.ndarray, lengths: np.ndarray, moves: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the token's own odds) and backward messages for every token of the sequences laid end to end.

    The sequences advance together, longest first, one token a step; messages are ratios of the two states.
    """
    a, b, c, d = np.exp(moves)  # 0-0, 0-1, 1-0, 1-1
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], lengths[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")  # sequences of at least t + 1 tokens
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    now = None
    for t in range(steps):
        n = active[t]
        at = first[:n] + t
        now = odds[at] if t == 0 else odds[at] * ((b + now[:n] * d) / (a + now[:n] * c))
        forward[at] = now
    end = first + size - 1
    back = None
    for t in range(steps):
        n = active[t]
        at = end[:n] - t
        if t == 0:
            back = np.ones(n)
        else:
            e = odds[at + 1] * back[:n]
            back = (c + d * e) / (a + b * e)
        backward[at] = back
    return forward, backward


def marginals(odds: np.ndarray, lengths: np.ndarray, moves: tuple[float, ...]) -> np.ndarray:
    """Probability of state 1 for every token."""
    forward, backward = messages(odds, lengths, moves)
    both = forward * backward
    return both / (1 + both)


def clean_logs(odds: np.ndarray, lengths: np.ndarray, moves: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithm of the probability that all tokens of each sequence are clean, and the forward and backward messages.

    It is that of the first token being clean, and of each next one being clean after a clean one.
    """
    forward, backward = messages(odds, lengths, moves)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    step = np.log1p(np.exp(moves[1] - moves[0]) * odds * backward)
    step[starts] = np.log1p(forward[starts] * backward[starts])
    return -np.add.reduceat(step, starts) if len(starts) else np.zeros(0), forward, backward


def cut_segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the segments of documents laid end to end, and the document of each."""
    n = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(SEGMENT, lengths[owner] - number * SEGMENT), owner


def fit_chain(documents: list[list[str]], toxic: list[int], *, rounds: int = 80, rate: float = 0.5, penalty: float = 5e-3, start: float = -7.0) -> Chain:
    """Maximum likelihood of the documents' labels by adaptive gradient steps; documents without a token are left out."""
    full = [(d, y) for d, y in zip(documents, toxic) if d]
    if not any(y for _, y in full):
        return Chain()
    y = np.array([v for _, v in full], float)
    ids, words = pd.factorize(np.array([w for d, _ in full for w in d], object))
    sizes = np.array([len(d) for d, _ in full])
    lengths, owner = cut_segments(sizes)
    of_token = np.repeat(np.arange(len(full)), sizes)
    # features that enough documents have; 0 stands for the others
    features: dict[str, int] = {}
    table = np.array([[features.setdefault(f, len(features)) for f in token_features(w)] for w in words])
    pairs = np.unique(np.stack([np.repeat(of_token, table.shape[1]), table[ids].ravel()]), axis=1)
    often = np.bincount(pairs[1], minlength=len(features)) >= max(LEAST_DOCUMENTS, math.ceil(LEAST_FRACTION * len(full)))
    slot = np.where(often, np.cumsum(often), 0)
    table, names = slot[table], [f for f, i in features.items() if often[i]]
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - 1] = False  # tokens with a next one in their segment
    at = np.flatnonzero(inner)
    weights, bias, moves = np.zeros(len(names) + 1), start, np.zeros(4)
    gw, gb, gm = np.full(len(weights), 1e-8), 1e-8, np.full(4, 1e-8)
    for _ in range(rounds):
        odds = np.exp(np.clip(bias + weights[table].sum(1), -40, 40))[ids]
        logs, forward, backward = clean_logs(odds, lengths, tuple(moves))
        clean = np.exp(np.minimum(np.bincount(owner, weights=logs, minlength=len(full)), -1e-9))
        p = forward * backward / (1 + forward * backward)
        # expected counts given the label, less those without it, are the latter times this
        pull = np.where(y == 1, clean / (1 - clean), -1.0)[of_token]
        g = np.bincount(ids, weights=p * pull, minlength=len(words))
        grad = np.bincount(table.ravel(), weights=np.repeat(g, table.shape[1]), minlength=len(weights)) / len(full) - penalty * weights / 100
        grad[0] = 0
        gw += grad**2
        weights += rate * grad / np.sqrt(gw)
        total = g.sum() / len(full)
        gb += total**2
        bias += 0.3 * rate * total / np.sqrt(gb)
        stay, go, leave, keep = np.exp(moves)
        ahead = odds[at + 1] * backward[at + 1]
        pair = np.stack([np.full(len(at), stay), go * ahead, leave * forward[at], keep * forward[at] * ahead])
        pair /= pair.sum(0)
        pair[0] -= 1  # the way of clean tokens has nothing but this move
        g4 = (pair * pull[at]).sum(1) / len(full) - 1e-3 * moves
        gm += g4**2
        moves += 0.1 * rate * g4 / np.sqrt(gm)
    kept = {f: round(float(w), 6) for f, w in zip(names, weights[1:]) if abs(w) > 1e-4}
    return Chain(round(float(bias), 6), kept, tuple(round(float(m), 6) for m in moves))


def _by_hash(*columns: str) -> list[Column]:
    return [F.xxhash64(*columns), *map(F.col, columns)]


def training_documents(documents: DataFrame, labels: DataFrame, most: int = MAX_DOCUMENTS) -> tuple[list[list[str]], list[int]]:
    """Tokens and label of at most ``most`` rows of labels (doc_id, toxic), those with the smallest hashes of the id.

    Rows of over MAX_TOKENS tokens are no training rows, and near copies with one label, which mostly share the least hash of their
    five-word windows, are one.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic is not null")
        .orderBy(*_by_hash("id"), "toxic")
        .limit(most)
    )
    rows = documents.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).join(F.broadcast(chosen), "id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, "text"):
            out = []
            for text, toxic in zip(texts, batch.column("toxic").to_pylist()):
                words = tokens_of(text)
                if 0 < len(words) <= MAX_TOKENS:
                    origin = min(crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4)))
                    out.append((" ".join(words), toxic, origin))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["words", "toxic", "origin"])

    once = rows.mapInArrow(run, "words string, toxic int, origin bigint").groupBy("origin", "toxic").agg(F.min("words").alias("words"))
    got = once.toPandas().sort_values(["toxic", "origin", "words"])  # `most` rows at most
    return [w.split(" ") for w in got.words], got.toxic.tolist()


def fit_toxicity(documents: DataFrame, labels: DataFrame, most: int = MAX_DOCUMENTS) -> Chain:
    """A chain from at most ``most`` rows of labels (doc_id, toxic)."""
    return fit_chain(*training_documents(documents, labels, most))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, by FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def score_texts(df: DataFrame, chain: Chain, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, spans (start, end and probability of offending runs) for each row."""
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [T.StructField(key, source.schema["key"].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", T._parse_datatype_string("array<struct<start: bigint, end: bigint, p: double>>"))]
    )
    sent = df.sparkSession.sparkContext.broadcast(chain)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch, texts in parts(batches, "text"):
            words = [tokens_of(t) for t in texts]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            odds = np.empty(int(lengths.sum()))
            at = 0
            if len(known) > MAX_WORDS:
                known.clear()
            for ws in words:
                for w in ws:
                    if w not in known:
                        known[w] = model.emission(w)
                odds[at : at + len(ws)] = [known[w] for w in ws]
                at += len(ws)
            p = marginals(odds, lengths, model.moves)
            ends = np.cumsum(lengths)
            pieces, owner = cut_segments(lengths)
            stretch = np.zeros(len(texts))
            np.maximum.at(stretch, owner, -np.expm1(clean_logs(odds, pieces, model.moves)[0]))
            scores, spans = [], []
            for text_, begin, end, most in zip(texts, ends - lengths, ends, stretch):
                own = p[begin:end]
                scores.append(float(max(most, own.max())) if len(own) else 0.0)
                spans.append(_runs(text_, own) if len(own) and own.max() >= 0.5 else [])
            columns = [batch.column("key"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "score", "spans"])

    return source.mapInArrow(run, schema)


def _runs(text: str, p: np.ndarray) -> list[dict]:
    """Offsets of runs of tokens at 0.5 or more. Lower-casing may lengthen a text, so tokens are found in it anew."""
    low = text.lower()
    found = list(TOKEN.finditer(low))
    back = None
    if len(low) != len(text):
        back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    out: list[dict] = []
    last = -2
    for i in np.flatnonzero(p >= 0.5):
        a, b = found[i].span()
        if back:
            a, b = back[a], back[b - 1] + 1
        if i == last + 1:
            out[-1] |= {"end": b, "p": max(out[-1]["p"], float(p[i]))}
        else:
            out.append({"start": a, "end": b, "p": float(p[i])})
        last = i
    return out
