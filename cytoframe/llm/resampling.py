"""Documents drawn by how likely their n-grams are under a target text, without replacement.

Features are runs of one to three consecutive words, hashed into buckets. Counts of the buckets in all documents and in the target give each bucket a
gain, a document's weight is the sum of its features' gains, and noise of an extreme value distribution, drawn from the document's id, makes the highest
sums a sample by weight.

A task numbers the words of a block and sorts the block's places by the words that follow (a suffix array as deep as the longest feature). The length
of what neighbours share (LCP) cuts the array into runs of equal n-grams; each run is hashed once, from checksums of its words, and its bucket goes to
counts, or back to all its places to be summed by document. Blocks overlap by the words that a feature may look ahead, so long texts take several.

Only counts of buckets (their number is a parameter) come together in one place. Ranks are positions in a table that is dealt out by score and sorted.

Defined results: a null text has no words; a null id counts as an empty one where noise is drawn; documents with too few words or none keep their score
but aren't drawn; equal scores go by the smaller id (null first), repeated rows in any order; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.llm.common import slices, stored

#: Words of UTF-8 text whose A to Z have been lowered: ASCII letters and digits, and whatever lies beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
LONGEST = 3
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Words of a block, and bytes of a text that are cut into words at once.
BLOCK = 200_000
CUT = 1 << 20
LEAST_WORDS = 20
SHARE = 5
SEED = 42


def cut_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = min(at + CUT, len(text))
        # on to where a word has ended
        end = m.start() if end < len(text) and (m := GAP.search(text, end)) else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def blocks(texts: list[bytes], ahead: int = LONGEST - 1, size: int = BLOCK) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(words, number of the text of each, words at whose places features begin) of blocks; the rest is what features look ahead to."""
    words: list[bytes] = []
    owner: list[np.ndarray] = []
    for i, text in enumerate(texts):
        for some in cut_words(text):
            words += some
            owner.append(np.full(len(some), i))
            if len(words) >= size + ahead:
                of = np.concatenate(owner)
                yield words, of, len(words) - ahead
                words, owner = words[len(words) - ahead :], [of[len(of) - ahead :]]
    if words:
        yield words, np.concatenate(owner), len(words)


class Shifts:
    """Checksums of joined texts from those of their parts: the first one moves on by the length of the second, a linear map on 32 bits."""

    def __init__(self) -> None:
        self.tables: dict[int, np.ndarray] = {}

    def table(self, length: int) -> np.ndarray:
        """Four tables of 256 values, one for each byte of a checksum that moves on by so many bytes."""
        if (out := self.tables.get(length)) is None:
            zeros = bytes(length)
            none = crc32(zeros)
            bits = np.array([crc32(zeros, 1 << i) ^ none for i in range(32)], np.uint32)
            byte = np.arange(256)[:, None] >> np.arange(8)[None, :] & 1
            out = np.stack([np.bitwise_xor.reduce(np.where(byte, bits[None, 8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)])
            if len(self.tables) > 2_000:
                self.tables.clear()
            self.tables[length] = out
        return out

    def join(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Checksums of first texts followed by second ones of these lengths."""
        kinds, at = np.unique(lengths, return_inverse=True)
        tables = np.stack([self.table(int(k)) for k in kinds])
        moved = tables[at, 0, first & 255]
        for k in (1, 2, 3):
            moved ^= tables[at, k, first >> np.uint32(8 * k) & 255]
        return moved ^ second


def gram_runs(words: list[bytes], owner: np.ndarray, begins: int, shifts: Shifts, n_buckets: int, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of features: the bucket of each run of equal n-grams, the run of each occurrence, and the text it lies in."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64) + 1
    own = np.fromiter(map(crc32, number), np.uint32, len(number))
    spaced = np.fromiter((crc32(b" " + w) for w in number), np.uint32, len(number))
    length = np.fromiter(map(len, number), np.int64, len(number)) + 1
    follow = [ids]
    for k in range(1, longest):
        # word k of what follows each place, 0 beyond the text's end
        later = np.zeros_like(ids)
        later[:-k] = np.where(owner[k:] == owner[:-k], ids[k:], 0)
        follow.append(later)
    order = np.lexsort(follow[::-1])
    order = order[order < begins]
    if not len(order):
        return
    sorted_words = [f[order] for f in follow]
    shared = np.zeros(len(order), np.int64)  # LCP with the place before
    equal = np.ones(len(order) - 1, bool)
    for f in sorted_words:
        equal &= f[1:] == f[:-1]
        shared[1:] += equal
    sums = None
    for n in range(1, longest + 1):
        heads = np.flatnonzero(shared < n)
        run = np.cumsum(shared < n) - 1
        last = sorted_words[n - 1][heads]
        known = last > 0  # runs that end within their text
        at = np.maximum(last - 1, 0)
        if sums is None:
            sums = own[at]
        else:
            # the run's first words are those of a run of n - 1 words
            sums = shifts.join(sums[before[heads]], spaced[at], length[at])
        before = run
        keep = known[run]
        compact = np.cumsum(known) - 1
        yield (sums[known] % np.uint32(n_buckets)).astype(np.int64), compact[run[keep]], owner[order[keep]]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for i, j in slices(texts):
            yield batch.slice(i, j - i), texts[i:j]


def bucket_counts(df: DataFrame, *, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often features of each bucket occur in all texts; buckets without any have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shifts = np.zeros(buckets, np.int64), Shifts()
        for _, texts in _texts(batches):
            for block in blocks(texts):
                for bucket, at, _ in gram_runs(*block, shifts, buckets):
                    counts += np.bincount(bucket, weights=np.bincount(at, minlength=len(bucket)), minlength=buckets).astype(np.int64)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["bucket", "n"])

    each = df.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from ``bucket_counts`` of source and target: thousandths of the log ratio of their smoothed shares, rounded down."""
    counts = []
    for df in (source, target):
        n = np.zeros(buckets, np.int64)
        for r in df.collect():  # one row a bucket at most
            n[r.bucket] = r.n
        counts.append(n)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def feature_weights(df: DataFrame, gains: np.ndarray, *, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, n_words, n_features and weight, the sum of the gains of a text's features."""
    places = df.sparkSession.sparkContext.broadcast(gains)
    schema = T.StructType([*(T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, shifts = places.value, Shifts()
        for batch, texts in _texts(batches):
            words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for block in blocks(texts):
                words += np.bincount(block[1][: block[2]], minlength=len(texts))
                for bucket, at, owner in gram_runs(*block, shifts, len(gain)):
                    features += np.bincount(owner, minlength=len(texts))
                    # whole numbers below 2 ** 53: sums of doubles are exact
                    weight += np.bincount(owner, weights=gain[bucket][at], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=schema.names)

    source = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text"))
    return source.mapInArrow(run, schema).toDF(*keys, "n_words", "n_features", "weight")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths, rounded down, of a value of the standard Gumbel distribution that the id decides."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """df with a gapless number from 1 in this order, and the stored table that it reads: dealt out by ranges, sorted, numbered from the ranges' sizes."""
    # rows of one key may lie in several ranges
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    spread = salted.repartitionByRange(*order, F.col("_salt")).sortWithinPartitions(*order, F.col("_salt"))
    # partition and place in it, as Spark composes these ids
    table = stored(spread.drop("_salt").withColumn("_at", F.monotonically_increasing_id()), name)
    at = F.shiftright("_at", 33)
    sizes = table.groupBy(at.alias("_range")).agg(F.count("*").alias("_n")).orderBy("_range").collect()  # one row a partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_range"], total))
        total += r["_n"]
    offsets = df.sparkSession.createDataFrame(starts, "_range bigint, _start bigint")
    rows = table.withColumn("_range", at).join(F.broadcast(offsets), "_range")
    return rows.withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_range", "_start", "_at"), table


def resample(documents: DataFrame, target: DataFrame, *, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null unless it is one of the ``share`` percent drawn.

    documents: doc_id, text; target: text.
    """
    gains = bucket_gains(bucket_counts(documents, buckets=buckets), bucket_counts(target, buckets=buckets), buckets=buckets)
    scored = feature_weights(documents, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    table = stored(scored, "scored")
    eligible = table.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * share // 100
    ranked, _ = numbered(eligible, [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "ranked")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(table.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))
