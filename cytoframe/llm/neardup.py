"""Near-duplicates by Order MinHash over five-word shingles.

The k-mers of a text are its shingles of five words, each labelled with its occurrence number. For each of BANDS hash
functions the sketch takes the two labelled shingles with the smallest hashes and keeps them in the order of the text,
so that texts meet where they share shingles in the same order. Two texts are near-duplicates if an alignment of
their labelled shingle sequences, banded by the number of gaps the threshold allows, matches a share of at
least 0.8 of all shingles (matches over shingles of either text); without moved passages this is their Jaccard similarity.

Equal texts are one text throughout, so a third of all rows may be copies of one text. Texts that share a sketch value
form a bucket. Each bucket links every text to one hub, never all pairs: the text that shares buckets with the most
others. Pairs with at least SHARED sketch values in common are verified by alignment. Then rounds link classes that are
still apart: in each bucket the texts outside its largest class are held against several of that class and of others,
and, with the bucket ordered by further sketch values, against their neighbours; other choices in each round. Hubs and
rounds only make classes few. Whatever is still apart is settled exactly: two texts at the threshold share one of the
rarest fifth of their labelled shingles, so all pairs of different classes that do are verified, but for those
that the places of that shingle, or bitmaps of their shingles, rule out. Pairs carry sequences of shingle hashes, made once a text.
Stored tables are deleted when the classes are known. Rounds go on while they lessen those pairs. Classes are connected components,
found by large-star and small-star steps over tables in the shared folder; after the first round over classes only.

Defined results: null texts count as empty, and all empty texts are equal; a text of fewer than five words is one
shingle; repeated rows are copies of each other; rows without an id take part and may be a class of their own if no copy
has an id; an empty table gives an empty table; other columns are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from cytoframe.llm.common import discard, mix, parts, stored, text_key

WORD = re.compile(r"[^ \t-\r]+")
SHINGLE = 5
THRESHOLD = 0.8
BANDS = 16
#: Sketch values that a pair must share to be aligned; of 16 a pair at the threshold shares fewer once in 300,000 times.
SHARED = 2
#: In a round, texts of a bucket's largest class, other classes, and texts of each, that its other texts are held against.
LARGEST, HUBS, OTHERS = 4, 2, 1
#: Further sketch values that a bucket is ordered by.
DEPTH = 4
#: Rounds end where no more than so many pairs a text, counted once for each rare shingle they share, are left to settle.
EASY = 1_000
#: Texts of a rare shingle that meet in one task.
SALTED = 500
#: 64-bit words of the bitmap of a text's shingles.
SIGNATURE = 8
#: Slots that shingles are counted in, to order them by rarity.
SLOTS = 1 << 22
#: Bytes of sequences that a Python worker works on at once.
SLICE_BYTES = 4 << 20
#: Nodes of candidate pairs that are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_NODES = 500_000


def _shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of the texts end to end, and how many each text has."""
    words = [WORD.findall(t) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    if not flat:
        return np.zeros(0, np.uint64), n
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in flat), np.int64, len(flat))
    w = np.fromiter(map(xxh3_64_intdigest, number), np.uint64, len(number))[ids]
    # a short text is filled up with zeros to one shingle
    fill = np.where((n > 0) & (n < SHINGLE), SHINGLE - n, 0)
    if fill.any():
        w = np.insert(w, np.repeat(np.cumsum(n), fill), np.uint64(0))
    size = n + fill
    doc = np.repeat(np.arange(len(texts)), size)
    m = len(w) - SHINGLE + 1
    h = w[:m].copy()
    for k in range(1, SHINGLE):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + m])
    inside = doc[:m] == doc[SHINGLE - 1 :]
    h, doc = h[inside], doc[:m][inside]
    counts = np.maximum(size - SHINGLE + 1, 0)
    # occurrence numbers: equal shingles of a text in order of place
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = run
    return mix(h + occurrence * np.uint64(0xD1B54A32D192ED03)), counts


def sketches(texts: list[str], bands: int = BANDS) -> list[np.ndarray | None]:
    """For each text ``bands`` 64-bit values (None without words), each of two least labelled shingles in text order."""
    h, counts = _shingle_hashes(texts)
    full = np.flatnonzero(counts)
    out: list[np.ndarray | None] = [None] * len(texts)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    owner = np.repeat(np.arange(len(full)), counts[full])
    place = np.arange(len(h))
    values = np.empty((len(full), bands), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(bands):
        r = mix(h ^ np.uint64((b + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
        least = np.minimum.reduceat(r, starts)
        one = np.minimum.reduceat(np.where(r == least[owner], place, len(h)), starts)
        r[one] = top
        least = np.minimum.reduceat(r, starts)
        two = np.minimum.reduceat(np.where(r == least[owner], place, len(h)), starts)
        first, second = np.minimum(one, two), np.maximum(one, two)
        values[:, b] = mix(h[first] * np.uint64(3) + mix(h[second] + np.uint64(b)))
    for k, i in enumerate(full):
        out[i] = values[k]
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Matches over all shingles of the best alignment of two sequences, or 0 where it can't reach the threshold.

    If it can, the alignment has at most (len(a) + len(b)) * (1 - t) / (1 + t) gaps, so no match lies further off
    the main diagonals: only matches within that band are aligned, by the longest chain that rises in both sequences.
    Labelled shingles are distinct within a text, so a band holds at most one match for each of them.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    if min(n, m) < threshold * max(n, m) - 1e-9:
        return 0.0
    width = int((n + m) * (1 - threshold) / (1 + threshold)) + 1
    order = np.argsort(a, kind="stable")
    from_, to = np.searchsorted(a, b, "left", order), np.searchsorted(a, b, "right", order)
    times = to - from_
    j = np.repeat(np.arange(m), times)
    # places of a shingle from the last to the first, so that no chain takes two of them at one place of b
    i = order[np.repeat(to, times) - 1 - (np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times))]
    inside = np.abs(i - j) <= width
    i, j = i[inside], j[inside]
    if len(i) < threshold / (1 + threshold) * (n + m) - 1e-9:
        return 0.0
    if (i[1:] > i[:-1]).all():
        common = len(i)
    else:
        ends: list[int] = []  # least last place of a chain of each length
        for x in i.tolist():
            at = bisect_left(ends, x)
            ends[at : at + 1] = [x]
        common = len(ends)
    return common / (n + m - common)


def _explode_sketches(documents: DataFrame) -> DataFrame:
    """key, doc_id, values (array of sketch values, null without words) for each row."""
    source = documents.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, "text"):
            values = [None if v is None else v.view(np.int64) for v in sketches(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(values, pa.list_(pa.int64()))], names=["key", "doc_id", "vals"])

    return source.mapInArrow(run, "key binary, doc_id bigint, vals array<bigint>")


def bucket_members(texts: DataFrame) -> DataFrame:
    """texts: key, vals -> rows (i, v, key, central) of the buckets with several texts.

    Only texts in at least SHARED of those buckets can have a partner; central counts the texts they meet there.
    """
    rows = texts.where("vals is not null").select("key", F.posexplode("vals").alias("i", "v"))
    buckets = rows.groupBy("i", "v").agg(F.count("*").alias("n")).where("n > 1")
    members = rows.join(buckets, ["i", "v"])
    central = members.groupBy("key").agg(F.sum("n").alias("central"), F.count("*").alias("shared")).where(F.col("shared") >= SHARED)
    return stored(members.drop("n").join(central.drop("shared"), "key"), "buckets", even=True)


def hub_pairs(members: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: each text with the text of its bucket that meets the most others."""
    hubs = members.groupBy("i", "v").agg(F.max(F.struct("central", "key")).alias("hub"))
    met = members.join(hubs, ["i", "v"]).where("key != hub.key").select(F.col("key").alias("a"), F.col("hub.key").alias("b"))
    return _ordered(met)


def class_pairs(members: DataFrame, roots: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of each bucket's texts outside its largest class with LARGEST texts of that class and OTHERS of each of HUBS others.

    Texts and classes are drawn by hashes that change with number.
    """
    rows = members.select("i", "v", "key").join(roots, "key")
    draw = lambda k: F.min(F.struct(F.xxhash64("key", "i", F.lit(number * LARGEST + k)).alias("h"), "key"))["key"]
    classes = rows.groupBy("i", "v", "root").agg(F.count("*").alias("n"), F.array_distinct(F.array(*map(draw, range(LARGEST)))).alias("keys"))
    few = F.slice("keys", 1, OTHERS)
    hub = lambda k: F.max(F.struct(F.xxhash64("root", "i", F.lit(number * HUBS + k)).alias("h"), "root", few.alias("keys")))
    largest = F.max(F.struct("n", "root", "keys")).alias("largest")
    buckets = classes.groupBy("i", "v").agg(largest, F.array(*map(hub, range(HUBS))).alias("hubs"), F.count("*").alias("classes")).where("classes > 1")
    outside = rows.join(buckets.drop("classes"), ["i", "v"]).where("root != largest.root")
    with_largest = outside.select(F.col("key").alias("a"), F.explode("largest.keys").alias("b"))
    with_others = outside.select("root", "key", F.explode("hubs").alias("hub")).where("root != hub.root").select(F.col("key").alias("a"), F.explode("hub.keys").alias("b"))
    return with_largest.unionByName(with_others)


def neighbour_pairs(values: DataFrame, roots: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of texts of different classes that stand side by side in a bucket and share SHARED sketch values.

    A bucket is ordered by further sketch values, in another sequence for each number, so neighbours share the most.
    Rows are dealt by ranges of that order: a hot bucket spreads over many tasks.
    """
    rows = values.join(roots, "key").select("key", "root", "vals", F.posexplode("vals").alias("i", "v"))
    order = ["i", "v", *(f"w{k}" for k in range(1, DEPTH + 1))]
    for k in range(1, DEPTH + 1):
        rows = rows.withColumn(f"w{k}", F.expr(f"element_at(vals, pmod(i + {(2 * number + 1) * k}, {BANDS}) + 1)"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "key").select("key", "root", "vals", "i", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks().to_batches()[0]
            last = batch.slice(batch.num_rows - 1)
            at = {c: both.column(c).to_numpy(zero_copy_only=False) for c in ("i", "v", "root")}
            sketch = both.column("vals").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
            near = (at["i"][1:] == at["i"][:-1]) & (at["v"][1:] == at["v"][:-1]) & (at["root"][1:] != at["root"][:-1])
            near &= (sketch[1:] == sketch[:-1]).sum(1) >= SHARED
            first = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays([both.column("key").take(pa.array(first)), both.column("key").take(pa.array(first + 1))], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely_pairs(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs that share at least SHARED sketch values. values: key, vals."""
    both = pairs.join(values.toDF("a", "x"), "a").join(values.toDF("b", "y"), "b")
    return both.where(F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda same: same)) >= SHARED).select("a", "b")


def _sequences_of(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, seq (labelled shingle hashes in text order), sig (a bitmap of SIGNATURE words of 64 bits) of the nodes, one row each."""
    rows = documents.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    picked = rows.join(F.broadcast(nodes) if few else nodes, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in parts(batches, "text"):
            h, counts = _shingle_hashes(some)
            bits = np.zeros((len(some), 64 * SIGNATURE), bool)
            bits[np.repeat(np.arange(len(some)), counts), (h >> np.uint64(32)) % np.uint64(64 * SIGNATURE)] = True
            words = np.packbits(bits, axis=1).view(np.int64)
            ends = np.cumsum(counts)
            seq = [h[e - n : e].tobytes() for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(seq, pa.binary()), pa.array(list(words), pa.list_(pa.int64()))], names=["key", "seq", "sig"])

    return picked.mapInArrow(run, "key binary, seq binary, sig array<bigint>")


def _sequences(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
    """Slices of the batches with the sequences in the named columns, without a copy of them: of SLICE_BYTES at most, one row at least."""
    for batch in batches:
        ends = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            some = batch.slice(at, end - at)
            at = end
            yield some, [[np.frombuffer(x.as_buffer(), np.uint64) for x in some.column(c)] for c in names]


def verified_pairs(pairs: DataFrame, sequences: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sequences are similar enough by banded alignment. sequences: key, seq."""
    seqs = sequences.select("key", "seq")
    both = pairs.join(seqs.toDF("b", "seq_b"), "b").join(seqs.toDF("a", "seq_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, (left, right) in _sequences(batches, ["seq_a", "seq_b"]):
            good = [aligned_similarity(x, y, threshold) >= threshold - 1e-12 for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "seq_a", "seq_b").mapInArrow(run, "a binary, b binary")


def shingle_ranks(sequences: DataFrame) -> np.ndarray:
    """Rarity of each of SLOTS slots of shingles: eighths of the binary logarithm of how often its shingles occur. sequences: key, seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (some,) in _sequences(batches, ["seq"]):
            slots, n = np.unique((np.concatenate(some) & np.uint64(SLOTS - 1)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n.astype(np.int64))], names=["slot", "n"])

    often = sequences.select("seq").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    found = often.select("slot", F.least(F.round(F.log2("n") * 8), F.lit(255)).cast("int").alias("rank")).toArrow()
    ranks = np.zeros(SLOTS, np.uint8)
    ranks[found.column("slot").to_numpy()] = found.column("rank").to_numpy()
    return ranks


def rare_shingles(sequences: DataFrame) -> DataFrame:
    """token, key, place (from 1), size for the rarest shingles of each text, those that several texts have. sequences: key, seq.

    All texts order shingles alike, by rarity and hash. Of size shingles a partner has THRESHOLD of them at least, so the first
    that both have is among as many as may be missing and one more.
    """
    shared = sequences.sparkSession.sparkContext.broadcast(shingle_ranks(sequences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch, (some,) in _sequences(batches, ["seq"]):
            h, counts = np.concatenate(some), np.fromiter(map(len, some), np.int64, len(some))
            doc = np.repeat(np.arange(len(some)), counts)
            order = np.lexsort((h, ranks[h & np.uint64(SLOTS - 1)], doc))
            place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            first = place <= (counts - np.ceil(THRESHOLD * counts - 1e-9) + 1)[doc]
            size = counts[doc][first].astype(np.int32)
            tokens = h[order][first].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), batch.column("key").take(pa.array(doc[first])), pa.array(place[first].astype(np.int32)), pa.array(size)], names=["token", "key", "place", "size"])

    rows = stored(sequences.select("key", "seq").mapInArrow(run, "token bigint, key binary, place int, size int"), "shingles", even=True)
    several = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    out = stored(rows.join(several, "token"), "rare-shingles")
    discard(rows)
    return out


def apart_shingles(rare: DataFrame, roots: DataFrame) -> DataFrame:
    """token, n (its texts), apart (pairs of them in different classes) of the rare shingles that several classes have."""
    each = rare.join(roots, "key").groupBy("token", "root").agg(F.count("*").alias("n"))
    both = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count("*").alias("classes"))
    return both.where("classes > 1").select("token", "n", ((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2).alias("apart"))


def settling_pairs(rare: DataFrame, roots: DataFrame, apart: DataFrame, sequences: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: every pair of texts in different classes that may be similar enough. sequences: key, sig.

    The first shingle that two texts share leaves at most the later ones to be shared, which must be enough; and each bit that
    one bitmap has and the other hasn't stands for a shingle that isn't shared, at least. Both bounds lose no pair. A shingle of many
    texts is dealt to tasks by salts.
    """
    rows = rare.join(apart.select("token", F.ceil(F.col("n") / SALTED).cast("int").alias("salts")), "token").join(roots, "key").join(sequences.select("key", "sig"), "key")
    text = F.struct("key", "root", "place", "size", "sig")
    left = rows.select("token", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), text.alias("x"))
    right = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), text.alias("y"))
    least = (F.col("x.size") + F.col("y.size")) * (THRESHOLD / (1 + THRESHOLD)) - 1e-6
    most = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    near = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * THRESHOLD - 1e-6
    own = lambda x, y: F.col(f"{x}.size") - sum(F.bit_count(F.get(f"{x}.sig", k).bitwiseAND(F.bitwise_not(F.get(f"{y}.sig", k)))) for k in range(SIGNATURE))
    same = (left["token"] == right["token"]) & (left["salt"] == right["salt"])
    met = left.join(right, same & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near & (most >= least) & (own("x", "y") >= least) & (own("y", "x") >= least))
    return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """key, root (least key of the component) for every key in pairs; large-star and small-star until every component is a star."""
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links", even=True)
    while True:
        # large star: neighbours above a node go to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its lower neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), "m").where("u != m").select("u", F.col("m").alias("v"))
        before, edges = edges, stored(small.distinct(), "links", even=True)
        discard(before)
        ends = edges.select(F.col("u").alias("key"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("key"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        open_ = ends.groupBy("key").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1")
        if not open_.limit(1).count():
            break
    roots = edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


def linked_texts(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """key, root of all texts that may have a near-duplicate. texts: key, vals."""
    members = bucket_members(texts)
    keys = members.select("key").distinct()
    values = stored(texts.join(keys, "key", "left_semi"), "sketches", even=True)
    keys = values.select("key")
    whole = stored(_sequences_of(documents, keys), "sequences", even=True)
    tested = stored(hub_pairs(members), "pairs", even=True)
    done = [tested]
    roots = components(verified_pairs(likely_pairs(tested, values), whole))
    roots = stored(keys.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root")), "roots", even=True)
    rare, texts_apart = rare_shingles(whole), keys.count()
    number, before = 1, float("inf")
    while True:
        apart = stored(apart_shingles(rare, roots), "apart", even=True)
        left = apart.agg(F.sum("apart")).first()[0] or 0
        last = left <= EASY * texts_apart or left > 0.9 * before
        both = settling_pairs(rare, roots, apart, whole) if last else _ordered(class_pairs(members, roots, number).unionByName(neighbour_pairs(values, roots, number)))
        fresh = stored(both.join(tested, ["a", "b"], "left_anti"), "pairs", even=True)
        tested = tested.unionByName(fresh)
        likely = fresh if last else likely_pairs(fresh, values)
        found = verified_pairs(likely, whole).join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b")
        found = stored(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links", even=True)
        if found.limit(1).count():
            moved = components(found).toDF("root", "moved")
            roots = stored(roots.join(moved, "root", "left").select("key", F.coalesce("moved", "root").alias("root")), "roots")
        discard(apart)
        if last:
            discard(members, values, whole, rare, *done, fresh)
            return roots
        done.append(fresh)
        number, before = number + 1, left


def near_classes(documents: DataFrame) -> DataFrame:
    """key, root, first_id (least id of the text's rows), n_rows, class_id (least id of the class) for each distinct text."""
    each = _explode_sketches(documents).groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"), F.first("vals").alias("vals"))
    texts = stored(each, "texts", even=True)
    roots = linked_texts(documents, texts.select("key", "vals"))
    linked = stored(texts.select("key", "first_id", "n_rows").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "classes", even=True)
    least = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return linked.join(least, "root").select("key", "root", "first_id", "n_rows", "class_id")


def dedup_documents(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of its near-duplicates), kept (one row of each class, as ``keep_one`` chooses) for each row.

    Rows that repeat an id and a text can't be told apart, so they are counted before the join and dealt out again after it.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key")).groupBy("key", "doc_id").agg(F.count("*").cast("int").alias("times"))
    classes = near_classes(documents)
    chosen = chosen_texts(classes).select(F.col("key").alias("chosen_key"), F.col("id").alias("chosen_id"))
    picked = classes.select("key", "class_id").join(chosen, F.col("key") == F.col("chosen_key"), "left")
    one = F.col("chosen_key").isNotNull() & F.col("doc_id").eqNullSafe(F.col("chosen_id"))
    each = rows.join(picked, "key").select("doc_id", "class_id", one.alias("one"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("number"))
    return each.select("doc_id", "class_id", (F.col("one") & (F.col("number") == 1)).alias("kept"))


def chosen_texts(classes: DataFrame) -> DataFrame:
    """key, id of the row that each class keeps: that of the class's least id, else (no row of it has one) of its root text."""
    chosen = classes.where(F.col("first_id") == F.col("class_id")).unionByName(classes.where(F.col("class_id").isNull() & (F.col("key") == F.col("root"))))
    return chosen.groupBy("root").agg(F.min("key").alias("key"), F.first("class_id").alias("id")).select("key", "id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each class, that with the least id, with all columns of documents."""
    names = documents.columns
    chosen = chosen_texts(near_classes(documents))
    rows = documents.toDF(*[f"c{i}" for i in range(len(names))])
    text, doc_id = F.col(f"c{names.index('text')}"), F.col(f"c{names.index('doc_id')}")
    few = chosen.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    found = rows.withColumn("key", text_key(text)).withColumn("id", doc_id.cast("bigint"))
    chosen = F.broadcast(chosen) if few else chosen
    same = (found["key"] == chosen["key"]) & found["id"].eqNullSafe(chosen["id"])
    kept = found.join(chosen, same, "left_semi")
    once = kept.groupBy("key", "id").agg(F.count("*").alias("n")).where("n > 1")
    if not once.limit(1).count():
        return kept.drop("key", "id").toDF(*names)
    # rows that repeat an id and a text: one of them
    again = kept.join(once, (kept["key"] == once["key"]) & kept["id"].eqNullSafe(once["id"]), "left_semi").dropDuplicates(["key", "id"])
    single = kept.join(once, (kept["key"] == once["key"]) & kept["id"].eqNullSafe(once["id"]), "left_anti")
    return single.unionByName(again).drop("key", "id").toDF(*names)
