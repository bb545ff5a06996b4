"""Decontamination, near-duplicates, toxicity and the pipeline: against brute force, planted cases and odd inputs."""

import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cytoframe.llm import decontam, neardup, queries, toxicity

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "se") for b in ("ra", "ten", "vi", "do") for c in ("", "s", "n", "ly", "mo")]
CLASH = ", key string, size int, m string, c0 int, vals int, i int, v int, root int, row int, a int, b int"
CLASH_ROW = ("k", 1, "m", 2, 3, 4, 5, 6, 7, 8, 9)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


# --- near-duplicates ---


def brute_classes(rows):
    ids = defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    texts = list(ids)
    h, c = neardup._shingle_hashes(texts)
    ends = np.cumsum(c)
    seq = [h[e - n : e] for e, n in zip(ends, c)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            common = sum((Counter(seq[a].tolist()) & Counter(seq[b].tolist())).values())
            if common >= 0.8 / 1.8 * (len(seq[a]) + len(seq[b])) - 1e-9 and len(seq[a]) and plain_similarity(seq[a], seq[b]) >= 0.8 - 1e-12:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, t in enumerate(texts):
        least[find(k)] = min([least.get(find(k), 10**9), *(i for i in ids[t] if i is not None)])
    return {i: least[find(k)] for k, t in enumerate(texts) for i in ids[t]}


def plain_similarity(a, b):
    """Longest common subsequence by the full table."""
    table = np.zeros(len(b) + 1, int)
    for x in a.tolist():
        before = 0
        for j, y in enumerate(b.tolist(), 1):
            before, table[j] = table[j], before + 1 if x == y else max(table[j], table[j - 1])
    return table[-1] / (len(a) + len(b) - table[-1])


@pytest.fixture(scope="module")
def near_rows():
    rng = np.random.default_rng(11)
    rows = [(i, prose(rng, 60)) for i in range(60)]
    passage = prose(rng, 60)
    rows += [(100 + i, f"{passage} {prose(rng, 60)}") for i in range(30)]
    base = prose(rng, 120).split(" ")
    for i in range(60):  # copies of one text with a few words changed
        copy = list(base)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            copy[at] = rng.choice(WORDS)
        rows.append((200 + i, " ".join(copy)))
    chain = prose(rng, 150).split(" ")
    for i in range(12):  # each near the one before, ends far apart
        chain[12 * i : 12 * i + 3] = rng.choice(WORDS, 3)
        rows.append((300 + i, " ".join(chain)))
    rows += [(400, None), (401, ""), (402, "one two"), (403, "one two"), (404, "one two three"), (0, rows[0][1]), (None, rows[1][1]), (500, "word " * 5_000), (501, "word " * 5_000), (502, "word " * 4_990)]
    return rows


def test_classes_match_brute_force(spark, near_rows):
    docs = spark.createDataFrame([(*r, *CLASH_ROW) for r in near_rows], "doc_id bigint, text string" + CLASH)
    short = [r for r in near_rows if r[0] is None or r[0] < 500]
    want = brute_classes(short)
    rows = neardup.dedup_documents(docs).collect()
    assert len(rows) == len(near_rows)
    got = {r.doc_id: r.class_id for r in rows}
    assert {k: got[k] for k in want} == want
    assert got[500] == got[501] == got[502] == 500 and got[400] == got[401] == 400
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == set(got.values())


def test_classes_do_not_hang_on_hubs_and_draws(spark, near_rows, monkeypatch):
    rows = [r for r in near_rows if r[0] is None or r[0] < 500]
    want = brute_classes(rows)
    nothing = lambda at: lambda *tables: tables[at].select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    for name in ("hub_pairs", "class_pairs", "neighbour_pairs"):
        monkeypatch.setattr(neardup, name, nothing(0))
    monkeypatch.setattr(neardup, "SALTED", 7)
    got = {r.doc_id: r.class_id for r in neardup.dedup_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.dedup_documents(docs).count() == 0 and neardup.keep_one(docs).count() == 0
    alone = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c d")], "doc_id bigint, text string")
    assert neardup.dedup_documents(alone).count() == 3 and neardup.keep_one(alone).count() == 2
    # rows that repeat an id and a text, or have no id: one of them is kept
    again = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b"), (None, "c d"), (None, "c d")], "doc_id bigint, text string")
    rows = neardup.dedup_documents(again).collect()
    assert sorted((r.class_id or 0, r.kept) for r in rows) == [(0, False), (0, True), (1, False), (1, False), (1, True)]


def test_alignment_of_long_texts_is_quick():
    rng = np.random.default_rng(6)
    a = rng.permutation(200_000).astype(np.uint64)
    b = a.copy()
    b[1_000:150_000:10] += np.uint64(1 << 40)
    b[170_000:180_000] = b[170_000:180_000][::-1]
    began = time.process_time()
    assert neardup.aligned_similarity(a, b) == pytest.approx((200_000 - 14_900 - 9_999) / (200_000 + 14_900 + 9_999))
    assert time.process_time() - began < 5


def test_even_tables_are_few_files(spark, monkeypatch):
    import glob

    from cytoframe.llm import common

    conf = {"spark.sql.shuffle.partitions": str(40 * spark.sparkContext.defaultParallelism), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    kept = []
    monkeypatch.setattr(neardup, "stored", lambda *a, **k: kept.append(common.stored(*a, **k)) or kept[-1])
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        pairs = spark.range(2_000).selectExpr("cast(cast(id as string) as binary) as a", "cast(cast(id - id % 5 as string) as binary) as b")
        roots = neardup.components(pairs.where("a != b"))
        assert roots.count() == 2_000 and roots.select("root").distinct().count() == 400
        files = [len(glob.glob(kept[-1]._stored_path.removeprefix("file://").removeprefix("file:") + "/*.parquet"))]
        assert 0 < max(files) <= 5 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_banded_alignment_is_the_full_one():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 3)) % max(1, len(a)))
        full, banded = plain_similarity(a, b) if len(b) else 0.0, neardup.aligned_similarity(a, b)
        assert banded == pytest.approx(full) if full >= 0.8 else banded < 0.8


# --- decontamination ---


@pytest.fixture(scope="module")
def items():
    rng = np.random.default_rng(8)
    return [(i, prose(rng, 40)) for i in range(10)] + [(50, "tiny"), (51, None), (52, "!!"), (53, "Short item text")]


def test_planted_passages_are_found(spark, items):
    rng = np.random.default_rng(9)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, row int")
    rows, want = [(i, prose(rng, 80)) for i in range(50)], set()
    for i, (item, text) in enumerate(items[:10]):
        rows.append((100 + i, f"{prose(rng, 30)} {text.upper().replace(' ', '  -- ')} {prose(rng, 30)}"))
        edited = text[:60] + "x" + text[61:100] + text[101:]
        rows.append((200 + i, f"{prose(rng, 30)} {edited} {prose(rng, 10)}"))
        rows.append((300 + i, f"{prose(rng, 3_000)} {text[5:195]} {prose(rng, 3)}"))
        want |= {(100 + i, item), (200 + i, item), (300 + i, item)}
    rows += [(400, "a Tiny, thing"), (401, "tinyest"), (402, "so: short ITEM-text."), (403, None), (404, ""), (100, rows[50][1]), (None, items[3][1])]
    want |= {(400, 50), (402, 53), (None, 3)}
    docs = spark.createDataFrame([(*r, *CLASH_ROW) for r in rows], "doc_id bigint, text string" + CLASH)
    found = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert sum(r.doc_id == 100 for r in found) == 2
    texts = dict(rows)
    for r in found:
        if r.doc_id is not None and 100 <= r.doc_id < 110:
            inner = decontam.normal(texts[r.doc_id][r.start : r.end])
            assert inner == decontam.normal(dict(items)[r.item_id]) and r.edits == 0
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect())) == sorted(i for i, _ in rows if i is not None and (i, True) not in {(d, True) for d, _ in want})


def test_decontamination_of_nothing(spark, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.drop_contaminated(docs, bench.limit(0)).count() == 1
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_lemma_keeps_every_match_within_the_edits():
    rng = np.random.default_rng(12)
    text = decontam.normal(prose(rng, 60))[:120]
    index = decontam.Index([(1, text)])
    errors = index.pieces[0].errors
    for _ in range(100):
        c = list(text)
        for at in rng.choice(len(c), errors, replace=False):
            c[at] = rng.choice(list("abcxyz"))
        hidden = prose(rng, 40) + " " + "".join(c) + " " + prose(rng, 40)
        assert decontam.find_matches(index, [hidden]), errors


def test_items_without_an_id(spark, items):
    rng = np.random.default_rng(12)
    text = prose(rng, 60)
    bench = spark.createDataFrame([*items, (None, text), (None, prose(rng, 50))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"{prose(rng, 20)} {text} {prose(rng, 9)}"), (2, prose(rng, 40)), (3, f"x {items[0][1]}"), (4, "say tiny thing")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, None), (3, 0), (4, 50)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [2]


def test_short_items_do_not_loosen_long_ones():
    rng = np.random.default_rng(13)
    index = decontam.Index([(1, "abcdefghijkl"), (2, prose(rng, 60)), (3, prose(rng, 200))])
    assert len(index.groups) > 1 and max(g.least for g in index.groups) > 10
    # a quote of 172 characters is found wherever it begins
    long = decontam.normal(prose(rng, 200))
    index = decontam.Index([(7, long)])
    for at in range(0, len(long) - 172, 13):
        assert 0 in decontam.find_matches(index, [f"before it all {long[at : at + 172]} and after it"]), at


# --- toxicity ---


def test_toxic_words_are_learned_and_located(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(300):
        words = list(rng.choice(WORDS, 40))
        toxic = i % 4 == 0
        if toxic:
            words[10:12] = [str(rng.choice(["grumbleworm", "snarlfang"])), "grumbleworms"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    train = marks.where(toxicity.fold(marks.doc_id) != 0)
    chain = toxicity.fit_toxicity(docs, train)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, chain).collect()}
    assert all((got[i].score >= 0.5) == bool(t) for i, t in labels)
    s = got[0].spans[0]
    assert any(w in rows[0][1][s.start : s.end] for w in ("grumbleworm", "snarlfang"))
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "İİ grumbleworms", 3), (3, "İİ grumbleworms", 3), (4, "word " * 20_000, 4)], "doc_id bigint, text string, score int")
    out = sorted(((r.doc_id or 0, round(r.score, 3), len(r.spans)) for r in toxicity.score_texts(odd, chain).collect()))
    assert out[0] == (0, 0.0, 0) and out[1] == (1, 0.0, 0) and out[2] == out[3] and out[2][2] == 1 and out[4][2] == 0
    nothing = toxicity.fit_toxicity(docs, train.limit(0))
    assert toxicity.score_texts(odd, nothing).agg({"score": "max"}).first()[0] < 0.5
    assert toxicity.score_texts(docs.limit(0), chain).count() == 0


def test_marginals_match_enumeration():
    from itertools import product

    odds, moves = np.array([0.3, 2.0, 0.7, 5.0]), (0.1, -1.0, -0.5, 0.9)
    weight = defaultdict(float)
    for s in product((0, 1), repeat=4):
        w = np.prod([o**x for o, x in zip(odds, s)]) * np.exp(sum(moves[2 * a + b] for a, b in zip(s, s[1:])))
        for k, x in enumerate(s):
            weight[k, x] += w
    want = [weight[k, 1] / (weight[k, 0] + weight[k, 1]) for k in range(4)]
    assert toxicity.marginals(odds, np.array([4]), moves) == pytest.approx(want)


def area(score, toxic):
    """Area under the curve of hits by false alarms."""
    rank = score.rank()
    n1 = (toxic == 1).sum()
    return (rank[toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(toxic) - n1))


def test_held_out_accuracy(spark):
    """The chain does better on held-out rows than a list of words seen nearly only in toxic training rows."""
    base = "/root/testdata/sf0.1"
    rows = queries.op6_toxicity(spark, base).where("held_out").select("doc_id", "score")
    labels = spark.read.parquet(f"{base}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    both = rows.join(labels, "doc_id").join(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), "doc_id").toPandas()
    words, toxic = toxicity.training_documents(spark.read.parquet(f"{base}/documents.parquet"), labels.where(toxicity.fold(F.col("doc_id")) != 0))
    seen = Counter(w for d in words for w in set(d))
    bad = Counter(w for d, y in zip(words, toxic) if y for w in set(d))
    listed = {w for w, n in bad.items() if n >= 5 and n >= 0.9 * seen[w]}
    by_list = both.text.map(lambda t: float(any(w in listed for w in toxicity.tokens_of(t or ""))))
    chain, plain = area(both.score, both.toxic), area(by_list, both.toxic)
    assert chain > 0.95 and chain > plain, (chain, plain)


def test_labels_of_documents_are_enough():
    """Without a label of any token, the chain finds which tokens make documents toxic, and how they follow each other."""
    rng = np.random.default_rng(2)
    docs, toxic = [], []
    for i in range(400):
        words = list(rng.choice(WORDS, 60))
        if i % 3 == 0:
            words[20:24] = rng.permutation(["gnarl", "vex", "snide", "crude"])
        docs.append(words)
        toxic.append(int(i % 3 == 0))
    chain = toxicity.fit_chain(docs, toxic)
    odds = {w: chain.emission(w) for w in (*WORDS, "gnarl", "vex", "snide", "crude")}
    assert max(odds[w] for w in WORDS) < 0.2 and min(odds[w] for w in ("gnarl", "vex", "snide", "crude")) > max(odds[w] for w in WORDS)
    held = list(rng.choice(WORDS, 40))
    held[5:7] = ["vex", "gnarl"]
    p = toxicity.marginals(np.array([odds[w] for w in held]), np.array([40]), chain.moves)
    assert set(np.flatnonzero(p >= 0.5)) <= {5, 6} and p.max() >= 0.5
    logs, _, _ = toxicity.clean_logs(np.array([0.3, 2.0, 0.7]), np.array([3]), (0.1, -1.0, -0.5, 0.9))
    from itertools import product

    every = {s: np.prod([o**x for o, x in zip([0.3, 2.0, 0.7], s)]) * np.exp(sum((0.1, -1.0, -0.5, 0.9)[2 * a + b] for a, b in zip(s, s[1:]))) for s in product((0, 1), repeat=3)}
    assert logs[0] == pytest.approx(np.log(every[0, 0, 0] / sum(every.values())))


# --- pipeline ---


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "personal data", "tokens"]
    kept = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, data)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
        seen.append(kept.count())
    assert docs.count() > seen[0] >= seen[1] >= seen[2] == seen[3]
    quality_kept = {r.doc_id for r in queries.op4_quality_rules(spark, data).where("kept").collect()}
    assert seen[0] == len(quality_kept)
    rows = corpus_pipeline.run(spark, data)
    assert rows.count() == seen[3] and {r.doc_id for r in rows.select("doc_id").collect()} <= quality_kept
