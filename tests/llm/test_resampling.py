"""Importance resampling: features, weights and ranks against a plain version."""

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from cytoframe.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(documents, target):
    s, t = Counter(), Counter()
    found = [(i, *buckets(x)) for i, x in documents]
    for *_, b in found:
        s.update(b)
    for x in target:
        t.update(buckets(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, n, b in found:
        weight = sum(map(gain, b))
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    out = []
    for k, r in enumerate(able):
        out.append((*r, k + 1 if k < 5 * len(able) // 100 else None))
    return sorted([*out, *((*r, None) for r in rows if r[1] < 20)], key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=repr)


def test_whole_tables_equal_the_plain_version(spark, data):
    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet").collect()
    assert got(queries.op13_resampling(spark, data)) == plain([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])


ODD = [(None, "A b c " * 30), (1, None), (2, ""), (3, "é𝒳-É x_y 12 " * 40), (3, "é𝒳-É x_y 12 " * 40), (3, "é𝒳-É x_y 12 " * 40), (4, "word " * 50_000), (5, "x" * 3_000_000 + " y"), (6, "...\n"), *((k, f"the same {k % 3} words " * 10) for k in range(10, 60))]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in ODD], "doc_id bigint, text string, rank int, score int, n_words int, bucket string")
    target = spark.createDataFrame([("A the same words",), (None,), ("",)], "text string")
    assert got(resampling.resample(docs, target)) == plain(ODD, ["A the same words", None, ""])
    assert resampling.resample(docs.where("false"), target).count() == 0
    assert got(resampling.resample(docs.where("doc_id < 20"), target.where("false"))) == plain([r for r in ODD if r[0] is not None and r[0] < 20], [])


def test_blocks_hold_every_feature_once(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "é"], rng.integers(0, 60))).encode() for _ in range(40)]
    want = [Counter(buckets(t.decode())[1]) for t in texts]
    monkeypatch.setattr(resampling, "CUT", 7)
    for size in (1, 3, 50, 10_000):
        seen, words = [Counter() for _ in texts], np.zeros(len(texts), int)
        for block in resampling.blocks(texts, size=size):
            words += np.bincount(block[1][: block[2]], minlength=len(texts))
            for bucket, at, owner in resampling.gram_runs(*block, resampling.Shifts(), 10_000):
                for b, o in zip(bucket[at], owner):
                    seen[o][int(b)] += 1
        assert seen == want and words.tolist() == [len(t.split()) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 5, 300, 100_000])
def test_checksums_of_joined_texts(n):
    a, b = b"first", bytes(range(256)) * (n // 256 + 1)
    sums = resampling.Shifts().join(np.array([crc32(a)], np.uint32), np.array([crc32(b[:n])], np.uint32), np.array([n]))
    assert sums[0] == crc32(a + b[:n])
