"""Sharding, chat windows, quality statistics, page text, URL rules, tokens: against plain versions, round trips and odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from cytoframe.llm import bpe, chat, html, quality, queries, sharding, urls

CLASH = ", key string, size int, t string, c0 int, m string, vals int, i int, v int, root int, batch int, part int, bytes int, shard int, rule string, tokens int"
CLASH_ROW = ("k", 1, "t", 2, "m", 3, 4, 5, 6, 7, 8, 9, 10, "r", 11)
ODD = [(1, "same text here"), (1, "same text here"), (None, "same text here"), (2, None), (3, ""), (4, "word " * 20_000), (5, "é𝒳 \n\n a\n a\n#*$"), (-9, "x")]


def odd_documents(spark):
    return spark.createDataFrame([(*r, *CLASH_ROW) for r in ODD], "doc_id bigint, text string" + CLASH)


def no_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string" + CLASH)


# --- sharding ---


def test_difference_balances():
    rng = np.random.default_rng(5)
    sizes = rng.integers(10, 10_000, 400)
    sums, to = sharding.difference([np.concatenate([[s], np.zeros(7, np.int64)]) for s in sizes])
    own = np.bincount([int(t[0]) for t in to], weights=sizes, minlength=8).astype(int)
    assert sorted(own) == sorted(sums.tolist()) and own.max() - own.min() < 100


def check_shards(rows, texts, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in texts)
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by_text[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.shard_documents(docs, 4).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 4)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) < 0.01 * sum(sums.values())


def test_shards_of_odd_documents(spark):
    check_shards(sharding.shard_documents(odd_documents(spark), 3).collect(), ODD, 3)
    assert sharding.shard_documents(no_documents(spark), 3).count() == 0


# --- chat ---


def chat_truth(turns):
    all_, loss = hashlib.sha256(), hashlib.sha256()
    n = chars = 0
    for role, text in turns:
        all_.update(f"{role}\n{text or ''}\n".encode())
        n += 1
        if role == "assistant":
            loss.update((text or "").encode())
            chars += len(text or "")
    return n, all_.hexdigest(), chars, loss.hexdigest()


def test_chat_digests(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by[r.conv_id].append((r.role, r.text))
    by[-7] = [("user", queries.PROBE), ("assistant", queries.PROBE)]
    got = {r.conv_id: r for r in queries.op2_chat(spark, data).collect()}
    assert got.keys() == by.keys()
    for k, turns in by.items():
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == chat_truth(turns), k


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:#\\<\n ", max_size=8), st.text(alphabet="\\#<>/turn :\nA", max_size=40)), max_size=6))
def test_rendered_turns_read_back(turns):
    text = "".join(chat.render(r, t)[0] for r, t in turns)
    assert chat.parse_window(text) == turns
    for r, t in turns:
        shown, a, b = chat.render(r, t)
        assert chat.unescape(shown[a:b]) == t


def test_windows_keep_the_system_turn_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * 20) for i in range(1, 40)]
    rows += [(2, 0, "assistant", None), (None, None, None, None), (None, 1, "user", "x"), (3, 0, "user", "y" * 100_000), (3, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, window int")
    out = chat.format_windows(df, budget=120, history=40).collect()
    mine = sorted((w for w in out if w.conv_id == 1), key=lambda w: w.window)
    assert len(mine) > 3 and sum(w.n_turns for w in mine) == 40
    for w in mine[1:]:
        turns = chat.parse_window(w.text)
        assert turns[0] == ("system", "be kind") and w.n_context >= 2 and len(turns) == w.n_turns + w.n_context
    labelled = [chat.unescape(w.text[a:b]) for w in mine for a, b in zip(w.loss_starts, w.loss_ends)]
    assert labelled == [t for _, _, r, t in rows[1:40] if r == "assistant"]
    digests = {r.conv_id: r for r in chat.window_digests(chat.format_windows(df, budget=120, history=40)).collect()}
    assert digests[2].loss_chars == 0 and digests[None].n_turns == 2 and digests[3].n_turns == 2
    assert chat.window_digests(chat.format_windows(df.limit(0))).count() == 0


# --- quality ---


def quality_truth(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            marked |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_quality_statistics(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality_stats(docs, []).collect():
        want = quality_truth(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=60), min_size=1, max_size=6))
def test_quality_statistics_of_random_texts(texts):
    got = quality.text_stats(texts)
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in quality.STATS) == quality_truth(t)


def test_decision_list_learns_and_filters(spark):
    rng = np.random.default_rng(2)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "theta", "omega"], 40))) for i in range(150)]
    bad = [(1000 + i, " ".join(f"{w}###" for w in rng.choice(["alpha", "beta", "gamma", "delta", "kappa"], 40))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, None) for i, _ in good] + [(i, 0, None) for i, _ in bad] + [(None, 0, 0), (7, None, 1)], "doc_id bigint, quality int, toxic int")
    rules = quality.fit_quality(docs, labels)
    assert rules and rules == quality.fit_quality(docs, labels)
    kept = {r.doc_id for r in quality.quality_stats(docs, rules).where("kept").collect()}
    repeated = {r.doc_id for r in quality.quality_stats(docs, []).where("base_failed").collect()}
    assert not kept & {i for i, _ in bad} and len(kept) >= len({i for i, _ in good} - repeated) - 3
    odd = quality.filter_quality(odd_documents(spark), rules)
    assert odd.columns == odd_documents(spark).columns and odd.count() == 0
    assert quality.fit_quality(docs, labels.limit(0)) == [] and quality.quality_stats(no_documents(spark), rules).count() == 0


def test_columns_of_any_name(spark):
    rows = [(1, "word " * 3, "a", 1, 2, True), (2, " ".join(f"w{i}" for i in range(40)), "b", 3, 4, False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `__quality_stats` string, c0 int, n_words int, kept boolean")
    out = quality.filter_quality(docs, [])
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [rows[1]]
    assert {r.doc_id: r.kept for r in quality.quality_stats(docs, []).collect()} == {1: False, 2: True}


# --- pages ---


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple words of a page that says something.", "plain & simple words of a page that says something."),
        ("<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>One  two\n three, and so on for a while.</p><script>var x</script><p>Last &lt;line&gt; here.</p></article><footer>&copy; us</footer>", "Title One two three, and so on for a while. Last <line> here."),
        ("<article><p>Kept words stand here.</p><div class='comments'><p>I like this article very much indeed.</p></div></article>", "Kept words stand here."),
        ("<article><p>Begins well enough.<!-- never closed <p>hidden", "Begins well enough."),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page or "", html.default_tree()) == want


def _unnamed(rng, i):
    """A page whose parts stand in like containers; which of its blocks are main text."""
    words = lambda n: " ".join(rng.choice(["river", "stone", "lamp", "harbour", "winter", "bread", "letter", "garden"], n)).capitalize() + "."
    link = lambda n: f'<a href="/{rng.integers(99)}">{words(n)}</a>'
    menu = [(f"<div>{link(2)}</div>", 0) for _ in range(4)]
    article = [(f"<div>{words(int(rng.integers(14, 60)))}</div>", 1) for _ in range(int(rng.integers(2, 6)))]
    tail = [(f"<div>{link(6)}</div>", 0) for _ in range(3)] + [(f"<div>{link(1)} {link(1)}</div>", 0)]
    parts = menu * (i % 4 > 0) + article + tail * (i % 3 > 0)
    return "<body>" + "".join(p for p, _ in parts) + "</body>", [k for _, k in parts]


def test_words_and_links_decide():
    rng = np.random.default_rng(3)
    tree = html.default_tree()
    assert html.FEATURES[tree.feature] in ("links", "words")
    xs, ys = [], []
    for i in range(60):
        page, keep = _unnamed(rng, i)
        blocks = html.page_blocks(page)
        assert len(blocks) == len(keep) and not any(b.boilerplate or b.article for b in blocks)
        xs.append(html.block_features(blocks))
        ys += keep
    x, y = np.vstack(xs), np.array(ys, bool)
    right = lambda x: ((html.predict(tree, x) >= 0.5) == y).mean()
    mixed = x.copy()
    mixed[:, :6] = rng.permutation(x[:, :6])
    assert right(x) > 0.97 and right(mixed) < 0.75


def test_deep_pages_are_quick():
    import time

    began = time.process_time()
    page = "<div>" * 20_000 + "<p>A text that stands very deep in its page and has enough words.</p>" + "</section>" * 20_000 + "<div class='ad'>Buy</div>"
    assert html.main_text(page, html.default_tree()) == "A text that stands very deep in its page and has enough words."
    assert time.process_time() - began < 5


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "<p>Some words that make a sentence.</p>", 2), (3, "u", "<p>" + "long words here. " * 20_000 + "</p>", 3), (3, "u", "", 4), (3, "u", "", 4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted(((r.page_id or 0, len(r.text)) for r in html.extract_pages(df).collect()))
    assert got == [(0, 32), (1, 0), (3, 0), (3, 0), (3, 340_000 - 1)] or got == [(0, 31), (1, 0), (3, 0), (3, 0), (3, 17 * 20_000 - 1)]
    assert html.extract_pages(df.limit(0)).count() == 0


def test_tree_splits():
    x = np.array([[0.0, 5], [1, 5], [2, 5], [3, 5]])
    tree = html.fit_tree(x, np.array([0.0, 0, 1, 1]))
    assert html.predict(tree, x).tolist() == [0, 0, 1, 1] and tree.feature == 0 and tree.threshold == 1.5
    assert html.fit_tree(x[:0], np.zeros(0)).share == 0


# --- urls ---


def test_url_rules_match_their_sql(spark, data):
    import duckdb

    duckdb.sql(f"create or replace view pages as select * from '{data}/pages.parquet'")
    want = sorted(duckdb.sql(queries.oracle_sql()["op7_urls"]).fetchall(), key=str)
    got = sorted((tuple(r) for r in queries.op7_urls(spark, data).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == want


def test_url_rules_on_odd_rows(spark):
    rows = [(1, None, 0), (2, "no scheme", 0), (3, "http://A.Example.ORG/es/x?y#z", 0), (4, "x://com/de/", 0), (5, "http://notcom.org", 0), (5, "http://notcom.org", 0), (6, "http://a.com/fr/\n1", 0), (None, "https://b.example.org/en/12", 0), (7, "http://" + "a." * 5000 + "com/de/q", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, rule int")
    got = {(r.page_id, r.host[:20], r.path[:8], r.rule, r.verdict) for r in urls.judge_urls(df, urls.rule_table(spark, queries.URL_RULES)).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "/es/x", "example.org/es/", "block"), (4, "com", "/de/", "com/de/", "block"),
        (5, "notcom.org", "", None, "allow"), (6, "a.com", "/fr/\n1", "com/fr/", "allow"), (None, "b.example.org", "/en/12", "example.org/en/1", "block"), (7, "a." * 10, "/de/q", "com/de/", "block"),
    }
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark, queries.URL_RULES)).count() == 0


def test_only_candidate_rules_run(spark):
    rules = queries.URL_RULES
    assert len(rules) > 4_000
    addresses = [f"http://w{i}.example{i % 7}.net/en/{i}" for i in range(200)] + ["http://x.best-casino-online-3.com/", "http://spam-farm.io/a", "http://a.net/b/phishing-login-go/c", "http://notcasino.net/casinos", "http://online.site/best"]
    df = spark.createDataFrame(list(enumerate(addresses)), "page_id int, url string")
    hosts = df.select(urls.url_host(df.url).alias("host"), urls.url_path(df.url).alias("path")).distinct()
    tokens = urls.with_tokens(hosts)
    pairs = urls.candidates(tokens, urls.index_rules(urls.rule_table(spark, rules), tokens.where("token <> ''"), True), True)
    fetched = {(r.host, r.path): r.n for r in pairs.groupBy("host", "path").agg(F.count("*").alias("n")).collect()}
    assert len([k for k in fetched if k[0].startswith("w")]) == 0 and sum(fetched.values()) < len(rules) // 4
    want = {i: [r for r in rules if re.search(r.pattern, re.sub(r"^[a-z]+://", "", a))] for i, a in enumerate(addresses)}  # every rule on every URL
    got = {r.page_id: r.rule for r in urls.judge_urls(df, urls.rule_table(spark, rules)).collect()}
    assert {k: v is not None for k, v in got.items()} == {k: bool(v) for k, v in want.items()}
    assert all(v is None or v in {r.name for r in want[k]} for k, v in got.items()) and sum(v is not None for v in got.values()) == 3


# --- tokens ---


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_very_long_words(tokenizer):
    import json

    vocabulary = bpe.Vocabulary(json.load(open(queries.tokenizer_path(), encoding="utf-8")))
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefghié"), n)) for n in (1_999, 2_001, 30_000)] + ["=" * 7_000, "a" * 200_000, "lorem" * 900]
    got = [np.frombuffer(x, "<u4").tolist() for x in vocabulary.encode(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class Counted(dict):
    """A dict that counts what is looked up in it."""

    looked = 0

    def get(self, *args):
        self.looked += 1
        return super().get(*args)

    def __getitem__(self, key):
        self.looked += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.looked += 1
        return super().__contains__(key)


def test_ends_met_before_need_no_tokens_looked_up(tokenizer):
    import json

    vocabulary = bpe.Vocabulary(json.load(open(queries.tokenizer_path(), encoding="utf-8")))
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(["an", "der", "lich", "é", "tion", "th"], n)) for n in rng.integers(2, 6, 400)}
    first = vocabulary.learn(words)
    vocabulary.tokens = Counted(vocabulary.tokens)
    assert vocabulary.learn(words) == first
    assert vocabulary.tokens.looked == 0
    assert {w: np.frombuffer(x, "<u4").tolist() for w, x in first.items()} == {w: tokenizer.encode(w, add_special_tokens=False).ids for w in words}


def test_tokens_with_little_remembered(tokenizer, monkeypatch):
    import json

    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    monkeypatch.setattr(bpe, "MAX_STEPS", 7)
    monkeypatch.setattr(bpe, "MAX_WORDS", 3)
    vocabulary = bpe.Vocabulary(json.load(open(queries.tokenizer_path(), encoding="utf-8")))
    texts = ["the quick brown fox, it's überraschend 12", "schachsten dieereinlichie the quick", "a<|endoftext|>b", ""]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in vocabulary.encode(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(vocabulary.pairs) <= 5 and len(vocabulary.steps) <= 7


def same_tokens(rows, texts, tokenizer):
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), r.doc_id
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), r.doc_id
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest(), r.doc_id


def test_tokens_of_documents(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    same_tokens(queries.op10_bpe(spark, data).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer)


def test_tokens_of_odd_texts(spark, tokenizer):
    texts = [None, "", " ", "ΑΣ ΣΑΣ ΟΔΟΣ.", "İstanbul ŉ ǅ", "a<|endoftext|>b <|startoftext|>", "it's WE'LL don't 'S", "ｆｕｌｌ width é e\u0301", "123 45½ ² ٣", "日本語テキスト", "👩‍👩‍👧 x\u200by\u00a0z\u2028w", "aaaa" * 3000, "\x00\x1f\x85", "ﬁ ẞ ß", "word " * 5000, "<|ENDOFTEXT|>"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, token_ids string")
    rows = bpe.token_digests(bpe.encode_texts(docs, queries.tokenizer_path())).collect()
    assert len(rows) == len(texts)
    same_tokens(rows, dict(enumerate(texts)), tokenizer)
    assert bpe.encode_texts(docs.limit(0), queries.tokenizer_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_tokens_of_random_texts(tokenizer, text):
    from pathlib import Path

    vocab = bpe.load_vocabulary(Path(queries.tokenizer_path()).read_text(encoding="utf-8"))
    ids = np.frombuffer(vocab.encode([text])[0], "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
