"""Pieces: against the library on tables, odd texts and random ones."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cytoframe.llm import pieces, queries

MODEL = queries.tokenizer_path("piece_bpe_32k.model")
CLASH = ", ids int, decoded string, k0 int, text_ string"
ODD = [(1, "same text"), (1, "same text"), (None, "same text"), (2, None), (3, ""), (4, "word " * 20_000), (5, "é𝒳 \n\n a\n\t▁▁ b"), (-9, "x" * 30_000), (6, " " * 1_000), (7, "<s> </s> <unk> <0x0A> \x00")]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.load_pieces(open(MODEL, "rb").read())


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_documents_equal_the_library(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_pieces(spark, data).collect())
    assert got == sorted((r.doc_id, *expected(library, r.text)) for r in docs.collect())


def test_odd_rows_and_clashing_names(spark, library):
    docs = spark.createDataFrame([(*r, 1, "d", 2, "t") for r in ODD], "doc_id bigint, text string" + CLASH)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.piece_digests(pieces.encode_pieces(docs, MODEL)).collect())
    assert got == sorted((str(i), *expected(library, t)) for i, t in ODD)
    assert pieces.encode_pieces(docs.where("false"), MODEL).count() == 0


SIGNS = st.sampled_from([*"ab the in▁ \n\t é漢ﷺ1234,.'\"<>s/0x0A_ñ𝒳ers", "   ", "ing", "tion", "▁▁", "­", "ᄀ"])


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.lists(SIGNS, max_size=40).map("".join), st.text(max_size=60)))
def test_random_texts(own, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode([text])[0]
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids) == library.decode(ids.tolist())


def test_neighbours_follow_as_merging_them_says(own):
    rng = np.random.default_rng(1)

    def merged(symbols):
        now = list(symbols)
        while True:
            score, at = max(((own.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(now, now[1:]))), default=(-np.inf, 0))
            if score == -np.inf:
                return now
            now[-at : 2 - at] = ["".join(now[-at : 2 - at])]

    ids = [i for p, i in own.id.items() if p.strip("▁") and p in own.automaton]
    for left, right in rng.choice(ids, (1_500, 2)):
        a, b = own.text[left], own.text[right]
        if not b.startswith("▁"):
            assert own.follows(left, right) == (merged(a + b) == [a, b])


def test_memory_of_words_is_bounded(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_WORDS", 50)
    monkeypatch.setattr(pieces, "MAX_PAIRS", 20)
    own.forget()
    for k in range(30):
        text = " ".join(f"wörd{k}x{i}" for i in range(20)) + " again"
        assert own.encode([text])[0].tolist() == library.encode(text)
        assert len(own.known) <= 72 and len(own.pairs) <= 20
    own.forget()
