"""Personal data: fixed patterns against plain regular expressions, disclosing terms on a small corpus."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytoframe.llm import pii

# --- fixed values: the plain patterns ---
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# --- end of fixed values ---


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def right(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def plain(text):
    out = [(m.start(), r, m.end(), k) for r, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if right(k, m[0])]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


CASES = [
    "a@b.c_d@e.f x@y@z.w .@-.- %+@a.b.", "1.2.3.4.5.6.7.8 300.1.2.3.4 0001.002.3.255 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111111111111111" * 2, "+1 (499) 555-6503% +12 345 ++1234567890 +1234567890123456 +1.2.3.4.5.6.7.8.9.0", "𝒳é +491234567890é a@b.co", None, "", "5 5 5 5 5 5 5 5 5 5 5 5 5 5 5", "12- 34 4111 1111 1111 1111 -5",
    "+1 4111 1111 1111 1111", "+" + "1" * 5000, "1" * 20000, "a" * 30000 + "@", "1.1.1.1" * 500, ("x%s@y.z " % "q") * 2000, "+1" + " " * 5000 + "234567890",
]


def test_same_spans_as_the_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(5, CASES[5]), (None, CASES[0])], "doc_id bigint, text string")
    rows = pii.span_digests(pii.private_spans(docs)).collect()
    assert len(rows) == len(CASES) + 2
    for r in rows:
        want = plain(CASES[r.doc_id if r.doc_id is not None else 0])
        assert r.base_sha256 == digest(want), (r.doc_id, r.spans[:200], want[:5])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in want) for k in PLAIN]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("1234567890+-. ()@ab_%𝒳", max_size=60), min_size=100, max_size=100))
def test_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.span_digests(pii.private_spans(docs)).collect():
        assert r.base_sha256 == digest(plain(texts[r.doc_id])), texts[r.doc_id]


@pytest.fixture(scope="module")
def corpus():
    rare = [f"Meet Zorblatt near pier {i} or write to boss@corp.example about cargo {chr(97 + i % 26)}{chr(97 + i // 26)}x today" for i in range(12)]
    plain_ = [f"The harbour lies about a mile from town number {i} today near pier and cargo" for i in range(200)]
    return [*rare, *plain_, "ZORBLATT was seen, zorblatter not"]


def test_disclosing_terms(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
    terms = {r.term: r.disclosed for r in pii.disclosing_terms(docs, pii.base_spans(docs)).collect()}
    # brute force over the same windows: 12 documents of 213 hold the entity, 13 the name
    import math

    share = math.log2(213 * 12 / (12 * 13)) / math.log2(213 / 12)
    assert terms["zorblatt"] == pytest.approx(share, abs=1e-6) and "near" not in terms and "about" not in terms
    assert terms["write"] == 1.0
    spans = {r.doc_id: r.spans for r in pii.span_digests(pii.private_spans(docs)).collect()}
    assert spans[212] == "removed:0:8" and spans[100] == ""
    assert "email:" in spans[0] and ":5:13" in spans[0]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "Zorblatt" not in clean[0] and clean[212] == " was seen, zorblatter not"
    assert clean[50] == corpus[50]


def test_copies_give_nothing_away(spark):
    docs = spark.createDataFrame([(i, "Zorblatt writes to boss@corp.example") for i in range(40)] + [(100 + i, f"other text {i}") for i in range(60)], "doc_id bigint, text string")
    assert pii.disclosing_terms(docs, pii.base_spans(docs)).count() == 0


def test_sanitise_keeps_columns(spark):
    rows = [(1, "x@y.zz and +12345678901, 4111111111111111 at 1.2.3.4 not 1.2.3.400", 5, "k", 1), (None, None, None, None, 2), (3, "", 0, "", 3), (1, "x@y.zz and +12345678901, 4111111111111111 at 1.2.3.4 not 1.2.3.400", 5, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, key string, c0 int")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = sorted(out.collect(), key=str)
    text = "[EMAIL] and [PHONE], [CARD] at [IP] not 1.2.3.400"
    assert sorted(map(tuple, got), key=str) == sorted([(1, text, len(text), "k", 1), (None, None, None, None, 2), (3, "", 0, "", 3), (1, text, len(text), "k", 1)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, start int")
    assert pii.span_digests(pii.private_spans(docs)).count() == 0 and pii.sanitise(docs).count() == 0


def test_no_python_in_the_plan(spark, data):
    plan = pii.private_spans(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert F.count_if is not None


def test_terms_named_like_kinds_leave_placeholders(spark):
    from cytoframe.llm.pii import KINDS

    named = rf"(?!(?<=\[)(?:{'|'.join(k.upper() for k in (*KINDS, 'term'))})\])"
    pattern = named + r"(?iu)(?<![\p{L}\p{N}])(?:email|card)(?![\p{L}\p{N}])"
    df = spark.createDataFrame([("[EMAIL] email, Card [CARD] [email]",)], "t string")
    assert df.selectExpr("regexp_replace(t, '" + pattern.replace("\\", "\\\\") + "', '#') as t").first().t == "[EMAIL] #, # [CARD] [#]"
