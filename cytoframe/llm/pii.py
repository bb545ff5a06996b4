r"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Protected entities are the addresses, network addresses, card and phone numbers that fixed patterns find. Words near
an entity are counted over the whole corpus: with N documents, n(e) that hold the entity, n(t) that hold the term
and n(e, t) where the term stands near the entity, the term gives away

    PMI(t; e) / IC(e) = log(N n(e, t) / (n(e) n(t))) / log(N / n(e))

of the entity's information. Terms above DISCLOSED are generalised to ``[TERM]``, those above REVEALED are removed,
wherever they stand. A term counts only if it stands near the entity in SUPPORT different contexts at least, so copies
of one text give away nothing by themselves.

Entities are worked out once for each distinct text (by digest), as (text, kind, place) rows whose gaps are summed up
in a window; texts themselves are never shuffled unless more texts have disclosing terms than may be broadcast.

Defined results: a null text counts as empty and has no spans (``sanitise`` leaves it null); repeated rows give repeated
rows; an empty table gives an empty table; other columns are ignored by ``private_spans`` and kept by ``sanitise``
whatever their names. Added spans never overlap those of the fixed patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cytoframe.llm.common import stored, text_key

KINDS = ("email", "ip", "card", "phone")
#: Patterns with the same matches as the plain ones, but without going over a run twice; of numbers, only runs of a fitting length.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![0-9])(?![ -][0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){9,14}(?![ ().-]*+[0-9])",
}
#: What a text with a match has at least.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
WORD = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}+"
#: Code points and words on either side that are near an entity.
NEAR_CHARS = 80
NEAR_WORDS = 6
#: Different contexts that a term must share with an entity; fewer are no evidence.
SUPPORT = 5
DISCLOSED = 0.75
REVEALED = 0.95
#: One document in so many screens the candidate terms before they are counted in all documents.
SCREEN = 64
#: Terms, or texts with disclosing terms, that are broadcast (under 100 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 300_000


def _hinted(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit(HINTS[kind])) if kind == "email" else F.rlike(text, F.lit(HINTS[kind]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right last digit."""
    at = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    twice = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 0, at(i) * 2).otherwise(at(i)))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """What the patterns leave open: parts of network addresses up to 255, and the last digit of cards."""
    return F.when(kind == "ip", F.rlike(value, F.lit(rf"^(?:{BYTE}\.){{3}}{BYTE}$"))).when(kind == "card", luhn(_digits(value))).otherwise(F.lit(True))


def _items(pieces: Column, found: Column) -> Column:
    """For each match its number, the gap before it, its text and what stands around it."""
    return F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: F.struct(
            i.alias("pos"),
            F.length(F.get(pieces, i)).cast("bigint").alias("gap"),
            F.get(found, i).alias("value"),
            F.right(F.get(pieces, i), F.lit(NEAR_CHARS)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(NEAR_CHARS)).alias("after"),
            F.length(F.get(pieces, i + 1)).cast("bigint").alias("room"),
        ),
    )


def _placed(matches: DataFrame) -> DataFrame:
    """matches: key, kind, pieces, found -> key, kind, start, end, value, before, after, gap, room, copies; once for each text."""
    each = matches.where(F.size("found") > 0).select("key", "kind", F.explode(_items(F.col("pieces"), F.col("found"))).alias("m"))
    once = each.groupBy("key", "kind", "m.pos").agg(F.first("m").alias("m"), F.count("*").alias("copies"))
    end = F.sum(F.col("m.gap") + F.length("m.value")).over(W.partitionBy("key", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    ended = once.select("key", "kind", "copies", end.alias("end"), "m.*")
    return ended.withColumn("start", F.col("end") - F.length("value"))


def base_spans(documents: DataFrame) -> DataFrame:
    """key, kind, start, end, value, before, after, gap, room, copies (rows with this text): a row for each entity of each distinct text."""
    texts = documents.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("t"))
    some = texts.where(reduce(Column.__or__, (_hinted(k, F.col("t")) for k in KINDS)))
    matched = [
        F.when(
            _hinted(k, F.col("t")),
            F.struct(F.lit(k).alias("kind"), F.split("t", PATTERNS[k], -1).alias("pieces"), F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0)).alias("found")),
        )
        for k in KINDS
    ]
    rows = some.select("key", F.explode(F.array_compact(F.array(*matched))).alias("x")).select("key", "x.*")
    return _placed(rows).where(valid(F.col("kind"), F.col("value")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _near(spans: DataFrame) -> DataFrame:
    """key, copies, entity, context (a hash of the words around), term: a row for each word near an entity."""
    letters = r"[\p{L}\p{N}]+"
    # a word that the limit cuts is no word
    before = F.when(F.col("gap") > NEAR_CHARS, F.regexp_replace("before", f"^{letters}", "")).otherwise(F.col("before"))
    after = F.when(F.col("room") > NEAR_CHARS, F.regexp_replace("after", f"{letters}$", "")).otherwise(F.col("after"))
    left, right = _words(before), _words(after)
    named = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("value"))).otherwise(F.lower("value"))
    rows = spans.select("key", "copies", F.concat_ws(":", "kind", named).alias("entity"), left.alias("left"), right.alias("right"))
    words = F.concat(F.slice("left", F.greatest(F.size("left") - (NEAR_WORDS - 1), F.lit(1)), F.lit(NEAR_WORDS)), F.slice("right", F.lit(1), F.lit(NEAR_WORDS)))
    rows = rows.withColumn("words", words)
    return rows.select("key", "copies", "entity", F.xxhash64("words").alias("context"), F.explode(F.array_distinct("words")).alias("term"))


def disclosing_terms(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """term, disclosed (largest share of an entity's information that it gives away, DISCLOSED or more)."""
    near = stored(_near(spans), "near")
    n = documents.count()
    entities = near.select("entity", "key", "copies").distinct().groupBy("entity").agg(F.sum("copies").alias("n_e"))
    once = near.groupBy("entity", "term", "key").agg(F.max("copies").alias("copies"))
    # texts may share a context: contexts are counted apart from the documents
    contexts = near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= SUPPORT)
    pairs = once.groupBy("entity", "term").agg(F.sum("copies").alias("n_et")).join(contexts.select("entity", "term"), ["entity", "term"]).join(entities, "entity")
    # a term is in as many documents at least as it is near any entity
    least = near.select("term", "key", "copies").distinct().groupBy("term").agg(F.sum("copies").alias("n_least"))
    pairs = pairs.join(least, "term").where((F.col("n_e") < n) & (_share(n, F.col("n_least")) >= DISCLOSED))
    pairs = stored(pairs.select("entity", "term", "n_et", "n_e"), "near-pairs")
    if not pairs.limit(1).count():
        return pairs.select("term", F.lit(1.0).alias("disclosed"))
    # common words fall out by what a part of the documents alone shows: no count over all of them is smaller
    part = _term_counts(documents.where(F.pmod(F.xxhash64("text"), F.lit(SCREEN)) == 0), pairs)
    pairs = stored(pairs.join(part, "term", "left").where(F.coalesce(_share(n, F.col("n_t")), F.lit(1.0)) >= DISCLOSED).drop("n_t"), "screened-pairs")
    disclosed = F.round(_share(n, F.col("n_t")), 9)
    found = pairs.join(_term_counts(documents, pairs), "term").groupBy("term").agg(F.max(disclosed).alias("disclosed"))
    return stored(found.where(F.col("disclosed") >= DISCLOSED), "disclosing")


def _term_counts(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """term, n_t (documents that hold it) for the terms of pairs."""
    wanted = _small(pairs.select("term").distinct())
    words = documents.select(F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("term"))
    return words.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))


def _share(n: int, n_t: Column) -> Column:
    n_e, n_et = F.col("n_e"), F.col("n_et")
    return F.log2(F.lit(float(n)) * n_et / (n_e * n_t)) / F.log2(F.lit(float(n)) / n_e)


def texts_with(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """key, generalised, removed (patterns of the disclosing terms that the text holds, or null); stored."""
    words = documents.select(text_key(F.col("text")).alias("key"), F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("term"))
    removed = F.col("disclosed") >= REVEALED
    gathered = words.join(_small(terms), "term").groupBy("key").agg(F.array_sort(F.collect_set(F.when(~removed, F.col("term")))).alias("g"), F.array_sort(F.collect_set(F.when(removed, F.col("term")))).alias("r"))
    pattern = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(c, "|"), F.lit(r")(?![\p{L}\p{N}])")))
    return stored(gathered.select("key", pattern("g").alias("generalised"), pattern("r").alias("removed")), "disclosing-texts")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else df


def term_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """key, kind (term, or removed), start, end of disclosing terms. found: of ``texts_with``."""
    texts = documents.select(text_key(F.col("text")).alias("key"), F.col("text").alias("t")).join(_small(found), "key")
    sides = [texts.where(F.col(c).isNotNull()).select("key", F.lit(kind).alias("kind"), F.split("t", F.col(c), -1).alias("pieces"), F.regexp_extract_all("t", F.col(c), F.lit(0)).alias("found")) for kind, c in (("term", "generalised"), ("removed", "removed"))]
    return _placed(sides[0].unionByName(sides[1])).select("key", "kind", "start", "end")


def text_spans(documents: DataFrame) -> DataFrame:
    """key, spans (array of start, rank, kind, end in order) for each distinct text with any span."""
    spans = stored(base_spans(documents), "entities")
    terms = disclosing_terms(documents, spans)
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS, F.when(F.lit(False), 0)).otherwise(len(KINDS))
    every = spans.select("key", "kind", "start", "end").withColumn("rank", rank)
    if terms.limit(1).count():
        added = term_spans(documents, texts_with(documents, terms)).withColumn("rank", F.lit(len(KINDS)))
        fixed = F.col("rank") < len(KINDS)
        order = W.partitionBy("key").orderBy("start", "rank", "end")
        before = F.max(F.when(fixed, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
        after = F.min(F.when(fixed, F.col("start"))).over(W.partitionBy("key").orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
        both = every.unionByName(added).withColumn("before", before).withColumn("after", after)
        clear = fixed | (F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True)))
        every = both.where(clear).select("key", "kind", "start", "end", "rank")
    return every.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))


def private_spans(documents: DataFrame) -> DataFrame:
    """doc_id, spans (array of start, rank, end, kind; code points, end exclusive) for each row."""
    rows = documents.select(F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("key"))
    found = stored(text_spans(documents), "private")
    none = F.array().cast(found.schema["spans"].dataType)
    return rows.join(_small(found), "key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, number of spans of each fixed kind, their digest, and all spans in one string."""
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _replaced(text: Column, kind: str) -> Column:
    """text with the valid matches of one fixed pattern replaced by the kind's name."""
    pieces, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    shown = F.zip_with(pieces, found, lambda p, m: F.concat(p, F.when(m.isNull(), "").when(valid(F.lit(kind), m), f"[{kind.upper()}]").otherwise(m)))
    return F.when(_hinted(kind, text), F.array_join(shown, "")).otherwise(text)


def sanitise(documents: DataFrame, size: str | None = "n_chars") -> DataFrame:
    """documents with entities replaced by the name of their kind, and disclosing terms generalised or removed.

    size: a column that is set to the length of the new text, if there is one of this name.
    """
    spans = stored(base_spans(documents), "entities")
    terms = disclosing_terms(documents, spans)
    names = documents.columns
    rows = documents.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{names.index('text')}")
    rows = rows.withColumn("t", text)
    if terms.limit(1).count():
        found = texts_with(documents, terms)
        rows = rows.withColumn("key", text_key(text)).join(_small(found), "key", "left")
    for kind in KINDS:
        rows = rows.withColumn("t", _replaced(F.col("t"), kind))
    if "removed" in rows.columns:
        # a term that is called like a kind doesn't touch the names put in for entities
        named = F.lit(rf"(?!(?<=\[)(?:{'|'.join(k.upper() for k in (*KINDS, 'term'))})\])")
        for column, shown in (("removed", ""), ("generalised", "[TERM]")):
            rows = rows.withColumn("t", F.when(F.col(column).isNull(), F.col("t")).otherwise(F.regexp_replace("t", F.concat(named, F.col(column)), F.lit(shown))))
    out = {c: F.col(f"c{i}") for i, c in enumerate(names)} | {"text": F.col("t")}
    if size in out:
        out[size] = F.length("t").cast(documents.schema[size].dataType)
    return rows.select(*(c.alias(k) for k, c in out.items()))
