"""Quality rules: a decision list learned from labelled text statistics, applied as ordered Spark conditions.

Sequential covering (grow, prune, cover) learns interpretable conjunctions of thresholds on a bounded
sample of labelled rows; the rules become one ``when(...).when(...).otherwise(...)`` expression, so scoring is
plain column arithmetic over the statistics of every whole text.

Defined results: a null text counts as empty (no words, base_failed); an empty table gives an empty table;
repeated rows are judged each on its own; an unlabelled or one-class sample gives an empty list (only the base
rule decides). Columns of the input beside the id and the text are ignored by ``quality_stats``, and kept as
they are by ``filter_quality`` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.llm.common import parts

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Most labelled rows that the learner sees; taken by a hash of the id.
MAX_LABELLED = 20_000
WINDOW = 5


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int, vocab: int) -> np.ndarray:
    """Words of each document that stand in five-word windows found twice or more in it."""
    n = len(ids) - WINDOW + 1
    out = np.zeros(n_docs, np.int64)
    if n < 1:
        return out
    inside = doc[:n] == doc[WINDOW - 1 :]
    two = np.unique(ids[:-1] * vocab + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1]
    five = np.unique(four[:n] * vocab + ids[WINDOW - 1 :], return_inverse=True)[1]
    at = np.flatnonzero(inside)
    _, inverse, count = np.unique(five[at] * n_docs + doc[at], return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs).astype(np.int64)


def text_stats(texts: list[str]) -> dict[str, np.ndarray]:
    """The five base statistics of whole texts, as arrays."""
    words = [WORD.findall(t) for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), n_words)
    flat = list(chain.from_iterable(words))
    chars = np.bincount(doc, weights=np.fromiter(map(len, flat), np.int64, len(flat)), minlength=len(texts))
    ids, names = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    lines = [[x for x in t.split("\n") if WORD.search(x)] if "\n" in t else () for t in texts]
    return {
        "n_words": n_words,
        "word_chars": chars.astype(np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _repeated(ids.astype(np.int64), doc, len(texts), len(names) or 1),
    }


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of df as c0, c1 and so on, and those of STATS for each row's whole text; so no name of df can clash."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*plain.schema.fields, *[T.StructField(k, T.LongType()) for k in STATS]])
    at = f"c{names.index(text)}"

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, at):
            found = text_stats(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[k]) for k in STATS]], names=[*batch.schema.names, *STATS])

    return plain.mapInArrow(stats, schema)


def features() -> dict[str, Column]:
    """What the rules test: ratios of the statistics, as columns over the names in STATS."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "words": words,
    }


@dataclass(frozen=True)
class Test:
    """feature > threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def holds(self, frame: pd.DataFrame) -> np.ndarray:
        x = frame[self.feature].to_numpy()
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Test, ...]


def _covered(rule: Rule, frame: pd.DataFrame) -> np.ndarray:
    hit = np.ones(len(frame), bool)
    for test in rule:
        hit &= test.holds(frame)
    return hit


def _grow(frame: pd.DataFrame, bad: np.ndarray, names: list[str], bins: int, longest: int) -> Rule:
    """Adds the test of the largest information gain until only rejected rows are covered."""
    rule: Rule = ()
    hit = np.ones(len(frame), bool)
    while len(rule) < longest and (~bad & hit).any():
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        base, best = np.log2(p / (p + n)), (0.0, None, None)
        for name in names:
            values = frame[name].to_numpy()
            for cut in np.unique(np.quantile(values[hit], np.linspace(0, 1, bins)[:-1])):
                for above in (True, False):
                    test = Test(name, above, float(round(cut, 6)))
                    now = hit & test.holds(frame)
                    q = (now & bad).sum()
                    if q and (gain := q * (np.log2(q / now.sum()) - base)) > best[0] + 1e-9:
                        best = (gain, test, now)
        if best[1] is None:
            break
        rule, hit = (*rule, best[1]), best[2]
    return rule


def _prune(rule: Rule, frame: pd.DataFrame, bad: np.ndarray) -> tuple[Rule, float]:
    """The shortest leading part with the best (p - n) / (p + n) on rows kept aside, and its precision there."""
    best: tuple[float, Rule, float] = (-2.0, rule, 0.0)
    for k in range(1, len(rule) + 1):
        hit = _covered(rule[:k], frame)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0] + 1e-9:
            best = (worth, rule[:k], p / (p + n) if p + n else 0.0)
    return best[1], best[2]


def learn_rules(frame: pd.DataFrame, bad: np.ndarray, *, precision: float = 0.8, bins: int = 40, longest: int = 4, most: int = 12, seed: int = 7) -> list[Rule]:
    """Sequential covering: each rule is grown on two thirds of what remains and pruned on the rest.

    A rule joins the list while, on the pruning rows, its precision for the rejected class reaches ``precision``.
    """
    names = list(features())
    rules: list[Rule] = []
    left = np.arange(len(frame))
    rng = np.random.default_rng(seed)
    while len(rules) < most and bad[left].sum() >= 5 and (~bad[left]).sum():
        left = rng.permutation(left)
        cut = len(left) * 2 // 3
        grow, prune = left[:cut], left[cut:]
        if not bad[grow].any():
            break
        rule = _grow(frame.iloc[grow], bad[grow], names, bins, longest)
        if not rule:
            break
        rule, right = _prune(rule, frame.iloc[prune], bad[prune])
        if right < precision:
            break
        rules.append(rule)
        left = np.sort(left[~_covered(rule, frame.iloc[left])])
    return rules


def reject_column(rules: list[Rule]) -> Column:
    """The ordered list as one expression: true where a rule rejects, false where none does."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = F.when(condition, F.lit(True)) if out is None else out.when(condition, F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Features and label of at most ``most`` labelled documents, those with the smallest hash of doc_id."""
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality"))
        .where("__id is not null and __quality is not null")
        .orderBy(F.xxhash64("__id"), "__id", "__quality")
        .limit(most)
    )
    docs = documents.select(F.col("doc_id").alias("__id"), F.col("text").alias("text"))
    rows = with_stats(docs.join(F.broadcast(chosen), "__id").select("text", "__quality"))  # at most `most` rows of two numbers
    return rows.select(*(c.alias(k) for k, c in features().items()), F.col("c1").alias("__quality"))


def fit_quality(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Rule]:
    """The decision list for these labels (quality 0: reject)."""
    frame = labelled_sample(documents, labels, most).toPandas().sort_values([*features(), "__quality"], ignore_index=True)
    return learn_rules(frame, frame["__quality"].to_numpy() == 0) if len(frame) else []


def quality_stats(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed and kept, a row for each row of documents."""
    rows = with_stats(documents.select("doc_id", "text")).select(F.col("c0").alias("doc_id"), *STATS)
    rows = rows.withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & ~reject_column(rules))


def filter_quality(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of documents that pass, with all their columns."""
    kept = with_stats(documents).where(~base_failed() & ~reject_column(rules))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)))
