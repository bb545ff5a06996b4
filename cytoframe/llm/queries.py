"""The corpus queries of the driver's entry file, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm import bpe, chat, decontam, html, neardup, pieces, pii, quality, repair, resampling, sharding, toxicity, url_rules, urls

SHARDS = 40
#: Turns that look like the template's own marks.
PROBE = "\\### Assistant: </turn> ok"
URL_RULES = [
    urls.host_path_rule("allow", "org/"),
    urls.host_path_rule("block", "example.org/es/"),
    urls.host_path_rule("block", "example.org/en/1"),
    urls.host_path_rule("allow", "com/fr/"),
    urls.host_path_rule("block", "com/de/"),
    *url_rules.blocked(),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file (they lie outside the repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return chat.window_digests(chat.format_windows(turns.unionByName(probe)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.private_spans(_table(spark, sf_dir, "documents")))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(toxicity.fold(F.col("doc_id")) != 0)
    scored = toxicity.score_texts(documents, toxicity.fit_toxicity(documents, labels))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("bigint").alias("n_spans"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(_table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))
    named = F.when(F.col("rank") == 1, F.col("rule")).alias("rule")
    return judged.select("page_id", "host", "path", named, "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    rules = quality.fit_quality(documents, _table(spark, sf_dir, "labels"))
    return quality.quality_stats(documents, rules)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.dedup_documents(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(bpe.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(pieces.encode_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair.repair_report(conversations, repair.damage(conversations))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_chat": op2_chat,
        "op3_pii": op3_pii,
        "op4_quality_rules": op4_quality_rules,
        "op5_html": op5_html,
        "op6_toxicity": op6_toxicity,
        "op7_urls": op7_urls,
        "op8_decontam": op8_decontam,
        "op9_neardup": op9_neardup,
        "op10_bpe": op10_bpe,
        "op11_pieces": op11_pieces,
        "op12_repair": op12_repair,
        "op13_resampling": op13_resampling,
    }


OP7_SQL = r"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages
), r as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from u
)
select page_id, host, path, rule, case
  when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block'
  when rule is not null then 'allow'
  when regexp_matches(host, '(^|\\.)(LABELS)(-[0-9]+)?\\.') or regexp_matches(path, '^/(.*/)?(SEGMENTS)(/|$)') then 'block' else 'allow' end as verdict
from r
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_urls": OP7_SQL.replace("\\\\", "\\").replace("LABELS", url_rules.labels_pattern()).replace("SEGMENTS", "|".join(url_rules.segments()))}
