"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` with the literal tokens that any match must hold. A rule
is filed under the one of its tokens that the fewest URLs have; the tokens of a URL fetch candidate rules, and
only those run their expression. The longest rule that fits decides; a URL that no rule fits is allowed.

URLs are judged once per distinct (host, path), so a host with a third of all rows costs one row per distinct
path. Rules without a literal token are filed under the empty token, which every URL has.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and the verdict allow;
an empty table gives an empty table; repeated rows give repeated rows; other columns of the input are ignored.
Of rules of equal length block wins, then the smaller pattern text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rules that are broadcast; a longer list is joined by a shuffle on the token.
BROADCAST_RULES = 20_000
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """A rule: its name in results, its expression, literal tokens that a match holds whole, and its verdict."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    #: Rules of a lower rank count only where none of a higher one fits.
    rank: int = 1


def host_path_rule(verdict: str, rule: str) -> UrlRule:
    """Rule ``host/path`` for a host with all its subdomains, and paths that begin with its path."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    whole = re.findall(TOKEN, host.lower())
    # the path's last token may go on in the URL, unless a sign ends it; tokens are of lower case
    whole += [m.group() for m in re.finditer(TOKEN, path.lower()) if m.end() < len(path)]
    return UrlRule(rule, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}", tuple(dict.fromkeys(whole)), verdict)


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(host, path)), F.lit(TOKEN), F.lit(0)))


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    rows = [(r.name, r.pattern, list(r.tokens), r.verdict, r.rank, len(r.name)) for r in rules]
    return spark.createDataFrame(rows, "rule string, pattern string, tokens array<string>, rule_verdict string, rank int, size int")


def index_rules(rules: DataFrame, url_tokens_: DataFrame, few: bool) -> DataFrame:
    """rules with the token that each is filed under: its rarest over the column ``token`` of url_tokens_."""
    tokens = rules.select("rule", F.explode("tokens").alias("token")).distinct()
    wanted = tokens.select("token").distinct()
    seen = url_tokens_.join(F.broadcast(wanted) if few else wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        tokens.join(seen, "token", "left")
        .groupBy("rule")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    return rules.join(rarest, "rule", "left").withColumn("token", F.coalesce("token", F.lit("")))


def with_tokens(urls: DataFrame) -> DataFrame:
    """host, path, token: each URL's tokens, and the empty one, which rules without a literal are filed under."""
    every = F.array_union(url_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))
    return urls.select("host", "path", F.explode(every).alias("token"))


def candidates(tokens: DataFrame, index: DataFrame, few: bool) -> DataFrame:
    """host, path and every rule that a URL's tokens fetch; a rule has one token in the index, so no pair comes twice."""
    return tokens.join(F.broadcast(index) if few else index, "token")


def judge_urls(df: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, its rank (both null where none fits) and verdict, a row for each row of df."""
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    pages = df.select(F.col(key).alias(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    urls = pages.select("host", "path").distinct()
    tokens = with_tokens(urls)
    index = index_rules(rules, tokens.where("token <> ''"), few)
    order = F.struct("rank", "size", (F.col("rule_verdict") == "block").alias("block"), F.expr("-crc32(pattern)").alias("tie"), "rule", "rule_verdict")
    fits = (
        candidates(tokens, index, few)
        .where(F.expr("concat(host, path) rlike pattern"))
        .groupBy("host", "path")
        .agg(F.max(order).alias("best"))
        .select("host", "path", "best.rule", "best.rank", F.col("best.rule_verdict").alias("verdict"))
    )
    return pages.join(fits, ["host", "path"], "left").select(key, "host", "path", "rule", "rank", F.coalesce("verdict", F.lit(default)).alias("verdict"))
