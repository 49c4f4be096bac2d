"""URL filtering by association rules: FP-growth over URL tokens of labelled pages, DataFrame functions only.

Tokens of a URL are its scheme, the labels and the last two labels of its host, its path segments (runs
of digits count as #), file extension, query keys and whether it has a fragment. Rules `tokens -> bad`
that reach SUPPORT, CONFIDENCE and LIFT and have no shorter rule inside them are indexed under their
rarest token; a URL is blocked if all tokens of a rule found under one of its tokens are its own.
Written rules (host, path, verdict) come first: the longest that fits decides.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: At most about so many labelled URLs are mined.
TRAIN_URLS = 200_000
#: Labelled URLs that a rule's tokens and label must have in common, at least; and at least this share.
SUPPORT = 20
SUPPORT_SHARE = 0.0005
CONFIDENCE = 0.8
LIFT = 1.5
BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Text between the first :// and the next /, ?, # or end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL; empty for null and for text without ://."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    site = F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".")))
    parts = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.regexp_replace(x, r"\.[a-z0-9]{1,5}$", ""), "[0-9]+", "#")))
    ending = F.transform(F.filter(F.array(F.regexp_extract(F.lower(path), r"\.([a-z0-9]{1,5})$", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("x:"), x))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(F.lower(query), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    fragment = F.when(url.contains("#"), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    own = F.concat(scheme, F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), site, parts, ending, keys, fragment)
    return F.when(url.contains("://"), F.array_distinct(own)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame | None:
    """Rules (tokens array<string>, confidence double) from (url string, bad boolean), or None without any.

    Rows with a null url or label are ignored; repeated rows count each.
    """
    rows = labelled.where("url is not null and bad is not null").select(tokens_of(F.col("url")).alias("tokens"), "bad", F.xxhash64("url").alias("h")).where(F.size("tokens") > 0)
    n = rows.count()
    if not n:
        return None
    share = min(1.0, TRAIN_URLS / n)
    rows = rows.where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000))
    items = rows.select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items"))
    least = max(support / max(1.0, n * share), SUPPORT_SHARE)
    if least > 1:
        return None
    rules = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(items).associationRules
    rules = rules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD) & (F.col("lift") >= lift))
    return rules.select(F.array_sort("antecedent").alias("tokens"), "confidence")


def without_longer(rules: DataFrame) -> DataFrame:
    """Rules that hold no other rule: a rule found under one of another's tokens prunes it."""
    keyed = rules.select(F.element_at("tokens", 1).alias("key"), F.col("tokens").alias("short"))
    inside = rules.select("tokens", F.explode("tokens").alias("key")).join(keyed, "key").where((F.size("short") < F.size("tokens")) & (F.size(F.array_except("short", "tokens")) == 0))
    return rules.join(inside.select("tokens").distinct(), "tokens", "left_anti")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls to which a mined rule applies, by an inverted index on each rule's rarest token."""
    tokens = urls.where("url is not null").select("url").distinct().select("url", tokens_of(F.col("url")).alias("own"))
    use = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    keyed = rules.select("tokens", F.explode("tokens").alias("token")).join(use, "token").groupBy("tokens").agg(F.min(F.struct("n", "token")).alias("key"))
    index = keyed.select(F.col("key.token").alias("token"), F.col("tokens").alias("needs"))
    found = tokens.select("url", "own", F.explode("own").alias("token")).join(index, "token")
    return found.where(F.size(F.array_except("needs", "own")) == 0).select("url").distinct()


def written_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest written rule (host, path, verdict) that fits, null without one."""
    rule = verdict = F.lit(None).cast("string")
    for own_host, own_path, say in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule, verdict = F.when(fits, own_host + own_path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, mined (a mined rule applies).

    Null urls and urls without :// have empty host and path, match no mined rule and are allowed unless
    a written rule fits. Repeated rows are judged alike; other columns are not read.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = written_rule(host, path, rules)
    mined = mine(labelled)
    with Scratch(pages.sparkSession) as scratch:
        found = scratch.keep(without_longer(mined), "rules") if mined is not None else None
        if found is None or found.isEmpty():
            rows = rows.withColumn("mined", F.lit(False))
        else:
            rows = rows.join(matches(rows, found).withColumn("mined", F.lit(True)), "url", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
        by_method = F.when(F.col("mined"), "block").otherwise("allow")
        return scratch.result(rows.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "mined"), "verdicts")
