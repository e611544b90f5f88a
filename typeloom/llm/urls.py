"""URL filtering against a list of host and path rules, in DataFrame functions.

A rule fits its host and every subdomain, for paths that start with the rule's; the longest fitting rule wins. For
each shape of rule (labels of the host, characters of the path) a URL has one canonical key that such a rule would
need to equal. A blocked Bloom filter of the listed keys, a table that grows with the list, passes those that may be
listed on to an exact hash join, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom

#: Rules that are broadcast to the exact join; a longer list is joined by a shuffled hash join.
BROADCAST_RULES = 200_000

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict in place of url.

    rules: host, path, verdict. A rule with a null fits nothing; of rules with one host and path the greatest verdict
    holds (block over allow). Of two fitting rules of one length the longer host wins. A URL that no rule fits, a null
    URL and one without `://` have a null rule and the default verdict. Repeated pages each keep their row. Other
    columns pass unchanged and must not have the names of the added ones, nor one of those used on the way. A page's keys
    are brought together again within its own task before they are shuffled.
    """
    own = [c for c in pages.columns if c != url]
    if clash := {"host", "path", "rule", "verdict", "_row", "_key", "_h", "_block", "_bits", "_may", "_best", "_rule_host", "_rule_path", "_rule_verdict"} & set(own):
        raise ValueError(f"pages already has {sorted(clash)}")
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.col("host").alias("_rule_host"), F.col("path").alias("_rule_path"), F.col("verdict").alias("_rule_verdict"))
    n = rules.count()
    blocks = bloom.blocks_for(n)
    shapes = rules.select((F.size(F.split("_rule_host", "\\.")).cast("int")).alias("labels"), F.length("_rule_path").alias("chars")).distinct().collect()
    shapes = sorted((r.labels, r.chars) for r in shapes)
    parsed = pages.select(*(F.col(f"`{c}`") for c in own), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("_row"))
    if not shapes:
        return parsed.select(*(F.col(f"`{c}`") for c in own), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = "array(" + ", ".join(f"struct(substring_index(host, '.', -{labels}) as h, substring(path, 1, {chars}) as p)" for labels, chars in shapes) + ")"
    probes = parsed.withColumn("_key", F.explode(F.array_distinct(F.expr(keys)))).withColumn("_h", F.xxhash64("_key.h", "_key.p"))
    listed = bloom.table(rules.select(F.xxhash64("_rule_host", "_rule_path").alias("k")), "k", blocks)
    probes = bloom.marked(probes, "_h", listed, blocks, "_may")
    rules = F.broadcast(rules) if n <= BROADCAST_RULES else rules.hint("shuffle_hash")
    key = F.when(F.col("_may"), F.col("_key"))  # what the filter refuses finds no rule
    hits = probes.join(rules, (key["h"] == F.col("_rule_host")) & (key["p"] == F.col("_rule_path")), "left")
    rule = F.concat("_rule_host", "_rule_path")
    best = F.max(F.when(F.col("_rule_host").isNotNull(), F.struct(F.length(rule).alias("a"), F.length("_rule_host").alias("b"), rule.alias("rule"), F.col("_rule_verdict").alias("verdict"))))
    kept = [F.first(F.col(f"`{c}`")).alias(c) for c in [*own, "host", "path"]]
    out = hits.groupBy("_row").agg(*kept, best.alias("_best"))
    return out.select(*(F.col(f"`{c}`") for c in own), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
