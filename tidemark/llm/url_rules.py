"""URL filters: host and path rules, found through the rarest literal token of each rule.

Native: DataFrame functions only. A rule is indexed under one token that every URL it fits must hold; of the rule's
tokens that is the one with the fewest URLs. A URL's tokens fetch its candidate rules by an equi-join, and only those
candidates run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many index rows (one a rule) go to every task with their join; a longer list is joined by shuffle.
BROADCAST_RULES = 20_000
#: Up to so many go there as one map, whose keys are looked through for each token; beyond it tokens are joined.
MAP_RULES = 128

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"\A(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that stand whole in any URL that fits: a path's last one may go on there, if nothing ends it."""
        return sorted({*re.findall("[A-Za-z0-9]+", self.host), *re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", self.path)})


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path`` (up to ``?``, ``#`` or the end); both are empty for a null URL or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOW)
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)})


def judge(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: ``key, host, path, rule, verdict``.

    The fitting rule with the longest text wins; of equally long ones the one with the longer host, then a block.
    Without one, ``rule`` is null and ``verdict`` is ``default``. Null, empty and malformed URLs have an empty host,
    which no rule fits. Repeated keys and rows are each judged. Other columns, also such as clash in name, are ignored.
    An empty table or an empty list of rules gives a defined (empty or all-default) result.
    """
    spark = pages.sparkSession
    urls = split_url(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url")
    found = urls.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not rules:
        return found
    urls = urls.withColumn("tokens", F.array_distinct(F.filter(F.split(F.concat_ws("/", "host", "path"), "[^A-Za-z0-9]+"), lambda t: t != "")))
    listed = spark.createDataFrame([(i, r.text, r.verdict, r.host, r.pattern, r.tokens or [""]) for i, r in enumerate(rules)], "rule_id int, rule string, rule_verdict string, rule_host string, pattern string, tokens array<string>")
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda x: x)
    per_token = listed.select("rule_id", F.explode("tokens").alias("token"))
    counts = urls.select(F.explode("tokens").alias("token")).join(hint(per_token.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarest = per_token.join(counts, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    index = listed.drop("tokens").join(rarest, "rule_id")
    rank = F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"), (F.col("rule_verdict") == "block").alias("c"), F.col("rule"), F.col("rule_verdict"))
    if len(rules) <= min(MAP_RULES, BROADCAST_RULES):
        # All of the index goes to each task as one map from token to rules: a URL looks its own tokens up.
        held = index.groupBy("token").agg(F.collect_list(F.struct("pattern", rank.alias("rank"))).alias("rules"))
        held = held.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("held")).withColumn("one", F.lit(1))
        tokens = F.concat("tokens", F.array(F.lit("")))
        fetched = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at("held", t)), lambda x: x.isNotNull()))
        fits = F.filter(fetched, lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))
        best = F.array_max(F.transform(fits, lambda r: r["rank"]))
        judged = urls.withColumn("one", F.lit(1)).join(F.broadcast(held), "one").withColumn("best", best)  # held is one row
        return judged.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
    distinct = urls.select("host", "path", "tokens").distinct()
    fetched = distinct.select("host", "path", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token")).join(hint(index), "token")
    best = fetched.where(F.expr("concat(host, path) rlike pattern")).groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
