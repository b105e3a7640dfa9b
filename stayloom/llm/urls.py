"""URL filter: a list of host and path rules, and association rules for the URLs that no list rule fits.

The verdicts of the list are labels. FP-growth mines combinations of URL tokens with their label; those with
enough support and confidence become rules. A rule is filed under its rarest token, so that a URL meets only the
rules filed under one of its own tokens; the surest rule that holds in full decides. All of it is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import written

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
LONGEST = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or URL."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, null if none does; of equally long ones the first in order."""
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        result = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(result)
    return result


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: parts of the host between dots and hyphens, parts of the path that are not numbers."""
    hosts = F.transform(F.filter(F.split(host, "[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    paths = F.transform(
        F.filter(F.split(path, "[/._-]"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("path:"), x))
    return F.array_distinct(F.concat(hosts, paths))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         longest: int = LONGEST) -> DataFrame:
    """Rules ``(key, needs, confidence, support, size, text, verdict)`` from ``(tokens, verdict)``.

    ``needs`` is a sorted set of at most ``longest`` tokens, ``key`` the rarest of them, ``support`` the number of
    labelled URLs with all of them and the verdict, at least ``min_support`` of all.
    """
    mark = "verdict:"
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(mark), "verdict"))).alias("items"))
    sets = written(FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets).freqItemsets, "itemsets")
    split = sets.select(
        "freq", F.array_sort(F.filter("items", lambda x: ~x.startswith(mark))).alias("needs"),
        F.filter("items", lambda x: x.startswith(mark)).alias("marks"))
    split = split.filter((F.size("needs") > 0) & (F.size("needs") <= longest))
    alone = split.filter(F.size("marks") == 0).select("needs", F.col("freq").alias("with_any"))
    rules = split.filter(F.size("marks") == 1).join(alone, "needs").select(
        "needs", (F.col("freq") / F.col("with_any")).alias("confidence"), F.col("freq").alias("support"),
        F.size("needs").alias("size"), F.concat_ws("|", "needs").alias("text"),
        F.substring(F.col("marks")[0], len(mark) + 1, 100).alias("verdict")).filter(F.col("confidence") >= min_confidence)
    single = alone.filter(F.size("needs") == 1).select(F.col("needs")[0].alias("token"), F.col("with_any").alias("seen"))
    keys = (
        rules.select("text", F.explode(F.array_distinct("needs")).alias("token")).distinct().join(single, "token")
        .groupBy("text").agg(F.min(F.struct("seen", "token")).alias("rarest")).select("text", F.col("rarest.token").alias("key"))
    )
    return written(rules.join(keys, "text"), "url-rules")


def best_rule() -> Column:
    """Order of rules: surest, then most supported, then shortest, then first in order."""
    return F.struct(
        (-F.col("confidence")).alias("a"), (-F.col("support")).alias("b"), F.col("size").alias("c"),
        F.col("text").alias("d"), F.col("verdict").alias("e"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow",
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """``page_id, host, path, rule, verdict, reason`` for each row of ``(page_id, url)``.

    ``rules`` are pairs (``allow`` or ``block``, ``host/path``). A URL that no list rule fits gets the verdict of
    the best mined rule, whose tokens ``reason`` names, or ``default``. Null URLs and URLs without ``://`` have an
    empty host and path and no token. Repeated rows are judged once and returned as often as they came; other columns are not returned. Empty
    tables and tables without a labelled URL mine nothing.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = list_rule(F.col("host"), F.col("path"), rules)
    parsed = written(
        read.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("hit", listed).select("page_id", "host", "path", "copies", "hit.rule", "hit.verdict"), "urls")
    cut = parsed.withColumn("tokens", tokens(F.col("host"), F.col("path")))
    labelled = cut.filter(F.col("verdict").isNotNull()).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    known = parsed.filter(F.col("verdict").isNotNull()).withColumn("reason", F.lit(None).cast("string"))
    rest = cut.filter(F.col("verdict").isNull()).drop("verdict")
    if labelled.limit(1).count():
        mined = mine(labelled.select("tokens", "verdict"), min_support, min_confidence, longest)
        met = lookup_join(rest.withColumn("key", F.explode("tokens")), mined, ["key"])
        held = met.filter(F.size(F.array_except("needs", "tokens")) == 0).groupBy("page_id", "host", "path").agg(
            F.min(best_rule()).alias("best"))
        same = reduce(lambda a, b: a & b, [F.expr(f"r.{c} <=> h.{c}") for c in ("page_id", "host", "path")])
        rest = rest.alias("r").join(held.alias("h"), same, "left").select(
            "r.page_id", "r.host", "r.path", "copies", "rule",
            F.coalesce("best.e", F.lit(default)).alias("verdict"), F.col("best.d").alias("reason"))
    else:
        rest = rest.drop("tokens").withColumn("verdict", F.lit(default)).withColumn("reason", F.lit(None).cast("string"))
    return known.unionByName(rest).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")
