"""URL filter: fixed rules first, then association rules mined from labelled URLs.

FP-growth finds token combinations that come with the label "block"; a URL that
holds all tokens of such a rule is blocked.  All of it runs as DataFrame
operations inside Spark.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import written

#: Share of the labelled URLs, and number of them, that a rule must cover with its label.
LEAST_SUPPORT = 0.002
LEAST_ROWS = 20
#: Share of the URLs with a rule's tokens that must be labelled "block".
LEAST_CONFIDENCE = 0.7
#: The item that stands for the label; no token looks like it.
BLOCK = "label:block"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of ``rules`` (verdict, ``host/path``), else nulls.

    A rule fits its host and all subdomains of it where the path starts as the rule's does.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: labels of the host, and words of the path."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("host:"), t))
    words = F.transform(F.split(F.translate(path, _UPPER, _UPPER.lower()), r"[^a-z0-9-]+"), lambda t: F.concat(F.lit("path:"), t))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, words), lambda t: ~t.endswith(":"))))


def _rows_of_tokens(rows: DataFrame) -> DataFrame:
    """(token, n, bad, twins) of each token of ``rows`` (tokens, block): tokens of the same rows share ``twins``.

    Rows of equal contents are counted first.  The sums of two hashes of the
    contents, and the counts, stand for the set of rows.
    """
    equal = rows.groupBy("tokens", "block").agg(F.count(F.lit(1)).alias("n"))
    names = [F.xxhash64(F.lit(i), "tokens", "block").cast("decimal(20,0)") * F.col("n") for i in (0, 1)]
    held = equal.select(F.explode("tokens").alias("token"), "n", "block", *[h.alias(f"h{i}") for i, h in enumerate(names)])
    return (
        held.groupBy("token")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("bad"),
            F.struct(F.sum("n"), F.sum("h0"), F.sum("h1")).alias("twins"),
        )
    )


def mine_rules(labelled: DataFrame) -> DataFrame:
    """(tokens, confidence, support) of rules for ``labelled`` (tokens, block); ``tokens`` lists sets of tokens.

    A URL meets a rule that holds a token of each of its sets.  Rules cover
    ``LEAST_SUPPORT`` and ``LEAST_ROWS`` labelled URLs at least and hold for
    ``LEAST_CONFIDENCE`` of those with their tokens.  Null labels are left out.

    Only what can add a verdict is mined.  A token that is a rule by itself, or
    is in too few bad URLs to be in any, is left out of longer ones, and tokens
    of exactly the same labelled URLs are one item, a set: any of them gives the
    same rule.  A template's common tokens so count once, however many they are.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("block").isNotNull() & (F.size("tokens") > 0)).select("tokens", "block")
    count = rows.count()
    if not count:
        return spark.createDataFrame([], "tokens array<array<string>>, confidence double, support double")
    least = max(LEAST_ROWS, math.ceil(count * LEAST_SUPPORT))
    frequent = _rows_of_tokens(rows).where(F.col("bad") >= least)
    sets = frequent.groupBy("twins", "n", "bad").agg(F.array_sort(F.collect_list("token")).alias("members"))
    confidence = F.col("bad") / F.col("n")
    sets = written(sets.select("members", F.col("members")[0].alias("item"), "n", "bad", confidence.alias("confidence")))
    sure = sets.where(F.col("confidence") >= LEAST_CONFIDENCE)
    single = sure.select(F.array("members").alias("tokens"), "confidence", (F.col("bad") / count).alias("support"))
    others = sets.where(F.col("confidence") < LEAST_CONFIDENCE).select("item", "members")
    # One token stands for its set; rows that hold none of the sets count in no longer rule.
    equal = rows.groupBy("tokens", "block").agg(F.count(F.lit(1)).alias("n"))
    kept = (
        equal.withColumn("item", F.explode("tokens"))
        .join(others.select("item"), "item", "left_semi")
        .groupBy("tokens", "block", "n")
        .agg(F.collect_list("item").alias("items"))
    )
    marked = F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items"))
    items = written(kept.select(F.explode(F.array_repeat(marked, F.col("n").cast("int"))).alias("items")))
    left = items.count()
    if not left:
        return single
    # Half a row less, so that rounding cannot ask for one more.
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / left), minConfidence=LEAST_CONFIDENCE)
    found = growth.fit(items).associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK)))
    longer = (
        found.select("antecedent", "confidence", (F.col("support") * left / count).alias("support"), F.explode("antecedent").alias("item"))
        .join(others, "item")
        .groupBy("antecedent", "confidence", "support")
        .agg(F.collect_list("members").alias("tokens"))
    )
    return single.unionByName(longer.select("tokens", "confidence", "support"))


def matching_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of ``urls`` (url, tokens; distinct) that hold a token of each set of a rule.

    Rules are indexed by the tokens of their rarest set, so a token that is in
    most URLs meets only the rules that have nothing rarer.
    """
    numbered = rules.select(F.col("tokens").alias("rule"))
    postings = urls.select("url", F.col("tokens").alias("held"), F.explode("tokens").alias("token"))
    used = numbered.select(F.explode(F.flatten("rule")).alias("token")).distinct()
    frequency = postings.join(used, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        numbered.select("rule", F.explode("rule").alias("members"))
        .select("rule", "members", F.explode("members").alias("token"))
        .join(frequency, "token", "left")
        .groupBy("rule", "members")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        .groupBy("rule")
        .agg(F.min_by("members", F.struct("n", "members")).alias("members"))
        .select("rule", F.explode("members").alias("token"))
    )
    held = F.forall("rule", lambda members: F.arrays_overlap(members, F.col("held")))
    return postings.join(rarest, "token").where(held).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url).

    ``labels`` (page_id, block) says which pages are known to be bad; several
    labels of a page count as bad if any is.  A fixed rule decides where one
    fits, else the mined rules: block if one matches, allow if none does.  Null
    URLs have empty host and path and are allowed.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("fixed"))
    known = labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("block").alias("block"))
    labelled = rows.join(known, "page_id").select(tokens(F.col("host"), F.col("path")).alias("tokens"), "block")
    open_urls = rows.where(F.col("fixed").isNull() & F.col("url").isNotNull()).select("url", "host", "path").distinct()
    matched = matching_urls(open_urls.select("url", tokens(F.col("host"), F.col("path")).alias("tokens")), mine_rules(labelled))
    found = rows.join(matched.withColumn("bad", F.lit(True)), "url", "left")
    learnt = F.when(F.col("bad"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("fixed", learnt).alias("verdict"))
