"""URL verdicts by rules and by empirical-Bayes host reputation.

Labelled page outcomes give each host a rate of bad pages. A host's rate is
shrunk to its registered domain's, that to its suffix's, and that to the rate
of all pages, each with a beta-binomial prior whose strength is fitted to the
spread between the groups of that level. A host is blocked if even the lower
posterior bound of its rate is too high. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host and path) that fits, as
    struct<rule, verdict>, or null. A rule fits its host and subdomains, if
    the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame) -> DataFrame:
    """One row, m and k: the mean rate of the groups (bad, n) and the strength
    of the beta prior whose spread, with binomial noise, is the spread seen."""
    sums = groups.agg(F.sum("bad").alias("b"), F.sum("n").alias("t"), F.count("*").alias("g"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    m = (F.col("b") + 1) / (F.col("t") + 2)
    between = (F.col("q") - F.col("b") * F.col("b") / F.col("t") - (F.col("g") - 1) * m * (1 - m)) / (F.col("t") - F.col("nn") / F.col("t"))
    k = F.when(between > 0, F.least(F.greatest(m * (1 - m) / between - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)
    return sums.select(F.coalesce(m, F.lit(0.5)).alias("m"), F.coalesce(F.when(F.col("t") > F.col("nn") / F.col("t"), k), F.lit(1000.0)).alias("k"))


def suffix_of(name: Column, known: Sequence[str]) -> Column:
    """The longest of the ``known`` suffixes of a host, or its last label."""
    out = F.substring_index(name, ".", -1)
    for s in sorted(known, key=lambda s: (len(s), s)):
        out = F.when((name == s) | name.endswith("." + s), s).otherwise(out)
    return out


def reputation(outcomes: DataFrame, *, z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, rate, low): posterior mean and lower bound of a host's share of
    bad pages, from (host, bad, n) with one row for each host.

    A port is no part of a host's name. The registered domain is the suffix
    and the label before it; ``suffixes`` lists those of several labels, such
    as co.uk, and any other suffix is one label."""
    name = F.regexp_replace("host", ":[0-9]*$", "")
    rest = F.expr("substring(_name, 1, greatest(0, length(_name) - length(suffix) - 1))")
    domain = F.concat(F.substring_index(rest, ".", -1), F.lit("."), F.col("suffix"))
    named = outcomes.withColumn("_name", name).withColumn("suffix", suffix_of(F.col("_name"), suffixes))
    hosts = named.select("host", "suffix", domain.alias("domain"), F.col("bad").cast("double").alias("bad"), F.col("n").cast("double").alias("n"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    shrunk = lambda m: (F.col("bad") + F.col("k") * m) / (F.col("n") + F.col("k"))
    # the strengths are one-row tables: a scalar for each level
    s = suffixes.join(F.broadcast(_strength(suffixes))).select("suffix", shrunk(F.col("m")).alias("suffix_rate"))
    d = domains.join(F.broadcast(_strength(domains).select("k"))).join(s, "suffix").select("domain", "suffix", shrunk(F.col("suffix_rate")).alias("domain_rate"))
    h = hosts.join(F.broadcast(_strength(hosts).select("k"))).join(d, ["domain", "suffix"])
    rate = shrunk(F.col("domain_rate"))
    return h.select("host", rate.alias("rate"), (rate - z * F.sqrt(rate * (1 - rate) / (F.col("n") + F.col("k") + 1))).alias("low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], *, url: str = "url", key: str = "page_id", most: float = 0.5, suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    A fitting rule decides; else the host's reputation: ``block`` if its lower
    bound exceeds ``most``, else ``allow``, also for hosts without labelled
    pages. A null url, or one without ://, has an empty host and path.
    ``outcomes`` has (host, bad, n), one row for each host with labelled
    pages. Repeated rows are judged alike; an empty table gives an empty
    result; other columns are not read. Pages of one host are never gathered:
    outcomes are sums by host, and the blocked hosts are joined back."""
    judged = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    blocked = reputation(outcomes, suffixes=suffixes).where(F.col("low") > most).select("host", F.lit("block").alias("own"))
    out = judged.join(blocked, "host", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "own", F.lit("allow")).alias("verdict"))
