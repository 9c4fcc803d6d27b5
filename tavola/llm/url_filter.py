"""URL filter: host rules first, then empirical-Bayes host reputation; built-in functions only.

A rule is a host and a path prefix; it fits the host and its subdomains, and the longest
fitting rule decides.  The rules are a short list, evaluated as one expression.

Every other URL is judged by its host's reputation.  Labelled outcomes (bad or not) are
counted by host, registered domain and public suffix.  From the suffix down, the bad
rate of the level above is the mean of a beta prior; its strength comes from the
between-group spread of the level, by the method of moments for beta-binomial counts.
A host is blocked when the lower bound of its posterior bad rate, mean - ``z`` standard
deviations, is over ``max_bad``.  A host without labels keeps its domain's mean with the prior's
width.  Counts are partial sums before any shuffle; the look-up of the page's host is a
join of narrow rows that adaptive execution splits when a host is hot.

Defined cases: a null URL or one without ``://`` has an empty host and path, its outcomes count
for the host ''; repeated labels of a page count once, bad if any is; a null outcome
is no label; repeated pages each give a row and count each; without any label every rate is 1/2 with a wide
bound; input columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.staging import stage
from tavola.llm.textsql import lower_ascii

#: Public suffixes of two labels, beside every last label (a parameter of ``registered``).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls; ``rules`` are (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def registered(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host; a port is left out, a bare name is its own."""
    host = F.regexp_replace(host, ":[0-9]*$", "")
    last_two = F.substring_index(host, ".", -2)
    two = last_two.isin(*suffixes)
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(last_two), F.when(two, last_two).otherwise(F.substring_index(host, ".", -1))


def _strength(groups: DataFrame) -> Column:
    """Weight in outcomes of a beta prior with mean ``above``, from counts n and bad of the groups it spreads over."""
    spread = F.sum((F.col("bad") - F.col("n") * F.col("above")) ** 2 / (F.col("above") * (1 - F.col("above"))))
    pairs = F.sum(F.col("n") * (F.col("n") - 1))
    rho = F.when(pairs > 0, (spread - F.sum("n")) / F.when(pairs > 0, pairs))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(rho, F.lit(0.5))))
    return groups.agg(((1 - rho) / rho).alias("s")).scalar()


def _level(groups: DataFrame) -> DataFrame:
    """Adds strength ``s`` and the posterior mean ``mean`` to groups with n, bad and above."""
    groups = groups.withColumn("s", _strength(groups))
    return groups.withColumn("mean", (F.col("bad") + F.col("s") * F.col("above")) / (F.col("n") + F.col("s")))


def host_reputation(outcomes: DataFrame, z: float) -> DataFrame:
    """host, bound from rows (host, n, bad), a row or more per host."""
    domain, suffix = registered(F.col("host"))
    hosts = stage(outcomes.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    total = hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("m")).scalar()
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = _level(hosts.groupBy("suffix").agg(*sums).withColumn("above", total)).select("suffix", F.col("mean").alias("above"))
    domains = _level(hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix")).select("suffix", "domain", F.col("mean").alias("above"))
    hosts = _level(hosts.join(domains, ["suffix", "domain"]))
    a, b = F.col("bad") + F.col("s") * F.col("above"), F.col("n") - F.col("bad") + F.col("s") * (1 - F.col("above"))
    width = F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return hosts.select("host", (a / (a + b) - F.lit(z) * width).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], max_bad: float = 0.3, z: float = 1.0, url: str = "url", id: str = "page_id") -> DataFrame:  # noqa: A002
    """One row per page: page_id, host, path, rule, verdict, bad_bound (six decimals).

    ``outcomes`` has the page's id as ``outcome_id`` and ``bad`` (0, 1 or null).
    """
    pages = stage(pages.select(F.col(id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")), "urls")
    outcomes = outcomes.where("bad is not null").groupBy("outcome_id").agg(F.max("bad").alias("bad"))
    labelled = pages.join(outcomes, F.col("page_id") == F.col("outcome_id")).groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    every = pages.select("host").distinct().select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    bounds = stage(host_reputation(labelled.select("host", "n", F.col("bad").cast("long")).unionByName(every), z), "reputation")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.join(bounds, "host", "left")
    earned = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, earned).alias("verdict"), F.round("bound", 6).alias("bad_bound"))
