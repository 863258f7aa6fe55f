"""URL rules and empirical-Bayes host reputation, in DataFrame functions only.

A rule names a host suffix and a path prefix; the longest that fits decides.
Where none fits, the reputation of the host does. Labelled outcomes are
counted for hosts, registered domains and suffixes. At each level a
beta-binomial prior has its parent's posterior mean, and a strength that the
method of moments takes from the spread of that level's rates around their
parents. A url is blocked if the lower posterior bound (mean less ``Z``
standard deviations) of its host's bad rate is above ``BAD_RATE``.

Null urls and urls without ``://`` have empty host and path and share the
empty host. Repeated rows count each. Without labels everything without a
rule is allowed. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

Z = 1.645
BAD_RATE = 0.25
#: What is thought of all pages before any label.
PRIOR_RATE, PRIOR_COUNT = 0.1, 2.0
#: Limits of a level's prior strength, in pseudo-observations.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Second-level labels under which names are registered below two-letter suffixes.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)"""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER)
    return pages.select(F.col("page_id").cast("long"), host.alias("host"), F.regexp_extract(url, _PARTS, 2).alias("path"))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def with_levels(df: DataFrame) -> DataFrame:
    """Adds the registered domain and the suffix of ``host``, its port left out."""
    bare = F.regexp_replace("host", r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    second = (n >= 3) & F.element_at(labels, F.greatest(n - 1, F.lit(1))).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    keep = F.when(second, 2).otherwise(1)
    number = bare.rlike(r"^[0-9.]+$")
    suffix = F.when(number | (n == 1), bare).otherwise(F.array_join(F.slice(labels, -keep, keep), "."))
    domain = F.when(number | (n <= keep), bare).otherwise(F.array_join(F.slice(labels, -keep - 1, keep + 1), "."))
    return df.withColumn("domain", domain).withColumn("suffix", suffix)


def _strength(children: DataFrame, on: list[str]) -> DataFrame:
    """One row: the prior strength of a level, from (bad, n, parent's mean p)."""
    rate = F.col("bad") / F.col("n")
    free = F.col("p") * (1 - F.col("p"))
    spread = F.sum(F.col("n") * F.pow(rate - F.col("p"), 2))
    noise, total = F.sum(free), F.sum(F.col("n") * free)
    rho = (spread - noise) / (total - noise)
    strength = F.when((total > noise) & (spread > noise), F.least(F.greatest(1 / rho - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))).otherwise(MOST_STRENGTH)
    return children.where("n > 0").agg(F.coalesce(strength, F.lit(MOST_STRENGTH)).alias("m"))


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, mean, low): posterior mean and lower bound of each host's bad rate.

    ``hosts`` has (page_id, host), ``outcomes`` (page_id, bad) with bad 0 or 1.
    The joins below are with one row, or with counts that Spark sizes itself. The
    counts of hosts and the levels above them are written once, since each level is read
    for its strength and for its means.
    """
    labelled = hosts.join(outcomes, "page_id", "left")
    host = cut(with_levels(labelled.groupBy("host").agg(F.sum(F.coalesce("bad", F.lit(0))).alias("bad"), F.count("bad").alias("n"))))
    domain = cut(host.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    suffix = domain.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    root = suffix.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + PRIOR_RATE * PRIOR_COUNT) / (F.coalesce(F.sum("n"), F.lit(0)) + PRIOR_COUNT)).alias("p"))
    level = suffix.crossJoin(F.broadcast(root))
    mean = (F.col("bad") + F.col("m") * F.col("p")) / (F.col("n") + F.col("m"))
    level = level.crossJoin(F.broadcast(_strength(level, []))).select("suffix", mean.alias("p"))
    level = cut(domain.join(level, "suffix"))
    level = level.crossJoin(F.broadcast(_strength(level, []))).select("suffix", "domain", mean.alias("p"))
    level = cut(host.join(level, ["suffix", "domain"]))
    level = level.crossJoin(F.broadcast(_strength(level, []))).withColumn("mean", mean)
    weight = F.col("n") + F.col("m")
    return level.select("host", "mean", (F.col("mean") - F.lit(Z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + 1))).alias("low"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_rate_low) for each page."""
    urls = parsed(pages)
    known = reputations(urls, outcomes.groupBy("page_id").agg(F.max("bad").alias("bad")))
    name, verdict = rule_columns(rules)
    own = F.when(F.col("low") > BAD_RATE, "block").otherwise("allow")
    return urls.join(known, "host").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("mean", 6).alias("bad_rate"), F.round("low", 6).alias("bad_rate_low"))
