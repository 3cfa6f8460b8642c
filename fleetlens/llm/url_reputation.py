"""URL verdicts: fixed rules first, then the reputation of the host.

The reputation is an empirical-Bayes estimate of the rate of bad pages. Labelled outcomes are
counted per host, registered domain and suffix. Each level is a beta-binomial whose prior is
centred on the posterior mean of the level above; how strongly it pulls follows from how much the
groups of that level differ (method of moments). A page is blocked when the lower bound of its
host's posterior lies above the accepted rate, so little evidence never blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.skew import join_checked
from fleetlens.sources.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names under which two-letter country suffixes register domains.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "or", "org"]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NO_DOMAIN = r"^([0-9.]*|\[.*)(:[0-9]*)?$"
#: Bounds of the correlation of outcomes within a group.
LEAST_RHO, MOST_RHO = 1e-3, 0.5

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _is_country(host: Column) -> Column:
    """True for hosts such as ``a.co.uk``, whose suffix has two labels."""
    second = F.substring_index(host, ".", -2)
    below = F.substring_index(second, ".", 1)
    return (F.length(F.substring_index(host, ".", -1)) == 2) & below.isin(SECOND_LEVEL) & (second != host)


def suffix_of(host: Column) -> Column:
    """The last label, or the last two below a country; addresses are their own suffix."""
    labels = F.when(_is_country(host), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    return F.when(host.rlike(NO_DOMAIN), host).otherwise(labels)


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    labels = F.when(_is_country(host), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(host.rlike(NO_DOMAIN), host).otherwise(labels)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule (verdict, host, path) that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[2]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host of ``pages`` (page_id, host): n_labelled, n_bad, bad_rate, bad_rate_low.

    ``outcomes`` holds page_id and bad (boolean). Of several outcomes of a page the worst counts;
    rows without id or outcome count for nothing. Hosts without labelled pages stand where their
    domain stands, without any labels at all at rate one half.
    """
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        pages.join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.count_if("bad"), F.lit(0)).alias("b"))
        .withColumn("suffix", suffix_of(F.col("host")))
        .withColumn("domain", domain_of(F.col("host")))
    )
    hosts = stored(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    n, b = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()

    suffixes = _shrunk(suffixes.withColumn("prior", F.lit((b + 0.5) / (n + 1.0))))
    above = suffixes.select("suffix", F.col("rate").alias("prior"))
    domains = _shrunk(join_checked(domains, above, ["suffix"], "inner", ["domain"]))
    above = domains.select("domain", "suffix", F.col("rate").alias("prior"))
    hosts = _shrunk(join_checked(hosts, above, ["domain", "suffix"], "inner", ["host"]))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return hosts.select(
        "host", F.col("n").alias("n_labelled"), F.col("b").alias("n_bad"), F.col("rate").alias("bad_rate"),
        F.greatest(F.lit(0.0), F.col("rate") - z * spread).alias("bad_rate_low"),
    )


def _shrunk(groups: DataFrame) -> DataFrame:
    """Posterior mean ``rate`` of groups with n, b and the mean ``prior`` of their prior."""
    groups = stored(groups, "level")
    wide = F.col("prior") * (1 - F.col("prior"))
    n, b = F.col("n"), F.col("b")
    apart, alone, pairs = groups.agg(
        F.sum((b - n * F.col("prior")) * (b - n * F.col("prior"))), F.sum(n * wide), F.sum(n * (n - 1) * wide)
    ).first()
    rho = (apart - alone) / pairs if pairs else MOST_RHO
    strength = 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1
    return groups.withColumn("strength", F.lit(strength)).withColumn(
        "rate", (b + strength * F.col("prior")) / (n + strength)
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], most_bad: float = 0.25, z: float = 1.645
) -> DataFrame:
    """Verdict on every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict and the evidence.

    A null url, or one without ``://``, has empty host and path; such pages share the host ``''``.
    Repeated rows, and rows without page_id, are judged like any other. Empty tables give an empty
    result. Other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = host_reputation(read.select("page_id", "host"), outcomes, z)
    hosts = stored(hosts, "reputation")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_rate_low") > most_bad, "block").otherwise("allow")
    return join_checked(read, hosts, ["host"], "left", ["page_id", "path"]).select(
        "page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        "n_labelled", "n_bad", F.round("bad_rate_low", 6).alias("bad_rate_low"),
    )
