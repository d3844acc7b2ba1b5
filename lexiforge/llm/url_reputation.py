"""URL filter by host reputation, with rules that overrule it.

Labelled page outcomes (1 bad, 0 good) are counted per host, registered domain and suffix. A beta-binomial prior
shrinks each level towards the one above: suffix towards the whole, domain towards its suffix, host towards its
domain. The strength of each prior is estimated from the data by the method of moments. A page is blocked when the
lower bound of its host's posterior bad rate exceeds a limit, so a host with few labels is blocked only if its domain
or suffix is bad too. Everything is grouped sums and equi joins; hosts, domains and suffixes that hold many rows are
joined by broadcast, so that theirs do not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_frequent, materialize

#: (host, path prefix, verdict); fixed values of the rule list. The first part fits a host and its subdomains.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Second-level public suffixes under which names are registered; fixed values.
TWO_PART_SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk"]
#: One-sided 95 % bound, and the bad rate above which a host is blocked.
Z, BAD_RATE = 1.645, 0.5
#: Limits of a prior's strength, in labelled pages: a host with many more than the upper one is judged by its own.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first :// up to /, ? or #, with A-Z in lower case; empty without a scheme or for a null url."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_PART_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_PART_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Equally long rules: the first in code point order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def strength(units: DataFrame, parent_rate: str) -> float:
    """The prior's strength for units (n, bad) around their parents' rates.

    With p the parent's rate and s the strength: E[(bad - n p)^2] = n p (1 - p) (n + s) / (1 + s); summed over all units
    and solved for s. Units with one page say nothing about s. Where outcomes spread no more than chance makes them (or
    there is nothing to tell by), the prior is as strong as it gets.
    """
    v = F.col(parent_rate) * (1 - F.col(parent_rate))
    q, nn, n1 = units.where("n > 1").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col(parent_rate), 2)),
        F.sum(F.col("n") * F.col("n") * v),
        F.sum(F.col("n") * v),
    ).first()
    if q is None or q <= n1:
        return MOST_STRENGTH
    return min(max((nn - q) / (q - n1), LEAST_STRENGTH), MOST_STRENGTH)


def reputation(outcomes: DataFrame) -> tuple[float, dict[str, DataFrame]]:
    """The whole's rate, and posterior tables of labelled outcomes (host, bad in {0, 1}): suffixes, domains and hosts.

    Each table has its key, rate and pseudo-count, and is written once; only its prior's strength reaches the driver.
    Null hosts or outcomes are left out. Without any outcome the whole's rate is one half, which blocks nothing.
    """
    counts = [F.sum("n").alias("n"), F.sum("bad").cast("long").alias("bad")]
    hosts = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*counts))
    suffixes = materialize(domains.groupBy("suffix").agg(*counts))
    bad, n = suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    whole = (bad + 1) / (n + 2)

    def shrink(units: DataFrame, parent_rate: str, to: str) -> DataFrame:
        k = strength(units, parent_rate)
        total = F.lit(k) + F.col("n")
        return units.withColumns({to: (F.lit(k) * F.col(parent_rate) + F.col("bad")) / total, f"{to}_n": total})

    s = materialize(shrink(suffixes.withColumn("whole_rate", F.lit(whole)), "whole_rate", "suffix_rate").select("suffix", "suffix_rate", "suffix_rate_n"))
    # most domains have one of a few suffixes, and a domain can have most hosts
    d = materialize(join_frequent(domains, s.select("suffix", "suffix_rate"), "suffix"))
    d = materialize(shrink(d, "suffix_rate", "domain_rate").select("domain", "domain_rate", "domain_rate_n"))
    h = materialize(join_frequent(hosts, d.select("domain", "domain_rate"), "domain"))
    h = materialize(shrink(h, "domain_rate", "host_rate").select("host", "host_rate", "host_rate_n"))
    return whole, {"suffixes": s, "domains": d, "hosts": h}


def lower_bound(rate: Column, total: Column, z: float = Z) -> Column:
    """Normal approximation to the lower bound of a beta posterior with that mean and that many pseudo-counts."""
    return F.greatest(F.lit(0.0), rate - z * F.sqrt(rate * (1 - rate) / (total + 1)))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    z: float = Z,
    bad_rate: float = BAD_RATE,
) -> DataFrame:
    """pages (page_id, url, ...) with host, path, rule, verdict and bad_low, the posterior's lower bound.

    outcomes: (host, bad). A host without outcomes takes its domain's posterior, then its suffix's, then the whole's.
    A null or scheme-less url has an empty host and path, fits no rule and is allowed. Repeated rows get the same
    verdict each. Columns of pages by these names are replaced, others kept.
    """
    new = ["host", "path", "rule", "verdict", "bad_low", "domain", "suffix"]
    url = F.col("url")
    base = pages.drop(*new).withColumns({"host": host_of(url), "path": path_of(url)})
    whole, known = reputation(outcomes)
    # one row per distinct host: judged once, then joined back
    hosts = materialize(base.select("host").distinct().withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    hosts = join_frequent(join_frequent(hosts.join(known["hosts"], "host", "left"), known["domains"], "domain"), known["suffixes"], "suffix")
    rate = F.coalesce("host_rate", "domain_rate", "suffix_rate", F.lit(whole))
    total = F.coalesce("host_rate_n", "domain_rate_n", "suffix_rate_n", F.lit(0.0))
    hosts = materialize(hosts.select("host", lower_bound(rate, total, z).alias("bad_low")))
    out = join_frequent(base, hosts, "host")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when((F.col("host") != "") & (F.col("bad_low") > bad_rate), "block").otherwise("allow")
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_method)})
