"""URL filters by empirical-Bayes host reputation, with rules that go before it. DataFrame operations only.

Labelled outcomes of pages (good or not) are counted by host, and shrunk through beta-binomial priors: a suffix towards
all pages, a registered domain towards its suffix's posterior mean, a host towards its domain's. The strength of each
level's prior is a moment estimate of the overdispersion of its units around their parents' means. A host is allowed if
the lower bound of its posterior, `z` standard deviations below the mean, reaches a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Public suffixes of two labels that the reputation keeps together.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "co.kr")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host and the start of a path, as "host/path", and whether it is allowed."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class Reputation:
    """z and threshold of the posterior bound; bounds of a prior's strength, as rho = 1 / (strength + 1)."""

    z: float = 1.645
    threshold: float = 0.5
    least_rho: float = 0.001
    most_rho: float = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains where the path starts with its own."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked for first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, three under a suffix of two; a host of one label, or an address, is its own."""
    name = F.regexp_replace(host, r":\d*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when(name.rlike(r"^\d+(\.\d+){3}$"), name).when(last(2).isin(*DOUBLE_SUFFIXES), last(3)).otherwise(last(2))


def suffix_of(domain: Column) -> Column:
    """What follows the first label of a registered domain; empty without a dot."""
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(F.lit(""))


def _shrunk(units: DataFrame, parents: DataFrame | None, on: str, overall: float, options: Reputation) -> DataFrame:
    """units (n, k, ...) with a and b of their posterior, their prior being the parent's posterior mean."""
    units = units.withColumn("mu", F.lit(overall)) if parents is None else units.join(parents.select(on, (F.col("a") / (F.col("a") + F.col("b"))).alias("mu")), on)
    v = F.col("mu") * (1 - F.col("mu"))
    seen = units.filter("n > 0").agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("mu"), F.lit(2.0)) / F.col("n")).alias("s"), F.sum(v).alias("v"), F.sum(v * (F.col("n") - 1)).alias("w")).first()
    rho = (seen["s"] - seen["v"]) / seen["w"] if seen["w"] else options.most_rho
    strength = 1 / round(min(max(rho, options.least_rho), options.most_rho), 9) - 1
    return units.withColumns({"a": F.col("k") + strength * F.col("mu"), "b": F.col("n") - F.col("k") + strength * (1 - F.col("mu"))}).drop("mu")


def reputations(outcomes: DataFrame, options: Reputation = Reputation()) -> DataFrame:
    """(host, n, k, a, b, mean, bound) of every host in outcomes (host, good): good is boolean, null where not labelled.

    Hosts with no labelled page have the posterior of their domain's prior. Without any label at all the mean is 0.5.
    """
    hosts, _ = stored(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    suffixes = _shrunk(suffixes, None, "", overall, options)
    domains = _shrunk(domains, suffixes, "suffix", overall, options)
    hosts = _shrunk(hosts, domains, "domain", overall, options)
    n = F.col("a") + F.col("b")
    mean = F.col("a") / n
    return hosts.select("host", "n", "k", "a", "b", mean.alias("mean"), (mean - options.z * F.sqrt(mean * (1 - mean) / (n + 1))).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = (), options: Reputation = Reputation(), key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict (allow or block), bound.

    outcomes: (key, good), one row per labelled page; rows with a null key or outcome count as not labelled. The verdict
    is the rule's, or else the host's. Urls that are null or have no :// share the empty host. A host with a large share of
    the pages is aggregated map-side; joins are left to adaptive execution, which broadcasts small host tables after
    measuring them and splits skewed partitions otherwise.
    """
    rows = pages.select(F.col(key).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = outcomes.select(F.col(key).alias("id"), F.col("good")).filter("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
    by_host = reputations(rows.select("id", "host").join(known, "id", "left"), options)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    allowed = {r.text: r.allow for r in rules}
    verdict = F.when(F.col("bound") >= options.threshold, F.lit("allow")).otherwise(F.lit("block"))
    for text, allow in allowed.items():
        verdict = F.when(F.col("rule") == text, F.lit("allow" if allow else "block")).otherwise(verdict)
    return rows.withColumn("rule", rule).join(by_host.select("host", "bound"), "host", "left").select(F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.round("bound", 6).alias("bound"))
