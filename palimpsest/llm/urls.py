"""URL filters: rules first, then the reputation of the host by empirical Bayes.

A page's outcome is its own: the quality rules' verdict on the text that its html shows (1 where they
reject it). Outcomes are counted by host, registered domain and suffix. Each level's
rate is a beta posterior whose prior is the posterior mean of the level above, worth as many
pages as the spread of the lower level's rates suggests (moments of a beta-binomial). A page is
blocked if the lower bound of its host's posterior is above the overall rate, or above a half where
that is less: at 95 %, its host is worse than pages are on the whole. The bound is that of the normal
with the posterior's mean and variance, which needs no quantile of the beta. Ports do not belong to a
domain; an address is its own domain and suffix.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by the overall rate; a host without labels takes the posterior of its domain or suffix; with
no labels at all everything is allowed; a page without html (null) has no outcome, one whose html shows no
text a bad one; repeated rows are judged alike; further columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality
from .graph import join_hot

#: Standard normal quantile of the one-sided bound (95 %), and the most that the rate to be above can be.
QUANTILE, MOST = 1.6449, 0.5
#: Least and most pages that a prior is worth.
WEIGHTS = (2.0, 50.0)

#: A suffix has two labels if it is one of these below a country's two letters; every other is the last label.
LONG_SUFFIX = r"(^|\.)(ac|co|com|edu|gov|ne|net|or|org)\.[a-z][a-z]$"
#: What html does not show, elements that begin a line, and all other tags, in the order in which they are replaced.
HIDDEN = (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<head\b.*?</head\s*>")
LINES, TAGS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|blockquote|pre)\b[^>]*>", r"<[/!]?[A-Za-z][^>]*>"
#: Character references, ``&`` last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
PORT, ADDRESS = r":[0-9]*$", r"^([0-9.]+|\[.*)$"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.char_length(rest) + 4)
    lowered = F.translate(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), lowered).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.char_length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def ruled(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and the rule's verdict; the longest rule wins, then the first named."""
    found = pages.withColumns({"host": host_of(F.coalesce(url, F.lit(""))), "path": path_of(F.coalesce(url, F.lit("")))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = _fits(r, F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return found.withColumns({"rule": rule, "rule_verdict": verdict})


def with_levels(hosts: DataFrame) -> DataFrame:
    """Adds the registered domain and the suffix of ``host``."""
    name = F.regexp_replace("host", PORT, "")
    long, address = name.rlike(LONG_SUFFIX), name.rlike(ADDRESS)
    last = lambda n: F.substring_index(name, ".", -n)
    domain = F.when(address, name).when(long, last(3)).otherwise(last(2))
    suffix = F.when(address, name).when(long, last(2)).otherwise(last(1))
    return hosts.withColumns({"domain": domain, "suffix": suffix})


def shown(html: Column) -> Column:
    """The text of ``html``, block elements on lines of their own."""
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, " ")
    html = F.regexp_replace(F.regexp_replace(html, LINES, "\n"), TAGS, "")
    for reference, character in REFERENCES:
        html = F.replace(html, F.lit(reference), F.lit(character))
    return html


def outcomes_of(pages: DataFrame) -> DataFrame:
    """(url, bad) of each page that has html: the quality rules judge what it shows."""
    seen = pages.where(F.col("html").isNotNull()).select("url", shown(F.col("html")).alias("text"))
    return quality.apply_rules(seen).select("url", (~F.col("kept")).cast("int").alias("bad"))


def _weight(counts: DataFrame) -> DataFrame:
    """One row: the pages a prior is worth, from the spread of the groups' rates."""
    sums = counts.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("spread")
    )
    rate = F.col("bad") / F.col("n")
    expected = F.col("n") - F.col("nn") / F.col("n")
    # Between-group share of the variance (intraclass correlation), held to the range of the weights.
    between = (F.col("spread") - F.col("bad") * rate) - (F.col("k") - 1) * rate * (1 - rate)
    rho = between / (rate * (1 - rate) * expected)
    weight = F.when((F.col("k") < 2) | (rate <= 0) | (rate >= 1) | (expected <= 0), F.lit(WEIGHTS[1])).otherwise(F.greatest(F.lit(WEIGHTS[0]), F.least(F.lit(WEIGHTS[1]), F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(WEIGHTS[1])))))
    return sums.select(weight.alias("weight"), F.coalesce(rate, F.lit(0.0)).alias("rate"))


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, bound, rate) for every distinct ``host`` of ``hosts``; ``outcomes`` has host and bad (0 or 1); the rate is overall.

    Everything past the first aggregate is one row a host or less. The three weights and the
    overall rate are single rows, which are the only things broadcast.
    """
    count = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_host = with_levels(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    by_domain, by_suffix = count(by_host, "suffix", "domain"), count(by_host, "suffix")
    everyone = with_levels(hosts.select("host").distinct())

    def posterior(rows: DataFrame, counts: DataFrame, keys: list[str], prior: str, to: str) -> DataFrame:
        weight = F.broadcast(_weight(counts).select("weight", "rate"))
        joined = rows.join(counts.select(*keys, "n", "bad"), keys, "left").na.fill(0, ["n", "bad"]).crossJoin(weight)
        before = F.col(prior) if prior else F.col("rate")
        return joined.withColumn(f"{to}_a", before * F.col("weight") + F.col("bad")).withColumn(f"{to}_n", F.col("weight") + F.col("n")).withColumn(to, F.col(f"{to}_a") / F.col(f"{to}_n")).drop("n", "bad", "weight", "rate")

    suffixes = posterior(everyone.select("suffix").distinct(), by_suffix, ["suffix"], "", "p_suffix").select("suffix", "p_suffix")
    domains = posterior(everyone.select("suffix", "domain").distinct().join(suffixes, "suffix"), by_domain, ["suffix", "domain"], "p_suffix", "p_domain").select("suffix", "domain", "p_domain")
    found = posterior(everyone.join(domains, ["suffix", "domain"]), by_host, ["host"], "p_domain", "p_host")
    spread = F.sqrt(F.col("p_host") * (1 - F.col("p_host")) / (F.col("p_host_n") + 1))
    return found.select("host", (F.col("p_host") - QUANTILE * spread).alias("bound")).crossJoin(F.broadcast(_weight(by_host).select("rate")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """Adds host, path, rule, bound and verdict to ``pages``; ``outcomes`` has url and bad."""
    found = ruled(pages.drop("bound", "rate", "verdict"), rules)
    labelled = outcomes.select(host_of(F.coalesce("url", F.lit(""))).alias("host"), "bad")
    bounds = reputations(found, labelled)
    verdict = F.coalesce("rule_verdict", F.when(F.col("bound") > F.least("rate", F.lit(MOST)), F.lit("block")).otherwise(F.lit("allow")))
    return join_hot(found, bounds, "host").withColumn("verdict", verdict).drop("rule_verdict", "rate")
