"""URL filters: rules first, then empirical-Bayes host reputation. DataFrame functions only.

A rule is (host, path, verdict); it fits its host and all subdomains if the url's path starts with its path, and
the longest that fits wins. Pages that a rule decides are labelled outcomes (allow: good). Their counts are
pooled by suffix (the last label, or two that are one of SUFFIXES), registered domain (the suffix and a label more) and host. Each level is a beta-binomial
whose prior is centred on the level above: a suffix shrinks to the overall rate, a domain to its suffix, a host to
its domain. The strength of each prior is fitted to that level's counts by moments. A page without a rule is
blocked if the upper bound of its host's good rate (posterior mean + z standard deviations) is below the limit:
only where the evidence is clear.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end.
A null url, or one without `://`, has an empty host and path, no rule, and the reputation of the host ''.
Repeated pages come out as often; an empty table gives no rows. Of rules that are equally long, the last in the list wins.
The pages are read twice. First, counts by host are shuffled, summed before. Then each page gets its host's bound: of hosts
that have more than one in HOT of all pages (so HOT at most) from a constant, of the others by a join, in which no host
is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut

#: Host, path and verdict of the production rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which domains are registered.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "or.jp", "ne.jp", "co.kr", "com.br", "com.mx", "com.ar", "com.cn", "com.tw", "com.tr"]
#: The part of all pages (one in so many) from which a host is looked up instead of joined.
HOT = 200
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def url_host(url: Column) -> Column:
    """The host, or ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """The path, or ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def with_levels(hosts: DataFrame) -> DataFrame:
    """Adds the registered domain and the suffix of `host`."""
    two = F.substring_index("host", ".", -2)
    long = two.isin(SUFFIXES)
    return hosts.withColumns({"domain": F.when(long, F.substring_index("host", ".", -3)).otherwise(two), "suffix": F.when(long, two).otherwise(F.substring_index("host", ".", -1))})


def strength(groups: DataFrame, prior: float | Column) -> float:
    """A prior's strength by moments: what the groups' rates vary beyond binomial noise. One row reaches the driver."""
    n, g = F.col("n").cast("double"), F.col("good").cast("double")
    m = F.lit(prior) if isinstance(prior, float) else prior
    noise, spread = F.sum(m * (1 - m)), F.sum(n * (g / n - m) * (g / n - m))
    weight, count = F.sum("n"), F.count("*")
    noise, spread, weight, count = groups.where("n > 0").agg(noise, spread, weight, count).first()
    if not count or weight <= count or not noise:
        return WEAKEST
    # E[spread] = noise * (1 + (weight / count - 1) * rho), with rho = 1 / (strength + 1)
    rho = (float(spread) / float(noise) - 1) / (float(weight) / count - 1)
    return STRONGEST if rho <= 1 / (STRONGEST + 1) else min(max(1 / rho - 1, WEAKEST), STRONGEST)


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: host, n (labelled pages), good, and pages if wanted, one row for each host (n may be 0). Adds mean and deviation of the
    host's posterior good rate."""
    hosts = with_levels(outcomes)
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (float(good or 0) + 1) / (float(n or 0) + 2)
    up = lambda prior, k: (F.col("good") + k * prior) / (F.col("n") + k)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    ks = strength(suffixes, overall)
    suffixes = suffixes.select("suffix", up(F.lit(overall), ks).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix")
    kd = strength(domains, F.col("suffix_mean"))
    domains = domains.select("domain", up(F.col("suffix_mean"), kd).alias("domain_mean"))
    hosts = hosts.join(domains, "domain")
    kh = strength(hosts, F.col("domain_mean"))
    a, b = F.col("good") + kh * F.col("domain_mean"), F.col("n") - F.col("good") + kh * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    return hosts.select(*[c for c in ("host", "n", "good", "pages") if c in outcomes.columns], mean.alias("mean"), F.sqrt(mean * (1 - mean) / (a + b + 1)).alias("deviation"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (upper bound of the host's good rate) of each page."""
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", name.alias("rule"), verdict.alias("ruled"))
    outcomes = cut(judged.groupBy("host").agg(F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count("*").alias("pages")))
    bounds = cut(reputation(outcomes).select("host", "pages", F.round(F.least(F.lit(1.0), F.col("mean") + z * F.col("deviation")), 9).alias("score")))
    total = bounds.agg(F.sum("pages")).first()[0] or 0
    hot = {r["host"]: r["score"] for r in bounds.where(F.col("pages") * HOT > total).select("host", "score").collect()}
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]) if hot else F.create_map().cast("map<string,double>"), F.col("host"))
    # Pages of hot hosts find nothing in the join, each in another of many places.
    key = F.when(F.col("host").isin(list(hot)), F.concat(F.lit("\0"), F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 20)).cast("string"))).otherwise(F.col("host"))
    judged = judged.withColumn("key", key).join(bounds.select(F.col("host").alias("key"), F.col("score").alias("joined")), "key", "left").withColumn("score", F.coalesce(known, "joined"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") < limit, "block").otherwise("allow")).alias("verdict"), "score")
