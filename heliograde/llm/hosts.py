"""URL filters: allow and block rules, and an empirical-Bayes reputation of hosts where no rule fits.

Labelled pages give each host a count of good and bad outcomes. The rate of bad outcomes of a host is shrunk towards that of
its registered domain, the domain's towards that of its suffix and the suffix's towards that of the whole web, each with
a beta prior whose strength is estimated from how much the children of that level differ (method of moments). A host is blocked if the
lower posterior bound of its rate is above a limit. Hosts are aggregated before they are joined to pages, so a hot host is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict and rule, a host and a path prefix.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

LIMIT = 0.5  # block above this lower bound of the rate of bad pages
DEVIATIONS = 1.645  # of the posterior below its mean: about the 5 % quantile
LEAST, MOST = 2.0, 200.0  # bounds of the estimated prior strength, in pages


def host_of(url: Column | str) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column | str) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer rule is put around shorter ones
        at = text.index("/")
        name, prefix = text[:at], text[at:]
        fits = ((host == name) | host.endswith(F.lit("." + name))) & path.startswith(F.lit(prefix))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """The last two labels of a host. Suffixes of more than one label count as part of the domain."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(children: DataFrame, parent: list[str]) -> DataFrame:
    """One row: the prior strength for children under their parents, from the spread of their rates beyond chance."""
    total = children.groupBy(*parent).agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb"), F.sum("c2").alias("p2"), F.sum("n2").alias("q2"), F.count(F.lit(1)).alias("k"))
    total = total.filter("k > 1 AND pb > 0 AND pb < pn")
    # sum of n (rate - parent rate)^2 = sum bad^2/n - pb^2/pn; its expectation is m(1-m) (k-1 + (pn - sum n^2/pn) rho)
    spread = F.col("p2") - F.col("pb") * F.col("pb") / F.col("pn")
    base = F.col("pb") * (F.col("pn") - F.col("pb")) / (F.col("pn") * F.col("pn")).cast("double")
    sums = total.agg(F.sum(spread).alias("s"), F.sum(base * (F.col("k") - 1)).alias("e"), F.sum(base * (F.col("pn") - F.col("q2") / F.col("pn"))).alias("d"))
    rho = (F.col("s") - F.col("e")) / F.col("d")
    return sums.select(F.when((F.col("d") > 0) & (rho > 0), F.least(F.lit(MOST), F.greatest(F.lit(LEAST), 1 / rho - 1))).otherwise(F.lit(MOST)).alias("strength"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, pages, bad_pages, rate, lower): posterior mean and lower bound of every labelled host.

    ``outcomes`` has (host, bad 0 or 1, null if unlabelled). Without any labelled page the result is empty.
    """
    hosts = outcomes.filter("bad IS NOT NULL AND host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    # for single-label hosts the host, its domain and its suffix have one name
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    squares = lambda d: d.withColumn("c2", F.col("bad") * F.col("bad") / F.col("n")).withColumn("n2", (F.col("n") * F.col("n")).cast("double"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    top = suffixes.agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb")).filter("tn > 0").select(((F.col("tb") + 0.5) / (F.col("tn") + 1.0)).alias("m0"))
    levels = [(squares(suffixes), []), (squares(domains), ["suffix"]), (squares(hosts), ["domain"])]
    ks = None
    for i, (level, parent) in enumerate(levels):
        one = _strength(level, parent).withColumnRenamed("strength", f"s{i}").withColumn("one", F.lit(1))
        ks = one if ks is None else ks.join(one, "one")
    prior = top.withColumn("one", F.lit(1)).join(ks, "one")
    mean = lambda m, s: (F.col("bad") + F.col(s) * F.col(m)) / (F.col("n") + F.col(s))
    suffixes = suffixes.withColumn("one", F.lit(1)).join(prior, "one").select("suffix", mean("m0", "s0").alias("m1"), "s1", "s2")
    domains = domains.join(suffixes, "suffix").select("domain", mean("m1", "s1").alias("m2"), "s2")
    a = F.col("bad") + F.col("s2") * F.col("m2")
    n = F.col("n") + F.col("s2")
    rate = a / n
    lower = F.greatest(F.lit(0.0), rate - F.lit(DEVIATIONS) * F.sqrt(rate * (1 - rate) / (n + 1)))
    return hosts.join(domains, "domain").select("host", F.col("n").alias("pages"), F.col("bad").alias("bad_pages"), rate.alias("rate"), lower.alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, ident: str = "page_id", url: str = "url", rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(ident, host, path, rule, verdict, rate, lower) for every row of ``pages``.

    The longest rule decides; without one, a host whose lower bound is above ``limit`` is blocked, every other is
    allowed, also hosts without labelled pages, null urls and urls without ://. Repeated rows stay; empty pages give none.
    """
    host, path = host_of(url), path_of(url)
    base = pages.select(F.col(ident), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rep = reputation(outcomes).select(F.col("host").alias("__h"), "rate", "lower")
    out = base.join(rep, F.col("host") == F.col("__h"), "left")
    own = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return out.select(ident, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "rate", "lower")


def page_outcomes(pages: DataFrame, labels: DataFrame, url: str = "url", label_id: str = "doc_id") -> DataFrame:
    """(host, bad) of every page whose path ends in the number of a labelled document: bad if of low quality or toxic."""
    number = F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    own = pages.select(host_of(url).alias("host"), F.when(number != "", number).cast("bigint").alias("doc"))
    marks = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc"))
    marks = marks.agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return own.filter("doc IS NOT NULL").join(marks, "doc").select("host", "bad")
