"""URL filter: rules first, else the reputation of the host by empirical Bayes.

Labelled page outcomes are counted per host, registered domain and suffix.  Each level is a beta-binomial whose
prior is its parent: strength from the spread between siblings (method of moments), mean from the parent's posterior.
A host is blocked if the lower bound of its posterior share of bad pages is above ``max_bad``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.llm.common import cut

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
MAX_BAD, Z = 0.3, 1.645
LEAST_RHO, MOST_RHO = 0.001, 0.5


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    az = "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(rest, az.upper(), az), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """Suffix and one label more."""
    return F.when(suffix.contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null without one."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _strength(children: DataFrame, parent: str) -> DataFrame:
    """One row ``s``: prior strength of a level, from its groups (n, bad) and the ``parent`` mean of each."""
    q = F.col(parent)
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - q, 2) / (q * (1 - q))
    seen = children.where("n > 0").agg(F.sum(spread).alias("x"), F.count("*").alias("k"), F.sum("n").alias("n"))
    rho = F.when(F.col("n") > F.col("k"), (F.col("x") - F.col("k")) / (F.col("n") - F.col("k"))).otherwise(MOST_RHO)
    return seen.select((1 / F.least(F.greatest(rho, F.lit(LEAST_RHO)), F.lit(MOST_RHO)) - 1).alias("s"))


def host_reputation(pages: DataFrame, max_bad: float = MAX_BAD, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, bad boolean or null) per page -> one row per host: n, bad, mean, bound, verdict.

    A host without labelled pages has its domain's posterior as prior and nothing else; without any label at all
    the overall mean is a half, and bounds stay below it.  The empty host is a host like any other.
    """
    counts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    suffix = suffix_of(F.col("host"), suffixes)
    hosts = cut(counts.select("host", domain_of(F.col("host"), suffix).alias("domain"), suffix.alias("suffix"), "n", "bad"))
    total = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("p")).first()["p"] or 0.5

    def fold(level: DataFrame, by: list[str]) -> DataFrame:
        return level.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def posterior(level: DataFrame) -> DataFrame:
        s = _strength(level, "prior").first()["s"]
        return level.select("*", F.lit(s).alias("s")).withColumn("mean", (F.col("bad") + F.col("s") * F.col("prior")) / (F.col("n") + F.col("s")))

    domains = cut(fold(hosts, ["suffix", "domain"]))
    tops = posterior(cut(fold(domains, ["suffix"]).withColumn("prior", F.lit(float(total)))))
    domains = posterior(cut(domains.join(tops.select("suffix", F.col("mean").alias("prior")), "suffix")))
    out = posterior(cut(hosts.join(domains.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"])))
    a, b = F.col("bad") + F.col("s") * F.col("prior"), F.col("n") - F.col("bad") + F.col("s") * (1 - F.col("prior"))
    bound = F.col("mean") - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return out.withColumn("bound", bound).select("host", "n", "bad", "mean", "bound", F.when(F.col("bound") > max_bad, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """Pages (page_id, url) and outcomes (page_id, bad boolean) -> one row per page row: page_id, host, path, rule, verdict.

    A page listed more than once in ``outcomes`` is bad if any of its rows is; null outcomes and ids tell nothing.
    Null urls and urls without ``://`` have an empty host and path.  Repeated page rows count and are judged each.
    """
    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = host_reputation(own.select("page_id", "host").join(known, "page_id", "left"), max_bad, z)
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    found = own.join(hosts.select("host", F.col("verdict").alias("by_host"), "bound"), "host")
    return found.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, "by_host").alias("verdict"))
