"""URL filters with empirical-Bayes host reputation, in DataFrame functions only.

A rule is (host, path, verdict): it fits its host and all subdomains if the url's path
starts with the rule's; the longest fitting rule wins (of two as long, that of the longer
host).  The labelled outcomes are the pages of hosts that some rule's host fits: bad if a rule
blocks them, else good; a rule that can only block stands for the paths it names, not for
the whole host, whose other pages are outcomes too.  Pages without a rule are judged by the
reputation of their host:

* bad and labelled pages are counted per host, registered domain (last two labels), suffix
  (last label) and over all;
* each level's rates are shrunk towards its parent's posterior mean by a beta prior.  The
  prior's strength is fitted per level from the beta-binomial overdispersion: with
  E(b - n m)^2 = n m (1 - m) (1 + (n - 1) rho), strength = 1 / rho - 1; no prior is stronger
  than the labelled pages behind it, those of the parent, and one;
* the variance of a posterior is its own and, by the squared weight of the prior, that of its
  parent, so a host without outcomes is as unsure as its domain and more;
* a page is blocked if the lower bound of its host's posterior bad rate (mean - z * standard
  deviation) is above ``THRESHOLD``; else it is allowed.

Only counts by host leave the scan; pages meet their host's verdict in one join, whose hot
hosts Spark may split.

Cases: a null url or one without ``://`` has an empty host and path, which no rule fits; it
shares the reputation of the empty host.  Without labelled outcomes the overall rate is the
prior 1/2 and nothing is blocked.  Repeated rows count each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

from .common import need, written

# Fixed values of the contract: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
Z = 1.645
THRESHOLD = 0.5
MOST = 1000.0    # strongest prior, in pages
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def in_scope(host: Column, rules) -> Column:
    """Whether some rule's host is the page's or one above it."""
    test = F.lit(False)
    for h in sorted({h for h, _, _ in rules}):
        test = test | (host == h) | host.endswith("." + h)
    return test


def _shrunk(rows: DataFrame) -> DataFrame:
    """``rows(n, b)`` with the parent's (m, v, behind: mean, variance, labelled pages) to the
    posterior's ``mean`` and ``var``."""
    spread = F.col("m") * (1 - F.col("m"))
    over, pairs = rows.agg(F.sum(F.pow(F.col("b") - F.col("n") * F.col("m"), F.lit(2.0)) - F.col("n") * spread),
                           F.sum(F.col("n") * (F.col("n") - 1) * spread)).first()
    rho = min(0.99, max(1 / (1 + MOST), over / pairs)) if pairs else 0.5
    k = F.least(F.lit(1 / rho - 1 if pairs else 1.0), F.col("behind") + 1)
    mean = (F.col("b") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k"))
    own = F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("k") + 1)
    return rows.withColumn("k", k).withColumn("mean", mean).withColumn(
        "var", own + F.pow(F.col("k") / (F.col("n") + F.col("k")), F.lit(2.0)) * F.col("v"))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``hosts(host, n, b)``, one row per host with its labelled and bad pages, to
    (host, mean, bound): posterior mean of the bad rate and its lower bound."""
    label = F.split("host", r"\.")
    hosts = (hosts.withColumn("suffix", F.element_at(label, -1))
             .withColumn("domain", F.array_join(F.slice(label, F.greatest(F.lit(1), F.size(label) - 1), 2), ".")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    bad, all_ = suffixes.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rate = (bad + 0.5) / (all_ + 1.0)
    above = lambda df, key: df.select(key, F.col("mean").alias("m"), F.col("var").alias("v"), F.col("n").alias("behind"))
    suffixes = _shrunk(suffixes.withColumns({"m": F.lit(rate), "v": F.lit(rate * (1 - rate) / (all_ + 2.0)), "behind": F.lit(all_)}))
    domains = _shrunk(domains.join(above(suffixes, "suffix"), "suffix"))
    hosts = _shrunk(hosts.join(above(domains, "domain"), "domain"))
    return hosts.select("host", "mean", (F.col("mean") - F.lit(Z) * F.sqrt("var")).alias("bound"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages(page_id, url)``."""
    host, path = host_and_path(F.col("url"))
    rows = need(pages, page_id="bigint", url="string").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    hosts = written(rows.groupBy("host").agg(F.count(F.when(in_scope(F.col("host"), rules), 1)).alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b")), "hosts")
    judged = host_reputation(hosts).select("host", F.when(F.col("bound") > THRESHOLD, "block").otherwise("allow").alias("learned"))
    return rows.join(judged, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _level(name: str, parent: str, on: str) -> str:
    return f"""
{name}_m AS (SELECT x.*, p.mean AS m, p.var AS v, p.n AS behind FROM {name} x {on.format(parent=parent)}),
{name}_k AS (SELECT CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN 1 / least(0.99, greatest(1 / 1001.0::DOUBLE,
   sum(pow(b - n * m, 2) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)))) - 1 ELSE 1.0 END AS top FROM {name}_m),
{name}_l AS (SELECT x.*, least(top, behind + 1)::DOUBLE AS k FROM {name}_m x, {name}_k),
{name}_p AS (SELECT *, (b + k * m) / (n + k) AS mean FROM {name}_l),
{name}_s AS (SELECT * EXCLUDE (m, v, behind, k), mean * (1 - mean) / (n + k + 1) + pow(k / (n + k), 2) * v AS var FROM {name}_p),"""


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
q AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
h AS (SELECT host, string_split(host, '.') AS x, count(*) FILTER (host IN ('com', 'net') OR ends_with(host, '.com') OR ends_with(host, '.net')) AS n, count(*) FILTER (ruled = 'block') AS b FROM q GROUP BY host),
hosts AS (SELECT host, x[-1] AS suffix, array_to_string(x[-2:], '.') AS domain, n, b FROM h),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY ALL),
rate AS (SELECT (coalesce(sum(b), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS mean, coalesce(sum(n), 0) AS n FROM suffixes),
whole AS (SELECT *, mean * (1 - mean) / (n + 2.0::DOUBLE) AS var FROM rate),
""" + _level("suffixes", "whole", ", {parent} p") + _level("domains", "suffixes_s", "JOIN {parent} p USING (suffix)") \
    + _level("hosts", "domains_s", "JOIN {parent} p USING (domain)").rstrip(",") + r"""
SELECT page_id, host, path, rule, coalesce(ruled,
   CASE WHEN mean - 1.645 * sqrt(var) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM q JOIN (SELECT host, mean, var FROM hosts_s) USING (host)
"""
