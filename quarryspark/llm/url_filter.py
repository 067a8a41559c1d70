"""URL filter: rules, then empirical-Bayes host reputation.

Labelled outcomes (1 good, 0 bad) are counted by host, registered domain and suffix. For these levels user info
and port are taken off; the suffix is the last label, with the one before if that is one of ``SECOND`` and
the last has two letters (``co.uk``); the registered domain is one label more; an address (numbers and
dots, or brackets) is its own domain, with the suffix ``address``. Suffixes that registries name
otherwise are not known: hosts below them share a domain. Each level's success rates are shrunk to the level
above by a beta-binomial prior whose mean is the parent's posterior mean and whose strength
is the level's own, estimated from all of its groups by the method of moments:

    strength = (S - V) / (V - S / n~),  S = mean p(1-p), V = variance of rates around parents

bounded to [1, 1e6]. A host is allowed when the lower bound of its posterior, mean - z * sd,
reaches ``floor``; hosts without labelled pages take their domain's posterior, then their
suffix's, then that of all pages.

Rules name a host with all of its subdomains and a path prefix; the longest that fits wins
(over both parts, then the first given) and overrides the reputation.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule; it
has no levels and takes the reputation of all pages; user info and ports stay parts of the given host; urls of any
length are read whole; repeated rows each get their verdict; without any labels the prior is 1/2 with strength 1; an
empty table gives an empty result; other columns are ignored. Hot hosts are one row per task
before any shuffle, and in the join of pages with hosts these are broadcast if they are counted to be few, else hot ones are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.common import meet, spill

#: (verdict, host, path prefix) of the registered query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Second labels that belong to the suffix under a two-letter label.
SECOND = ("co", "com", "org", "net", "gov", "edu", "ac", "ne", "or", "go")
#: A registered domain (group 0) and its suffix (group 2).
DOMAIN = r"([^.]+\.)?((?:" + "|".join(SECOND) + r")\.[a-z][a-z]|[^.]+)$"
ADDRESS = r"^(\[.*\]|[0-9.]+)$"
#: Posterior bound below which a host is blocked, and standard deviations from mean to bound.
FLOOR, Z = 0.6, 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, both null when none does."""
    text = verdict = None
    for kind, own, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        text = F.when(fits, own + prefix) if text is None else text.when(fits, own + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"),) * 2 if text is None else (text, verdict)


def _shrunk(level: DataFrame, parent: DataFrame, key: str, up: str) -> DataFrame:
    """key, a, b: the beta posterior of each group of ``level`` (key, up, n, k) under its parent's mean."""
    own = level.join(parent.select(F.col("key").alias(up), (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), up)
    rate = F.col("k") / F.col("n")
    s, v, inverse = F.avg(F.col("m") * (1 - F.col("m"))), F.avg((rate - F.col("m")) * (rate - F.col("m"))), F.avg(1 / F.col("n"))
    s, v, i = own.agg(s, v, inverse).first()
    w = 1e6 if s is None or v <= s * i else max(1.0, min(1e6, (s - v) / (v - s * i)))
    return own.select(F.col(key).alias("key"), (F.col("m") * w + F.col("k")).alias("a"), ((1 - F.col("m")) * w + F.col("n") - F.col("k")).alias("b"))


def reputation(hosts: DataFrame) -> DataFrame:
    """host, domain, suffix, n, k -> level, key, a, b: the posteriors of all levels, '' being all pages."""
    everything = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(F.lit("").alias("key"), (F.lit(0.5) + F.coalesce("k", F.lit(0))).alias("a"), (F.lit(0.5) + F.coalesce(F.col("n") - F.col("k"), F.lit(0))).alias("b"))
    total = lambda *keys: hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix = spill(_shrunk(total("suffix").withColumn("top", F.lit("")), everything, "suffix", "top"), "suffixes")
    domain = spill(_shrunk(total("domain", "suffix"), suffix, "domain", "suffix"), "domains")
    host = _shrunk(total("host", "domain"), domain, "host", "domain")
    named = [df.select(F.lit(name).alias("level"), "key", "a", "b") for name, df in (("all", everything), ("suffix", suffix), ("domain", domain), ("host", host))]
    return spill(named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3]), "reputation")


def levels(host: Column) -> tuple[Column, Column]:
    site = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address = F.regexp_like(site, F.lit(ADDRESS))
    return F.when(address, site).otherwise(F.regexp_extract(site, DOMAIN, 0)), F.when(address, "address").otherwise(F.regexp_extract(site, DOMAIN, 2))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation of (page_id, url); outcomes: (page_id, good 0/1)."""
    host, path = host_and_path(F.col("url").cast("string"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumns(dict(zip(("domain", "suffix"), levels(F.col("host")))))
    counted = spill(seen.join(outcomes.select(F.col("page_id").alias("labelled"), "good"), F.col("page_id") == F.col("labelled")).where("host != ''").groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k")), "hosts")
    found = reputation(counted)
    hosts = seen.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"))
    for level in ("host", "domain", "suffix"):
        own = found.where(F.col("level") == level).select(F.col("key").alias(level), F.struct("a", "b").alias(f"{level}_ab"))
        hosts = hosts.join(own, level, "left")
    base = F.struct(*(F.lit(x) for x in found.where("level = 'all'").select("a", "b").first()))
    ab = F.coalesce("host_ab", "domain_ab", "suffix_ab", base.cast("struct<a:double,b:double>"))
    a, b = ab["a"], ab["b"]
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    hosts = spill(hosts.select("host", "n", bound.alias("reputation")), "bounds")
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    return meet(seen, hosts, ["host"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, F.when(F.col("reputation") >= floor, "allow").otherwise("block")).alias("verdict"), F.round("reputation", 6).alias("reputation"))


_SHRINK = """
{name}_m AS (SELECT c.{key}, c.n, c.k, p.a / (p.a + p.b) AS m FROM (SELECT {key}, {up}, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL) c JOIN {parent} p ON c.{up} = p.key),
{name}_w AS (SELECT CASE WHEN v > s * i THEN greatest(1.0::DOUBLE, least(1e6, (s - v) / (v - s * i))) ELSE 1e6 END AS w
  FROM (SELECT avg(m * (1 - m)) AS s, avg((k / n - m) * (k / n - m)) AS v, avg(1 / n) AS i FROM {name}_m)),
{name}_p AS (SELECT {key} AS key, m * w + k AS a, (1 - m) * w + n - k AS b FROM {name}_m, {name}_w),"""


def oracle(rules=RULES, floor: float = FLOOR, z: float = Z) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(k, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for k, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for _, t, c in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, _, c in fits) + " END"
    chain = "".join(_SHRINK.format(name=n, key=n, up=u, parent=p) for n, u, p in (("suffix", "top", "everything"), ("domain", "suffix", "suffix_p"), ("host", "domain", "domain_p")))
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
sites AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM seen),
keyed AS (SELECT page_id, host, path, CASE WHEN regexp_matches(site, '{ADDRESS}') THEN site ELSE regexp_extract(site, '{DOMAIN}', 0) END AS domain,
  CASE WHEN regexp_matches(site, '{ADDRESS}') THEN 'address' ELSE regexp_extract(site, '{DOMAIN}', 2) END AS suffix FROM sites),
hosts AS (SELECT host, domain, suffix, '' AS top, count(*)::DOUBLE AS n, sum(l.quality)::DOUBLE AS k FROM keyed JOIN labels l ON l.doc_id = page_id WHERE host <> '' AND l.quality IS NOT NULL GROUP BY ALL),
everything AS (SELECT '' AS key, 0.5 + coalesce(sum(k), 0) AS a, 0.5 + coalesce(sum(n) - sum(k), 0) AS b FROM hosts),{chain}
ab AS (SELECT d.host, coalesce(h.a, o.a, s.a, e.a) AS a, coalesce(h.b, o.b, s.b, e.b) AS b FROM (SELECT DISTINCT host, domain, suffix FROM keyed) d
  LEFT JOIN host_p h ON h.key = d.host LEFT JOIN domain_p o ON o.key = d.domain LEFT JOIN suffix_p s ON s.key = d.suffix CROSS JOIN everything e),
bounds AS (SELECT host, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS reputation FROM ab)
SELECT page_id, k.host, path, {rule.replace("host", "k.host")} AS rule,
  coalesce({ruled.replace("host", "k.host")}, CASE WHEN reputation >= {floor} THEN 'allow' ELSE 'block' END) AS verdict, round(reputation, 6) AS reputation
FROM keyed k JOIN bounds b ON b.host = k.host"""
