"""URL filters: explicit rules, then an empirical-Bayes reputation of hosts.

Labelled outcomes of pages (bad or not) are counted for each host. Rates are shrunk level by level with beta-binomial
priors: a suffix towards all pages, a registered domain towards its suffix, a host towards its domain; each level's
prior strength comes from the spread of its units' rates (method of moments). A host is blocked where the lower bound
of its posterior bad rate (mean less Z standard deviations) lies above a threshold, so a few bad pages never block a host.

Null urls and urls without `://` have an empty host and path, fit no rule, and share one (empty) host. Hosts without
labels get the reputation of what lies above: of their domain, else of the suffix, else of all pages. Repeated rows, ties and
other columns do not matter; without labels nothing is blocked but by rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.llm._shared import lookup, lower_ascii, materialize, read

#: (verdict, host, path prefix): fits the host and its subdomains; the longest that fits wins.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Suffixes of two labels, and hosts that are addresses.
SECOND, ADDRESS = "^(ac|co|com|edu|gov|net|org)[.][a-z][a-z]$", "^([0-9.]+|[\\[].*)$"
#: A host is blocked if its posterior mean bad rate less Z standard deviations is above MAX_RATE.
MAX_RATE, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 10_000.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that wins, and its verdict; null where none fits."""
    rule = verdict = None
    for action, at, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule = F.when(fits, at + prefix) if rule is None else rule.when(fits, at + prefix)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return (F.lit(None).cast("string") if rule is None else rule), (F.lit(None).cast("string") if verdict is None else verdict)


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix, without a port.

    The suffix is the last label, or the last two where they are like `co.uk` (SECOND and two letters); the domain has
    one label more. An address of numbers is a domain and a suffix of its own.
    """
    name = F.regexp_replace(host, ":[0-9]*$", "")
    address, two = name.rlike(ADDRESS), F.substring_index(name, ".", -2).rlike(SECOND)
    last = lambda k: F.substring_index(name, ".", -k)
    return F.when(address, name).when(two, last(3)).otherwise(last(2)), F.when(address, name).when(two, last(2)).otherwise(last(1))


def spread(units: DataFrame) -> Column:
    """Strength of the beta prior over units (n, bad), by moments, as an aggregate."""
    total, bad = F.sum("n"), F.sum("bad")
    mean = bad / total
    squares = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - bad * bad / total  # sum of n (rate - mean)^2
    noise = (F.count("n") - 1) * mean * (1 - mean)
    room = (total - F.sum(F.col("n") * F.col("n")) / total - (F.count("n") - 1)) * mean * (1 - mean)
    within = F.when((squares > noise) & (room > 0), F.least(F.lit(1.0), (squares - noise) / room)).otherwise(F.lit(0.0))
    return F.when(within > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / within - 1))).otherwise(F.lit(STRONGEST))


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, n, bad, rate (posterior mean), low (lower bound) and blocked, from outcomes (host string, bad 0/1).

    Rows with a null outcome count for nothing, but their hosts get what lies above.
    """
    domain, suffix = levels(F.col("host"))
    hosts = materialize(outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("bad")), "hosts")
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    strength = [level.where("n > 0").agg(spread(level)).first()[0] or STRONGEST for level in (suffixes, domains, hosts)]
    total, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    mean = (bad or 0.0) / total if total else 0.0
    shrunk = lambda up, s: (F.col("bad") + s * up) / (F.col("n") + s)
    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), strength[0]).alias("up1"))
    domains = lookup(domains, suffixes, ["suffix"]).select("domain", shrunk(F.col("up1"), strength[1]).alias("up2"))
    rate = shrunk(F.col("up2"), strength[2])
    hosts = lookup(hosts, domains, ["domain"]).select("host", "n", "bad", rate.alias("rate"), (F.col("n") + strength[2] + 1).alias("size"))
    low = F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("size"))
    return hosts.withColumn("low", low).withColumn("blocked", F.col("low") > MAX_RATE).drop("size")


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each page: id, host, path, rule and verdict. outcomes: (id, bad 0/1), one row for each labelled page at most."""
    host, path = parts(F.col(url_col))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    known = split.join(outcomes.select(F.col(id_col), F.col("bad")), id_col, "left").select("host", "bad")
    out = lookup(split, reputations(known).select("host", "blocked"), ["host"])
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the label with its id calls it toxic or of low quality."""
    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    return judge(read(spark, sf_dir, "pages"), labels)


_RULED = ", ".join(f"({k}, '{a}', '{h}', '{p}')" for k, (a, h, p) in enumerate(RULES))
OP3_SQL = f"""
WITH split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(k, action, root, prefix) AS (VALUES {_RULED}),
fits AS (
  SELECT page_id, arg_max(root || prefix, length(root || prefix)) AS rule, arg_max(action, length(root || prefix)) AS verdict
  FROM split JOIN rules ON (host = root OR ends_with(host, chr(46) || root)) AND starts_with(path, prefix) GROUP BY page_id),
outcome AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
named AS (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM split),
leveled AS (
  SELECT page_id, host, array_to_string(l, '.') AS name, regexp_matches(array_to_string(l, '.'), '{ADDRESS}') AS address,
    CASE WHEN regexp_matches(array_to_string(l[-2:], '.'), '{SECOND}') THEN 2 ELSE 1 END AS k, l FROM named),
hosts AS (
  SELECT host, CASE WHEN address THEN name ELSE array_to_string(l[-(k + 1):], '.') END AS domain, CASE WHEN address THEN name ELSE array_to_string(l[-k:], '.') END AS suffix,
    count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM leveled LEFT JOIN outcome USING (page_id) GROUP BY ALL),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix),
units AS (SELECT 0 AS level, n, bad FROM suffixes UNION ALL SELECT 1, n, bad FROM domains UNION ALL SELECT 2, n, bad FROM hosts),
moments AS (
  SELECT level, sum(n) AS total, sum(bad) / sum(n) AS mean, count(*) - 1 AS free, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS squares, sum(n * n) AS nn
  FROM units WHERE n > 0 GROUP BY level),
within AS (
  SELECT level, mean, CASE WHEN squares > free * mean * (1 - mean) AND (total - nn / total - free) * mean * (1 - mean) > 0
    THEN least(1.0::DOUBLE, (squares - free * mean * (1 - mean)) / ((total - nn / total - free) * mean * (1 - mean))) ELSE 0.0::DOUBLE END AS w FROM moments),
strength AS (SELECT level, mean, CASE WHEN w > 0 THEN greatest({WEAKEST}::DOUBLE, least({STRONGEST}::DOUBLE, 1 / w - 1)) ELSE {STRONGEST}::DOUBLE END AS s FROM within),
up1 AS (SELECT suffix, (bad + s * mean) / (n + s) AS up FROM suffixes, strength WHERE level = 0),
up2 AS (SELECT d.suffix, d.domain, (d.bad + s * up) / (d.n + s) AS up FROM domains d JOIN up1 USING (suffix), strength WHERE level = 1),
posterior AS (SELECT h.host, (h.bad + s * up) / (h.n + s) AS rate, h.n + s + 1 AS size FROM hosts h JOIN up2 USING (suffix, domain), strength WHERE level = 2)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN rate - {Z} * sqrt(rate * (1 - rate) / size) > {MAX_RATE} THEN 'block' END, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id) LEFT JOIN posterior USING (host)
"""
