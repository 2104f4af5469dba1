"""URL verdicts: rules first, then the reputation of hosts from labelled pages.

Reputation is empirical Bayes on three levels. A suffix's share of good pages is
shrunk towards the share of all, a registered domain's towards its suffix, a host's
towards its domain: each level is a beta prior, worth as many pages as the spread of
the level's shares around their priors tells (method of moments for beta-binomial
counts). A host is allowed if the lower bound of its posterior is high enough.

All work is DataFrame expressions; the levels are tables of counts per host, reduced
before any shuffle, and the driver holds three numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict): a rule fits its host and all subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Standard deviations below the mean at which the bound lies; bound from which on a
#: host is allowed; limits of the correlation within a group.
Z, LEAST_BOUND, LEAST_RHO, MOST_RHO = 1.645, 0.5, 0.0001, 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    empty without one."""
    raw = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host without user and port; a bare address or a
    single label stands for itself."""
    name = F.rtrim(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), F.lit("."))
    return F.when(name.rlike("^[0-9.]+$"), name).otherwise(F.substring_index(name, ".", -2))


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike("^[0-9.]+$"), F.lit("")).otherwise(F.substring_index(domain, ".", -1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        text, verdict = F.when(fits, F.lit(own + start)).otherwise(text), F.when(fits, F.lit(decision)).otherwise(verdict)
    return text, verdict


def strength(groups: DataFrame, mean: Column) -> float:
    """Pages that the prior of a level is worth, from groups with n and good pages
    and a prior ``mean``; the correlation is rounded so that no order of summing
    shows."""
    even = F.col("n") * mean * (1 - mean)
    row = groups.where("n > 0").agg(F.sum((F.col("good") - F.col("n") * mean) ** 2).alias("spread"), F.sum(even).alias("own"), F.sum(even * (F.col("n") - 1)).alias("shared")).first()
    rho = (row.spread - row.own) / row.shared if row.shared else MOST_RHO
    return 1 / min(max(round(rho, 6), LEAST_RHO), MOST_RHO) - 1


def reputations(pages: DataFrame) -> DataFrame:
    """host, n (labelled pages), good, mean and bound for every host of ``pages``
    (host, good: 1, 0 or null where a page has no label)."""
    hosts = durable(pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
                    .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = F.lit((total.good + 1) / (total.n + 2) if total.n else 0.5)

    def shrunk(groups: DataFrame, prior: Column) -> DataFrame:
        worth = F.lit(strength(groups, prior))
        return groups.withColumn("a", worth * prior + F.col("good")).withColumn("b", worth * (1 - prior) + F.col("n") - F.col("good"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    upper = shrunk(suffixes, overall).select("suffix", mean.alias("prior"))
    middle = shrunk(domains.join(upper, "suffix"), F.col("prior")).select("domain", "suffix", mean.alias("prior"))
    known = shrunk(hosts.join(middle, ["domain", "suffix"]), F.col("prior"))
    deviation = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return known.select("host", "n", "good", F.round(mean, 6).alias("mean"), F.round(mean - Z * deviation, 6).alias("bound"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, and the
    host's labelled pages, posterior mean and bound.

    A page is labelled where ``labels`` (doc_id, quality, toxic) has its id, and good
    if its quality is 1 and it is not toxic; repeated labels count as the worst, null
    ones not at all. Null urls and those without ``://`` have an empty host and path,
    share one reputation, and are judged by it. Without any labels every prior is one
    half, and hosts are blocked. Repeated rows are judged alike."""
    worst = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").alias("page_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good")))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputations(rows.join(worst, "page_id", "left"))
    text, decision = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= LEAST_BOUND, "allow").otherwise("block")
    return rows.join(known, "host").select("page_id", "host", "path", text.alias("rule"), F.coalesce(decision, own).alias("verdict"), F.col("n").alias("labelled"), "mean", "bound")


#: The same in SQL, rules and constants spelled out.
SQL = r"""
WITH p AS (
    SELECT page_id,
           CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages),
l AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS name
       FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
h1 AS (SELECT host, n, good, CASE WHEN regexp_full_match(name, '[0-9.]+') THEN name ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS domain FROM h0),
h AS (SELECT *, CASE WHEN regexp_full_match(domain, '[0-9.]+') THEN '' ELSE string_split(domain, '.')[-1] END AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
o AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 1) / (sum(n) + 2) ELSE 0.5 END AS m FROM s),
ks AS (SELECT 1 / least(greatest(round(coalesce((sum((good - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), 0.5), 6), 0.0001), 0.5) - 1 AS k FROM s, o WHERE n > 0),
sp AS (SELECT suffix, (coalesce((SELECT k FROM ks), 1) * m + good) / ((coalesce((SELECT k FROM ks), 1) * m + good) + (coalesce((SELECT k FROM ks), 1) * (1 - m) + n - good)) AS prior FROM s, o),
d2 AS (SELECT domain, d.suffix, n, good, prior AS m FROM d JOIN sp USING (suffix)),
kd AS (SELECT 1 / least(greatest(round(coalesce((sum((good - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), 0.5), 6), 0.0001), 0.5) - 1 AS k FROM d2 WHERE n > 0),
dp AS (SELECT domain, suffix, (coalesce((SELECT k FROM kd), 1) * m + good) / ((coalesce((SELECT k FROM kd), 1) * m + good) + (coalesce((SELECT k FROM kd), 1) * (1 - m) + n - good)) AS prior FROM d2),
h2 AS (SELECT host, n, good, prior AS m FROM h JOIN dp USING (domain, suffix)),
kh AS (SELECT 1 / least(greatest(round(coalesce((sum((good - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), 0.5), 6), 0.0001), 0.5) - 1 AS k FROM h2 WHERE n > 0),
h3 AS (SELECT host, n, coalesce((SELECT k FROM kh), 1) * m + good AS a, coalesce((SELECT k FROM kh), 1) * (1 - m) + n - good AS b FROM h2),
r AS (SELECT host, n, round(a / (a + b), 6) AS mean, round(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS bound FROM h3)
SELECT page_id, p.host, path,
       CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
       CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'allow'
            WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'block'
            WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'allow'
            WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'block'
            WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
       CAST(n AS BIGINT) AS labelled, mean, bound
FROM p JOIN r USING (host)
"""
