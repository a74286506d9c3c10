"""URL filters: fixed rules first, then empirical-Bayes reputation of hosts.

Only DataFrame functions.  Labelled page outcomes (bad or not) are counted for
each host, registered domain and suffix.  A level's bad rate is drawn to that
of the level above by a beta prior whose mean is the upper level's posterior
mean and whose strength is fitted over all labelled groups of the level by moments
(beta-binomial).  A host's pages are blocked if its bad rate exceeds a limit with a
posterior probability of 95 % at least: the integral of the beta density above the limit.
A host, domain or suffix without labelled pages has the posterior mean of the level above,
so a new subdomain of a bad domain is judged by its domain.

A registered domain is a public suffix and one label before it; suffixes of two labels are
those of SUFFIXES, all others have one.  An address of numbers is a domain of its own.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule; an empty host is a host like any other; null page ids are judged, never
labelled; repeated rows are judged each on its own, a page labelled more than once counts
as bad if one label says so; without labels nothing is blocked by reputation; long urls are
read whole; of the tables only the named columns are read, so others can't clash; an empty
table gives no rows.  Counts are summed before any join, so a host with a third of
all pages is one row in every join but the last, which Spark splits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed rules: (rule, verdict).  A rule is a host, a slash and the beginning of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Limit of the bad rate, posterior probability that has to lie above it, and prior strengths allowed.
MOST_BAD, CERTAIN = 0.35, 0.95
WEAKEST, STRONGEST = 1.0, 10_000.0
#: Points of each side's integral, and how far it reaches: beyond so many deviations and tail lengths there is nothing left.
POINTS, DEVIATIONS, REACH = 400, 8.0, 30.0
#: Smallest parameter of a beta density.
LEAST_SHAPE = 1e-3
#: Public suffixes of two labels.
SUFFIXES = (
    "ac.at", "co.at", "or.at", "com.au", "edu.au", "gov.au", "net.au", "org.au", "com.br", "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.co", "com.es", "com.hk", "org.hk", "co.id", "ac.il", "co.il", "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.ir", "co.ir", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "ac.kr", "co.kr", "go.kr", "or.kr", "com.mx", "gob.mx", "com.my", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "com.pe", "com.ph", "com.pl", "edu.pl", "net.pl", "org.pl", "com.ar", "gob.ar",
    "com.sa", "com.sg", "edu.sg", "ac.th", "co.th", "com.tr", "edu.tr", "gov.tr", "com.tw", "edu.tw", "org.tw", "com.ua", "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk",
    "com.ve", "com.vn", "ac.za", "co.za", "gov.za", "org.za",
)
_TWO = "(^|[.])(" + "|".join(x.replace(".", "[.]") for x in SUFFIXES) + ")$"
_PORT, _NUMBERS = ":[0-9]*$", r"^[0-9]+([.][0-9]+){3}$|^\["
_LAST = {1: "[^.]*$", 2: "([^.]*[.])?[^.]*$", 3: "([^.]*[.])?[^.]*[.][^.]*$"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWERED), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule = verdict = None
    for text, answer in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, begin = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + begin)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, answer) if verdict is None else verdict.when(fits, answer)
    return rule, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix, without a port."""
    name = F.when(host.startswith("["), host).otherwise(F.regexp_replace(host, _PORT, ""))
    last = lambda n: F.regexp_extract(name, _LAST[n], 0)
    numbers, two = F.regexp_like(name, F.lit(_NUMBERS)), F.regexp_like(name, F.lit(_TWO))
    return F.when(numbers, name).when(two, last(3)).otherwise(last(2)), F.when(numbers, "").when(two, last(2)).otherwise(last(1))


@dataclass(frozen=True)
class Strengths:
    mean: float
    host: float
    domain: float
    suffix: float


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad): each host's labelled pages, of which there may be none."""
    bad = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(
        F.max(F.when((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1), 1).otherwise(0)).alias("bad"))
    seen = pages.join(bad, pages["page_id"] == bad["doc_id"], "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = domain_of(F.col("host"))
    return seen.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")


def fit_strengths(hosts: DataFrame) -> Strengths:
    """Prior strengths by moments; what reaches the driver is one row."""
    hosts = hosts.where("n > 0")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rows = {}
    for name, level in (("host", hosts), ("domain", domains), ("suffix", suffixes)):
        rows[name] = level.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")).first()
    total = rows["host"]
    mean = total.bad / total.n if total.n else 0.0
    return Strengths(mean, *(strength(rows[x], mean) for x in ("host", "domain", "suffix")))


def strength(row, mean: float) -> float:
    spread = mean * (1 - mean)
    if not row.n or row.k < 2 or spread <= 0:
        return STRONGEST
    between = (row.bb - row.n * mean * mean) - spread * (row.k - 1)  # sum of n (p - mean)**2 less what chance gives
    room = spread * (row.n - row.nn / row.n - (row.k - 1))
    rho = between / room if room > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, (1 - rho) / rho)) if rho > 0 else STRONGEST


def above_limit(a: Column, b: Column, limit: float = MOST_BAD) -> Column:
    """Probability that a beta-distributed rate is above the limit: the density over the log-odds u, summed at the
    middles of equal steps on either side of the limit's."""
    edge = math.log(limit / (1 - limit))
    softplus = lambda u: F.greatest(u, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(u)))
    mode = F.ln(a / b)
    top = a * softplus(-mode) + b * softplus(mode)
    steps = F.sequence(F.lit(0), F.lit(POINTS - 1))

    def side(sign: int, width: Column) -> Column:
        at = lambda k: edge + sign * width * (k + 0.5) / POINTS
        return width * F.aggregate(steps, F.lit(0.0), lambda total, k: total + F.exp(top - a * softplus(-at(k)) - b * softplus(at(k))))

    core = DEVIATIONS * F.sqrt(1 / a + 1 / b)
    under, over = side(-1, F.greatest(edge - mode, F.lit(0.0)) + core + REACH / a), side(1, F.greatest(mode - edge, F.lit(0.0)) + core + REACH / b)
    return over / (under + over)


def reputation(hosts: DataFrame, s: Strengths) -> DataFrame:
    """(host, rate, certain): posterior mean of each host's bad rate, and the probability that it is above the limit."""
    post = lambda prior, size: (prior * size + F.col("bad")) / (F.lit(size) + F.col("n"))
    summed = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = summed(hosts, "domain", "suffix")
    suffixes = summed(domains, "suffix").select("suffix", post(F.lit(s.mean), s.suffix).alias("above"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", post(F.col("above"), s.domain).alias("above"))
    out = hosts.join(domains, ["domain", "suffix"]).select("host", post(F.col("above"), s.host).alias("rate"), (F.lit(s.host) + F.col("n")).alias("size"))
    share = lambda p: F.greatest(p * F.col("size"), F.lit(LEAST_SHAPE))
    shaped = out.select("host", "rate", share(F.col("rate")).alias("a"), share(1 - F.col("rate")).alias("b"))
    return shaped.select("host", "rate", above_limit(F.col("a"), F.col("b")).alias("certain"))


def judge_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, certain) of every row."""
    host, path = host_and_path(F.col(f"`{url}`"))
    parsed = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = outcomes(parsed, labels.select("doc_id", "quality", "toxic"))
    s = fit_strengths(hosts)
    known = reputation(hosts, s)
    rule, verdict = match_rules(F.col("host"), F.col("path"))
    judged = parsed.join(known, "host", "left")
    by_method = F.when(F.col("certain") >= CERTAIN, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "certain")


def oracle_sql() -> str:
    """The same in DuckDB's SQL, for the columns that don't hold fitted numbers."""
    level = lambda name, groups, source: f"{name} AS (SELECT {groups}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM {source} GROUP BY ALL)"
    fitted = lambda name, source: f"""{name} AS (SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR count(*) < 2 OR max(m) * (1 - max(m)) <= 0 THEN {STRONGEST}
      ELSE (SELECT CASE WHEN room > 0 AND gap / room > 0 THEN least({STRONGEST}, greatest({WEAKEST}, (1 - gap / room) / (gap / room))) ELSE {STRONGEST} END FROM
        (SELECT sum(bad * bad / n) - sum(n) * max(m) * max(m) - max(m) * (1 - max(m)) * (count(*) - 1) AS gap,
                max(m) * (1 - max(m)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) AS room FROM {source}, mean)) END AS s FROM {source}, mean)"""  # noqa: E731
    edge = math.log(MOST_BAD / (1 - MOST_BAD))
    softplus = lambda u: f"(greatest({u}, 0) + ln(1 + exp(-abs({u}))))"
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{pick(r)}'" for r in rules for h, _, p in [r[0].partition("/")]) + " END"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWERED}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
marks AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
seen AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, CASE WHEN starts_with(host, '[') THEN host ELSE regexp_replace(host, '{_PORT}', '') END AS name FROM parsed LEFT JOIN marks ON page_id = doc_id GROUP BY host),
all_hosts AS (SELECT host, n, bad, CASE WHEN regexp_matches(name, '{_NUMBERS}') THEN name WHEN regexp_matches(name, '{_TWO}') THEN regexp_extract(name, '{_LAST[3]}', 0) ELSE regexp_extract(name, '{_LAST[2]}', 0) END AS domain,
  CASE WHEN regexp_matches(name, '{_NUMBERS}') THEN '' WHEN regexp_matches(name, '{_TWO}') THEN regexp_extract(name, '{_LAST[2]}', 0) ELSE regexp_extract(name, '{_LAST[1]}', 0) END AS suffix FROM seen),
hosts AS (SELECT * FROM all_hosts WHERE n > 0),
{level("domains", "domain, suffix", "hosts")}, {level("suffixes", "suffix", "hosts")},
mean AS (SELECT coalesce(sum(bad) / sum(n), 0) AS m FROM hosts),
{fitted("s_host", "hosts")}, {fitted("s_domain", "domains")}, {fitted("s_suffix", "suffixes")},
post_suffix AS (SELECT suffix, (m * s + bad) / (s + n) AS above FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM all_hosts GROUP BY ALL), mean, s_suffix),
post_domain AS (SELECT d.domain, d.suffix, (above * s + bad) / (s + n) AS above FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM all_hosts GROUP BY ALL) d JOIN post_suffix USING (suffix), s_domain),
post_host AS (SELECT host, (above * s + bad) / (s + n) AS rate, s + n AS size FROM all_hosts JOIN post_domain USING (domain, suffix), s_host),
shape AS (SELECT host, greatest(rate * size, {LEAST_SHAPE}) AS a, greatest((1 - rate) * size, {LEAST_SHAPE}) AS b FROM post_host),
peak AS (SELECT host, a, b, ln(a / b) AS mode, {edge!r} AS edge FROM shape),
wide AS (SELECT *, a * {softplus("-mode")} + b * {softplus("mode")} AS top, greatest(edge - mode, 0) + {DEVIATIONS} * sqrt(1 / a + 1 / b) + {REACH} / a AS lw, greatest(mode - edge, 0) + {DEVIATIONS} * sqrt(1 / a + 1 / b) + {REACH} / b AS rw FROM peak),
parts AS (SELECT host, lw * list_sum(list_transform(range(0, {POINTS}), lambda k: exp(top - a * {softplus("-(edge - lw * (k + 0.5) / " + str(POINTS) + ")")} - b * {softplus("(edge - lw * (k + 0.5) / " + str(POINTS) + ")")}))) AS under,
  rw * list_sum(list_transform(range(0, {POINTS}), lambda k: exp(top - a * {softplus("-(edge + rw * (k + 0.5) / " + str(POINTS) + ")")} - b * {softplus("(edge + rw * (k + 0.5) / " + str(POINTS) + ")")}))) AS "over" FROM wide),
known AS (SELECT host, "over" / (under + "over") AS certain FROM parts)
SELECT page_id, p.host, path, {case(lambda r: r[0]).replace("host", "p.host")} AS rule,
  coalesce({case(lambda r: r[1]).replace("host", "p.host")}, CASE WHEN certain >= {CERTAIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN known k ON p.host = k.host"""
