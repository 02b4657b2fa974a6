"""URL filter by Empirical-Bayes host reputation.

A page's outcome is bad when `labels` (by doc_id = page_id) says quality 0 or toxic 1. Bad outcomes are counted by host,
registered domain and suffix. Every level shrinks through a beta-binomial prior towards the level above: suffixes towards
all pages, domains towards their suffix, hosts towards their domain,
    rate = (bad + strength * rate above) / (n + strength),
with a strength estimated for each level by the method of moments. A host is blocked when the lower posterior bound of
its bad rate, mean - Z standard deviations of its beta posterior, is over MAX_BAD. Explicit rules come first: a rule
`host/path` fits its host and all subdomains when the url's path starts with the rule's; the longest one decides.

Everything is DataFrame functions. The counts add up in each task before they are shuffled, so a host with a third of all
pages costs a row for each task. Pages meet the reputations by (host, salt): a host gets a salt for every SHARE pages (or for every
MOST_HOT-th of the table, if that is more), so there are at most MOST_HOT hosts of more than one salt, and only these are broadcast.

Defined cases: null urls and urls without :// have an empty host and path, which is a host like any other but fits no rule;
unlabelled hosts get the rate of their domain, and so on up; several labels of a page count once, bad if any is; pages
of null page_id are judged but have no outcome; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import stash

# Rules as (verdict, rule), and suffixes of more than one label.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ac.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za", "co.kr")
Z, MAX_BAD = 1.645, 0.35
SHARE, MOST_HOT = 100_000, 10_000
#: Bounds of the estimated strength, in outcomes.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Bad rate before any outcome, worth one outcome.
PRIOR_BAD = 0.1


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end; then up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    last2 = F.substring_index(host, ".", -2)
    long = last2.isin(*LONG_SUFFIXES)
    suffix = F.when(long, last2).otherwise(F.substring_index(host, ".", -1))
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(last2), suffix


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame) -> float:
    """Method of moments over groups with n outcomes, x bad ones, and the mean m of the level above; one row comes back."""
    r = level.where("n > 0").agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("m"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("within"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("sampling"),
    ).first()
    if not r["n"] or not r["within"]:
        return STRONGEST
    # E[between] = sampling + rho (within - sampling), with rho = 1 / (1 + strength)
    room = r["within"] - r["sampling"]
    rho = (r["between"] - r["sampling"]) / room if room > 0 else 0.0
    strength = 1 / rho - 1 if rho > 0 else STRONGEST
    return round(min(STRONGEST, max(WEAKEST, strength)), 3)


def host_reputation(urls: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """urls: page_id, host and path. (one row for each host with its pages, rate and bound, the strengths)."""
    outcomes = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of_page"))
    outcomes = outcomes.agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    key = F.coalesce("page_id", F.xxhash64("host", "path"))  # pages without an id have no outcome, but mustn't all meet in one task
    pages = urls.join(outcomes, (key == F.col("of_page")) & F.col("page_id").isNotNull(), "left")
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = stash(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "n", "x"), "hosts")  # pages are counted once
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    mean = round(((total["x"] or 0) + PRIOR_BAD) / ((total["n"] or 0) + 1.0), 6)
    strengths = {}

    def shrink(level: DataFrame, name: str) -> DataFrame:
        strengths[name] = s = _strength(level)
        return level.withColumn("rate", (F.col("x") + s * F.col("m")) / (F.col("n") + s)).withColumn("weight", F.col("n") + s)

    suffixes = shrink(suffixes.withColumn("m", F.lit(mean)), "suffix").select("suffix", F.col("rate").alias("m"))
    domains = shrink(domains.join(suffixes, "suffix"), "domain").select("suffix", "domain", F.col("rate").alias("m"))
    hosts = shrink(hosts.join(domains, ["suffix", "domain"]), "host")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return hosts.select("host", "pages", "n", "x", "rate", (F.col("rate") - Z * spread).alias("bound")), strengths


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """page_id, host, path, rule, verdict and bad_rate (of the host) of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    known, _ = host_reputation(rows, labels)
    known = stash(known, "reputations")
    share = max(SHARE, math.ceil((known.agg(F.sum("pages").alias("n")).first()["n"] or 0) / MOST_HOT))
    salts = F.ceil(F.col("pages") / share).cast("int")
    hot = F.broadcast(known.where(F.col("pages") > share).select(F.col("host").alias("hot_host"), salts.alias("salts")))  # at most MOST_HOT rows
    known = known.select(F.col("host").alias("of_host"), "rate", "bound", F.explode(F.sequence(F.lit(0), salts - 1)).alias("of_salt"))
    rows = rows.join(hot, F.col("host") == F.col("hot_host"), "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.coalesce("salts", F.lit(1))).cast("int"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.join(known, (F.col("host") == F.col("of_host")) & (F.col("salt") == F.col("of_salt")))
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("bound") > max_bad, "block").otherwise("allow")).alias("verdict"), F.round("rate", 6).alias("bad_rate")
    )


def oracle_sql() -> str:
    """The same for DuckDB."""
    cases = "\n".join(
        f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{pick}'"
        for pick, name, start in ((t, *t.split("/", 1)) for _, t in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))
    )
    verdicts = " ".join(f"WHEN '{t}' THEN '{v}'" for v, t in RULES)
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)

    def strength(level: str) -> str:
        return f"""(SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR coalesce(sum(n * m * (1 - m)), 0) = 0 THEN {STRONGEST}::DOUBLE ELSE
            round(least({STRONGEST}, greatest({WEAKEST}, CASE WHEN (sum(n * pow(x / n - m, 2)) - sum(m * (1 - m))) > 0 AND sum((n - 1) * m * (1 - m)) > 0
            THEN sum((n - 1) * m * (1 - m)) / (sum(n * pow(x / n - m, 2)) - sum(m * (1 - m))) - 1 ELSE {STRONGEST} END)), 3) END AS s FROM {level} WHERE n > 0)"""

    return f"""
    WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    v AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS x, string_split(host, '.') AS p FROM v LEFT JOIN o ON page_id = doc_id GROUP BY host),
    h1 AS (SELECT host, n, x, p, array_to_string(list_slice(p, -2, -1), '.') AS two, array_to_string(list_slice(p, -3, -1), '.') AS three FROM h0),
    h AS (SELECT host, n, x, CASE WHEN two IN ({long}) THEN three ELSE two END AS domain, CASE WHEN two IN ({long}) THEN two ELSE p[len(p)] END AS suffix FROM h1),
    d0 AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM h GROUP BY ALL),
    g AS (SELECT round((coalesce(sum(x), 0) + {PRIOR_BAD}) / (coalesce(sum(n), 0) + 1.0), 6) AS mean FROM d0),
    s0 AS (SELECT suffix, sum(n) AS n, sum(x) AS x, any_value(mean) AS m FROM d0, g GROUP BY suffix),
    ss AS {strength("s0")},
    s1 AS (SELECT suffix, (x + s * m) / (n + s) AS m FROM s0, ss),
    d1 AS (SELECT d0.*, m FROM d0 JOIN s1 USING (suffix)),
    ds AS {strength("d1")},
    d2 AS (SELECT suffix, domain, (x + s * m) / (n + s) AS m FROM d1, ds),
    h2 AS (SELECT h.*, m FROM h JOIN d2 USING (suffix, domain)),
    hs AS {strength("h2")},
    k AS (SELECT host, (x + s * m) / (n + s) AS rate, n + s AS weight FROM h2, hs),
    j AS (SELECT page_id, host, path, CASE {cases} END AS rule, rate, rate - {Z} * sqrt(rate * (1 - rate) / (weight + 1)) AS bound FROM v JOIN k USING (host))
    SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN bound > {MAX_BAD} THEN 'block' ELSE 'allow' END END AS verdict, round(rate, 6) AS bad_rate FROM j
    """
