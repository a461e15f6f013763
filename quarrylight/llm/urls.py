"""URL filter: rules first, then an empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import cut, lower_ascii, table

#: (verdict, host, path): a rule fits its host and every subdomain, for paths that start with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of two labels where the caller gives none; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "com.cn", "com.mx")
#: A host is blocked if the upper bound of its posterior rate of good pages is below LEAST_GOOD.
LEAST_GOOD, Z = 0.5, 1.645
#: Bounds of a fitted prior strength, in pseudo-pages.
WEAKEST, STRONGEST = 1.0, 1000.0

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _parts(host: Column, two_labels) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = tail(2).isin(*two_labels)
    return F.when(two, tail(3)).otherwise(tail(2)), F.when(two, tail(2)).otherwise(tail(1))


def _strength(groups: DataFrame) -> float:
    """Method-of-moments strength of the beta prior shared by groups (n pages, s good): 1 / intraclass correlation - 1."""
    r = groups.filter("n > 0").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("s").cast("double") * F.col("s") / F.col("n")).alias("ss"),
    ).first()
    if not r.n or r.k < 2:
        return STRONGEST
    p = r.s / r.n
    room = r.n - r.nn / r.n - (r.k - 1)
    if p in (0.0, 1.0) or room <= 0:
        return STRONGEST
    rho = ((r.ss - r.n * p * p) / (p * (1 - p)) - (r.k - 1)) / room
    return STRONGEST if rho <= 0 else round(min(STRONGEST, max(WEAKEST, 1 / rho - 1)), 6)


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_good: float = LEAST_GOOD, z: float = Z, two_labels=TWO_LABEL_SUFFIXES) -> DataFrame:
    """Judges every page by its URL.

    pages: page_id, url. outcomes: page_id, good (1, 0 or null): labelled pages. The longest fitting rule decides;
    where none fits, the host's reputation does. The rate of good pages of a suffix is shrunk to the rate of all,
    that of a registered domain to its suffix's, that of a host to its domain's, each by a beta prior whose
    strength is fitted to that level's groups by the method of moments. A host without labels thus has its
    domain's rate. A registered domain is one label below its suffix; `two_labels` lists the suffixes of two labels (such as co.uk).
    `block` if mean + z sd of the host's posterior is below `least_good`.

    The rules are configuration and become one CASE expression. Counts are pre-aggregated by host before the
    levels are joined and written once, so a host with a third of all pages is a single row there; the last join, back to the
    pages, is an inner equi-join that Spark splits where one host is hot.

    Returns page_id, host, path, rule, verdict, good_rate, good_upper. A null url or one without :// has an empty
    host and path and the reputation of the empty host. Several outcomes of one page: the worst counts, once for each
    row of that page. Repeated pages are judged alike. Without any outcome every page without a rule is allowed.
    Empty tables give an empty result.
    """
    page = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    hosts = (
        page.select("page_id", "host")
        .join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("s"))
    )
    domain, suffix = _parts(F.col("host"), two_labels)
    hosts = cut(hosts.withColumns({"domain": domain, "suffix": suffix}))  # read six times
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = ((every.s or 0) + 1) / ((every.n or 0) + 2)
    k_suffix, k_domain, k_host = _strength(suffixes), _strength(domains), _strength(hosts)
    shrunk = lambda k, to: (F.col("s") + F.lit(k) * to) / (F.col("n") + F.lit(k))
    suffixes = suffixes.select("suffix", shrunk(k_suffix, F.lit(rate)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(k_domain, F.col("suffix_rate")).alias("domain_rate"))
    a, b = F.col("s") + F.lit(k_host) * F.col("domain_rate"), F.col("n") - F.col("s") + F.lit(k_host) * (1 - F.col("domain_rate"))
    hosts = (
        hosts.join(domains, "domain")
        .select("host", a.alias("a"), b.alias("b"))
        .select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("good_rate"), F.sqrt(F.expr("a * b / ((a + b) * (a + b) * (a + b + 1))")).alias("sd"))
        .select("host", "good_rate", (F.col("good_rate") + F.lit(z) * F.col("sd")).alias("good_upper"))
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    own = F.when(F.col("good_upper") < least_good, "block").otherwise("allow")
    return page.join(hosts, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "good_rate", "good_upper"
    )


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels whose doc_id is a page's id; good means quality 1 and toxic 0."""
    labels = table(spark, sf_dir, "labels")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return filter_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    strength = lambda t: f"""(SELECT CASE WHEN coalesce(n, 0) = 0 OR k < 2 OR s = 0 OR s = n OR n - nn / n - (k - 1) <= 0 THEN {STRONGEST}
        WHEN rho <= 0 THEN {STRONGEST} ELSE round(least({STRONGEST}, greatest({WEAKEST}, 1 / rho - 1)), 6) END
        FROM (SELECT *, ((ss - n * (s / n) * (s / n)) / ((s / n) * (1 - s / n)) - (k - 1)) / (n - nn / n - (k - 1)) AS rho
        FROM (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(s)::DOUBLE AS s, sum(n::DOUBLE * n) AS nn, sum(s::DOUBLE * s / n) AS ss FROM {t} WHERE n > 0)))"""  # noqa: E731
    return f"""WITH page AS (SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
    known AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
        WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
    host0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS s, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l
        FROM page LEFT JOIN known USING (page_id) GROUP BY 1),
    hosts AS (SELECT host, n, s, CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
        CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM host0),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM hosts GROUP BY 1, 2),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM domains GROUP BY 1),
    every AS (SELECT (coalesce(sum(s), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS rate FROM suffixes),
    k AS (SELECT {strength("suffixes")} AS ks, {strength("domains")} AS kd, {strength("hosts")} AS kh),
    suffix_rate AS (SELECT suffix, (s + ks * rate) / (n + ks) AS m FROM suffixes, every, k),
    domain_rate AS (SELECT domain, (s + kd * m) / (n + kd) AS m FROM domains JOIN suffix_rate USING (suffix), k),
    posterior AS (SELECT host, s + kh * m AS a, n - s + kh * (1 - m) AS b FROM hosts JOIN domain_rate USING (domain), k),
    bound AS (SELECT host, a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM posterior)
    SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
        CASE {verdict} WHEN upper < {LEAST_GOOD} THEN 'block' ELSE 'allow' END AS verdict
    FROM page JOIN bound USING (host)"""


QUERIES = {"op10_host_reputation": op10_host_reputation}
ORACLE_SQL = {"op10_host_reputation": _sql()}
