"""URL filtering by empirical-Bayes host reputation, under fixed rules that come first.

Labelled page outcomes are shrunk through beta-binomial priors: the mean of a public suffix towards that of all
pages, a registered domain's towards its suffix, a host's towards its domain. The strength of each prior comes from
the moments of that level's rates. A host is blocked if the lower posterior bound of its share of bad pages exceeds
the limit. The outcome of a page is its row in `labels` with doc_id equal to page_id: bad if quality is 0 or toxic 1.

Defined results: a null url or one without :// has an empty host and an empty path and shares the empty host's
reputation; labels repeated for a page count once, as the worst; pages without labels have no outcome; without any
label every host is allowed; user and port belong to the host, but not to its domain and suffix; an IP address is its
own domain under no suffix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import keep, read, small

#: (rule, verdict): host and path, the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Suffixes of two labels under which names are registered; a fuller list, of any number of labels, can be given.
TWO_LABELS = ("co.uk", "org.uk", "com.au", "co.jp", "com.br", "co.nz")
LIMIT = 0.5
Z = 1.645


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare(name: Column) -> Column:
    """A host without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*@|:[0-9]*$", ""), r"\.$", "")


def _numeric(name: Column) -> Column:
    return name.rlike(r"^[0-9.]+$|^\[")


def suffix(name: Column, suffixes: tuple[str, ...] = TWO_LABELS) -> Column:
    """The suffix under which a host is registered: the longest listed one, else the last label; an address has none."""
    out = F.substring_index(name, ".", -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        tail = F.substring_index(name, ".", -n)
        out = F.when(tail.isin(*(s for s in suffixes if s.count(".") + 1 == n)), tail).otherwise(out)
    return F.when(_numeric(name), F.lit("")).otherwise(out)


def domain(name: Column, suffixes: tuple[str, ...] = TWO_LABELS) -> Column:
    """The registered domain: the suffix and the label before it; an address is its own."""
    labels = F.size(F.split(suffix(name, suffixes), r"\.")) + 1
    own = F.split(name, r"\.")
    start = F.greatest(F.size(own) - labels + 1, F.lit(1))
    return F.when(_numeric(name), name).otherwise(F.array_join(F.slice(own, start, labels), "."))


def rule(name: Column, at: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):  # longer ones override
        h, p = r[: r.index("/")], r[r.index("/") :]
        fits = ((name == h) | name.endswith("." + h)) & at.startswith(p)
        text, verdict = F.when(fits, F.lit(r)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _strength(rates: DataFrame) -> DataFrame:
    """m, the weight of a level's prior in pages, from the rows (n, bad) of that level."""
    n, bad = F.col("n"), F.col("bad")
    sums = rates.agg(F.count("*").alias("k"), F.sum(n).alias("N"), F.sum(bad).alias("B"), F.sum(n * n).alias("N2"), F.sum(F.round(bad * bad * F.lit(1_000_000.0) / n).cast("long")).alias("Q"))
    p = F.col("B") / F.col("N").cast("double")
    spread = F.col("Q").cast("double") / F.lit(1_000_000.0) - F.col("B") * p
    rho = F.try_divide(spread - p * (1 - p) * (F.col("k") - 1), p * (1 - p) * (F.col("N") - F.col("N2") / F.col("N").cast("double") - (F.col("k") - 1)))
    bounded = F.when(rho.isNull() | F.isnan(rho) | (rho < 0.002), F.lit(0.002)).when(rho > 0.5, F.lit(0.5)).otherwise(rho)
    return sums.select(((1 - bounded) / bounded).alias("m"), F.coalesce(p, F.lit(0.0)).alias("p"))


def reputation(outcomes: DataFrame, limit: float = LIMIT, z: float = Z, suffixes: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """host and verdict for every host of a table (host, bad); bad is null where a page has no outcome."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = keep(hosts.select("host", domain(bare(F.col("host")), suffixes).alias("domain"), suffix(bare(F.col("host")), suffixes).alias("suffix"), "n", "bad"), "hosts")
    domains = keep(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = keep(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    (m1, _), (m2, _), (m3, p) = (tuple(_strength(x.where("n > 0")).first()) for x in (hosts, domains, suffixes))
    of_suffix = suffixes.select("suffix", ((F.lit(m3 * p) + F.col("bad")) / (F.lit(m3) + F.col("n"))).alias("ps"))
    of_domain = domains.join(small(of_suffix), "suffix").select("domain", ((F.lit(m2) * F.col("ps") + F.col("bad")) / (F.lit(m2) + F.col("n"))).alias("pd"))
    a = F.lit(m1) * F.col("pd") + F.col("bad")
    s = F.lit(m1) + F.col("n")
    lower = a / s - F.lit(z) * F.sqrt(a * (s - a) / (s * s * (s + 1)))
    return hosts.join(small(of_domain), "domain").select("host", (a / s).alias("bad_share"), lower.alias("lower"), F.when(lower > limit, "block").otherwise("allow").alias("judged"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and lower, the posterior bound of the host."""
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    worst = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long")).alias("bad"))
    table = keep(reputation(urls.join(worst, "page_id", "left").select("host", "bad"), **options), "reputation")
    text, verdict = rule(F.col("host"), F.col("path"), rules)
    return urls.join(small(table), "host", "left").select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.col("judged")).alias("verdict"), F.round("lower", 9).alias("lower"))


def op6_hosts(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")).drop("lower")


def _sql_strength(table: str) -> str:
    p = "sb / sn::DOUBLE"
    rho = f"((sq::DOUBLE / 1000000.0::DOUBLE - sb * ({p})) - ({p}) * (1 - ({p})) * (k - 1)) / nullif((({p}) * (1 - ({p})) * (sn - sn2 / sn::DOUBLE - (k - 1))), 0)"
    return f"""(SELECT (1 - rho) / rho AS m, coalesce({p}, 0.0::DOUBLE) AS p FROM (SELECT *, CASE WHEN {rho} IS NULL OR {rho} < 0.002 THEN 0.002::DOUBLE WHEN {rho} > 0.5 THEN 0.5::DOUBLE ELSE {rho} END AS rho
      FROM (SELECT count(*) AS k, sum(n)::BIGINT AS sn, sum(bad)::BIGINT AS sb, sum(n * n)::BIGINT AS sn2, sum(round(bad * bad * 1000000.0::DOUBLE / n)::BIGINT)::BIGINT AS sq FROM {table} WHERE n > 0)))"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABELS)
_BARE = r"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '')"
_LAST = lambda k: f"array_to_string(list_slice(string_split({_BARE}, '.'), -{k}, -1), '.')"
_NUMERIC = rf"regexp_matches({_BARE}, '^[0-9.]+$|^\[')"
_RULE = lambda give: "CASE " + " ".join(f"WHEN (host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/'):]}') THEN '{give(r, v)}'" for r, v in sorted(RULES, key=lambda x: (-len(x[0]), x[0]))) + " ELSE {} END"

OP6_SQL = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::BIGINT) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad,
      CASE WHEN {_NUMERIC} THEN {_BARE} WHEN {_LAST(2)} IN ({_TWO}) THEN {_LAST(3)} ELSE {_LAST(2)} END AS domain,
      CASE WHEN {_NUMERIC} THEN '' WHEN {_LAST(2)} IN ({_TWO}) THEN {_LAST(2)} ELSE {_LAST(1)} END AS suffix FROM u LEFT JOIN l USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d GROUP BY suffix),
m1 AS {_sql_strength("h")}, m2 AS {_sql_strength("d")}, m3 AS {_sql_strength("s")},
ps AS (SELECT suffix, (m * p + bad) / (m + n) AS ps FROM s, m3),
pd AS (SELECT domain, (m * ps + bad) / (m + n) AS pd FROM d JOIN ps USING (suffix), m2),
a AS (SELECT host, m * pd + h.bad AS a, m + h.n AS s FROM h JOIN pd USING (domain), m1),
j AS (SELECT host, CASE WHEN a / s - {Z} * sqrt(a * (s - a) / (s * s * (s + 1))) > {LIMIT} THEN 'block' ELSE 'allow' END AS judged FROM a)
SELECT page_id, host, path, {_RULE(lambda r, v: r).format("NULL")} AS rule, {_RULE(lambda r, v: v).format("judged")} AS verdict FROM u LEFT JOIN j USING (host)
"""

QUERIES = {"op6_hosts": op6_hosts}
ORACLE = {"op6_hosts": OP6_SQL}
