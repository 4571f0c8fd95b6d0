"""URL filters: explicit rules, and for every other url the empirical-Bayes reputation of its host.

Labelled outcomes of pages (bad or not) are counted by host. Each level shrinks to the one above it - host to registered domain,
domain to suffix, suffix to all pages - by a beta prior whose mean is the parent's posterior mean and whose strength is the
level's own, from the moments of the beta-binomial over all units of the level. A host is blocked if even the
lower bound of its posterior rate of bad pages is over MAX_BAD; a host without labels inherits its domain's mean with a wide
posterior, so it is blocked only where the domain as a whole is known to be bad.

Edge cases: a null url or one without ``://`` has an empty host and path and is judged as the host ''; null outcomes don't
count; repeated page rows give repeated results; without labels every host is at the neutral prior and is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm._shared import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host and path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Suffixes of two labels, the default of a parameter. It is a short list; callers with many registries pass a longer one.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
MAX_BAD, Z, LEAST_RHO, MOST_RHO = 0.5, 1.645, 0.001, 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"


def domain_columns(host: Column, suffixes=LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, whose user and port don't count.

    The suffix is the last label, or the last two if they are one of ``suffixes``. The domain and suffix of an address are the address.
    """
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*suffixes)
    address = name.rlike(ADDRESS)
    return F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two), F.when(address, name).when(long, two).otherwise(F.substring_index(name, ".", -1))


def strength(units: DataFrame) -> float:
    """Pseudo-counts of a level's prior from units (n, k, m): outcomes, bad ones, and the parent's mean."""
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    s = units.agg(F.sum((k - n * m) ** 2 - n * m * (1 - m)).alias("over"), F.sum(n * (n - 1) * m * (1 - m)).alias("room")).first()
    rho = (s["over"] or 0.0) / s["room"] if s["room"] else MOST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def shrunk(k: Column, n: Column, s: float, m: Column) -> Column:
    return (k + s * m) / (n + s)


def host_reputation(outcomes: DataFrame, hosts: DataFrame, suffixes=LONG_SUFFIXES) -> DataFrame:
    """(host, mean, bound) for each of ``hosts`` (distinct) from ``outcomes`` (host, bad 0/1)."""
    counts = outcomes.where("bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    domain, suffix = domain_columns(F.col("host"), suffixes)
    h = written(hosts.join(counts, "host", "left").select("host", domain.alias("domain"), suffix.alias("suffix"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k")), "hosts")
    total = F.sum("n").alias("n"), F.sum("k").alias("k")
    d = written(h.groupBy("domain", "suffix").agg(*total), "domains")
    x = written(d.groupBy("suffix").agg(*total), "suffixes")
    top = x.agg(*total).first()
    m0 = ((top["k"] or 0) + 1) / ((top["n"] or 0) + 2)
    s1 = strength(x.withColumn("m", F.lit(m0)))
    x = x.select("suffix", shrunk(F.col("k"), F.col("n"), s1, F.lit(m0)).alias("m"))
    below = d.join(x, "suffix")
    s2 = strength(below)
    d = written(below.select("domain", "suffix", shrunk(F.col("k"), F.col("n"), s2, F.col("m")).alias("m")), "domains")
    below = h.join(d, ["domain", "suffix"])
    s3 = strength(below)
    a, b = F.col("k") + s3 * F.col("m"), F.col("n") - F.col("k") + s3 * (1 - F.col("m"))
    mean = a / (a + b)
    return below.select("host", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"))


def url_filters(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", suffixes=LONG_SUFFIXES) -> DataFrame:
    """Host, path, rule and verdict of every page; labels are (doc_id, quality, toxic) of the pages with these ids."""
    host, path = parts(F.col(url_col))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long"))
    outcomes = seen.join(labels.select(F.col("doc_id").alias(id_col), bad.alias("bad")), id_col).select("host", "bad")
    known = written(host_reputation(outcomes, seen.select("host").distinct(), suffixes), "reputation")
    verdict = F.coalesce(said, F.when(F.col("bound") > MAX_BAD, "block").otherwise("allow"))
    return seen.join(known, "host").select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.round("bound", 6).alias("bad_bound"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    """The same in DuckDB."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, said) for said, h, p in ordered]
    rule = "case " + " ".join(f"when {t} then '{r}'" for t, r, _ in fits) + " end"
    said = "case " + " ".join(f"when {t} then '{v}'" for t, _, v in fits) + " end"
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    last = lambda n: f"array_to_string(list_slice(string_split(name, '.'), -{n}, -1), '.')"
    address = f"regexp_matches(name, '{ADDRESS}')"
    rho = lambda units: f"(select 1 / least(greatest(case when coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 then {MOST_RHO} else sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) end, {LEAST_RHO}), {MOST_RHO}) - 1 from {units})"
    return f"""
with seen as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
counts as (
  select host, count(*) as n, sum(case when quality = 0 or toxic = 1 then 1 else 0 end) as k
  from seen join labels on page_id = doc_id where quality is not null or toxic is not null group by host),
h as materialized (
  select host, case when {address} then name when {last(2)} in ({long}) then {last(3)} else {last(2)} end as domain, case when {address} then name when {last(2)} in ({long}) then {last(2)} else {last(1)} end as suffix,
    coalesce(n, 0)::double as n, coalesce(k, 0)::double as k
  from (select distinct host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', '') as name from seen) left join counts using (host)),
d as materialized (select domain, suffix, sum(n) as n, sum(k) as k from h group by all),
x as materialized (select suffix, sum(n) as n, sum(k) as k from d group by all),
x0 as materialized (select x.*, (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) from x) as m from x),
x1 as materialized (select suffix, (k + s * m) / (n + s) as m from x0, (select {rho("x0")} as s)),
d0 as materialized (select d.*, m from d join x1 using (suffix)),
d1 as materialized (select domain, suffix, (k + s * m) / (n + s) as m from d0, (select {rho("d0")} as s)),
h0 as materialized (select h.*, m from h join d1 using (domain, suffix)),
h1 as (select host, k + s * m as a, n - k + s * (1 - m) as b from h0, (select {rho("h0")} as s)),
known as (select host, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as bound from h1)
select page_id, host, path, {rule} as rule, coalesce({said}, case when bound > {MAX_BAD} then 'block' else 'allow' end) as verdict, round(bound, 6) as bad_bound
from seen join known using (host)
"""
