"""URL filters by empirical-Bayes host reputation.

Labelled outcomes of pages are counted by host. A beta-binomial prior is handed down from all pages to the suffix, from
there to the registered domain and to the host; each level's prior strength is estimated from how much its groups differ
(ANOVA estimate of the intraclass correlation). A host is blocked if the lower bound of its posterior rate of bad pages
exceeds a limit. Fixed rules go before the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pick, read, stage

#: Verdict and rule; a rule is a host and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labels that make a public suffix of two labels with a country's two letters; any other suffix is the last label.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "govt", "gv", "mil", "ne", "net", "or", "org", "sch")
TWO_LABELS = f"^(?:{'|'.join(SECOND_LABELS)})\\.[a-z][a-z]$"
BLOCK_ABOVE = 0.5
Z = 1.645
#: A prior is worth at least and at most so many labelled pages.
STRENGTH = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, rule).otherwise(found)
    return found


def levels(df: DataFrame) -> DataFrame:
    """suffix and domain of a host; a host of fewer labels is its own domain."""
    two = F.substring_index("host", ".", -2)
    suffix = F.when(two.rlike(TWO_LABELS), two).otherwise(F.substring_index("host", ".", -1))
    domain = F.when(two.rlike(TWO_LABELS), F.substring_index("host", ".", -3)).otherwise(two)
    return df.withColumns({"suffix": suffix, "domain": domain})


def strength(groups: DataFrame, n: str, k: str) -> DataFrame:
    """One row: the prior strength among groups with n outcomes, k of them bad."""
    over = F.try_divide  # levels of one group or none have no differences to measure
    sums = groups.where(F.col(n) > 0).agg(
        F.count("*").alias("j"), F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("k"),
        F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(over(F.col(k) * F.col(k), F.col(n))).alias("kr"),
    )
    between = over(F.col("kr") - over(F.col("k") * F.col("k"), F.col("n")), F.col("j") - 1)
    within = over(F.col("k") - F.col("kr"), F.col("n") - F.col("j"))
    typical = over(F.col("n") - over(F.col("nn"), F.col("n")), F.col("j") - 1)
    rho = over(between - within, between + (typical - 1) * within)
    # Groups that differ no more than chance share most; too few to compare share least.
    m = F.when((F.col("j") > 1) & (F.col("n") > F.col("j")), F.when(rho > 0, over(F.lit(1.0), rho) - 1).otherwise(STRENGTH[1])).otherwise(STRENGTH[0])
    return sums.select(F.least(F.greatest(m, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("m"))


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, n (labelled pages), posterior_mean and posterior_low of bad pages for every host of pages(page_id, host).

    outcomes(page_id, bad 0/1). Only counts by host go further; a host with any number of pages is one row after partial sums.
    """
    counts = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    hosts = stage(levels(counts), "hosts")  # the three priors and the levels below read it again
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    whole = suffixes.agg(((F.sum("sk") + 1) / (F.sum("sn") + 2)).alias("top"))
    ms = [strength(g, n, k).withColumnRenamed("m", f"m{i}") for i, (g, n, k) in enumerate(((suffixes, "sn", "sk"), (domains, "dn", "dk"), (hosts, "n", "k")))]
    prior = whole.crossJoin(ms[0]).crossJoin(ms[1]).crossJoin(ms[2])  # one row each
    s = suffixes.crossJoin(F.broadcast(prior)).withColumn("sp", (F.col("sk") + F.col("m0") * F.col("top")) / (F.col("sn") + F.col("m0")))
    d = domains.join(s, "suffix").withColumn("dp", (F.col("dk") + F.col("m1") * F.col("sp")) / (F.col("dn") + F.col("m1")))
    a = F.col("k") + F.col("m2") * F.col("dp")
    size = F.col("n") + F.col("m2")
    h = hosts.join(d.select("domain", "suffix", "dp", "m2"), ["suffix", "domain"]).withColumn("mean", a / size)
    low = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return h.select("host", "n", F.round("mean", 6).alias("posterior_mean"), F.round(low, 6).alias("posterior_low"))


def filter_urls(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", rules: tuple = RULES, block_above: float = BLOCK_ABOVE
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, posterior_mean and posterior_low for every row of pages.

    A page's outcome is bad if any of its labels says low quality or toxic; null labels say nothing. A null url or one
    without `://` has empty host and path. Null ids have no outcome; repeated rows give a row each; a repeated label
    counts once. Empty tables give empty results, or the prior alone. Other columns are not read.
    """
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    judged = pick(labels, page_id=label_id, quality="quality", toxic="toxic").where("quality is not null or toxic is not null")
    outcomes = judged.groupBy("page_id").agg(F.max(bad).alias("bad"))
    df = pick(pages, page_id=page_id, url=url).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Rows that repeat an id are one page to its host's counts.
    known = reputation(df.select("page_id", "host").distinct(), outcomes)
    out = df.join(known, "host").withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    said = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)])[F.col("rule")]
    method = F.when(F.col("posterior_low") > block_above, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(said, method).alias("verdict"), F.col("n").alias("n_labelled"), "posterior_mean", "posterior_low")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def _sql() -> str:
    last = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
    m = lambda t, n, k: f"""(select least(greatest(case when j > 1 and n > j then case when (b - w) / nullif(b + (t0 - 1) * w, 0) > 0 then 1 / ((b - w) / (b + (t0 - 1) * w)) - 1 else {STRENGTH[1]} end else {STRENGTH[0]} end, {STRENGTH[0]}), {STRENGTH[1]}) from (
      select j, n, (kr - k * k / n) / nullif(j - 1, 0) as b, (k - kr) / nullif(n - j, 0) as w, (n - nn / n) / nullif(j - 1, 0) as t0
      from (select count(*)::double as j, sum({n})::double as n, sum({k})::double as k, sum({n} * {n})::double as nn, sum({k} * {k} / {n}::double) as kr from {t} where {n} > 0)))"""  # noqa: E731
    case = " ".join(
        f"when (host = '{r[: r.index('/')]}' or ends_with(host, '.{r[: r.index('/')]}')) and starts_with(path, '{r[r.index('/') :]}') then '{r}'" for _, r in sorted(RULES, key=lambda r: -len(r[1]))
    )
    said = " ".join(f"when '{r}' then '{v}'" for v, r in RULES)
    return f"""
with df as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)
), outcomes as (
  select doc_id as page_id, max((coalesce(quality = 0, false) or coalesce(toxic = 1, false))::int) as bad from labels where quality is not null or toxic is not null group by 1
), counts as (
  select host, count(bad) as n, coalesce(sum(bad), 0) as k from (select distinct page_id, host from df) left join outcomes using (page_id) group by 1
), hosts as (
  select *, case when regexp_matches({last(2)}, '{TWO_LABELS}') then {last(2)} else {last(1)} end as suffix, case when regexp_matches({last(2)}, '{TWO_LABELS}') then {last(3)} else {last(2)} end as domain from counts
), domains as (select suffix, domain, sum(n) as dn, sum(k) as dk from hosts group by 1, 2),
suffixes as (select suffix, sum(dn) as sn, sum(dk) as sk from domains group by 1),
prior as (select (select (sum(sk) + 1) / (sum(sn) + 2)::double from suffixes) as top, {m('suffixes', 'sn', 'sk')} as m0, {m('domains', 'dn', 'dk')} as m1, {m('hosts', 'n', 'k')} as m2),
s as (select *, (sk + m0 * top) / (sn + m0) as sp from suffixes, prior),
d as (select *, (dk + m1 * sp) / (dn + m1) as dp from domains join s using (suffix)),
h as (select host, n, n + m2 as size, (k + m2 * dp) / (n + m2) as mean from hosts join d using (suffix, domain)),
known as (select host, n, round(mean, 6) as posterior_mean, round(mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)), 6) as posterior_low from h),
ruled as (select *, case {case} end as rule from df join known using (host))
select page_id, host, path, rule, coalesce(case rule {said} end, case when posterior_low > {BLOCK_ABOVE} then 'block' else 'allow' end) as verdict, cast(n as bigint) as n_labelled, posterior_mean, posterior_low from ruled
"""


OP3_SQL = _sql()
