"""URL filter: host and path rules first, then an empirical-Bayes reputation of the host.

Labelled pages vote for their host. Few votes say little, so the share of bad pages of a host is shrunk towards
that of its registered domain, that towards its suffix, and that towards the whole: at each level the parent's
mean is the mean of a beta prior whose strength comes from how much the children really differ (method of
moments over all of them). A page is blocked when even the lower bound of its host's posterior is above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]
#: Bounds on the strength of a prior, in pages.
LEAST, MOST = 1.0, 1000.0
LIMIT, Z = 0.3, 1.645

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and starts the path, else null."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the last that fits is the longest
        at, _, start = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{start}"))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels) and suffix (the last)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domain = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    return domain, F.element_at(labels, -1)


def _shrink(children: DataFrame, parents: DataFrame, by: str) -> DataFrame:
    """Posterior of each child: the prior has its parent's mean and a strength estimated over all children.

    The strength is one row, joined by broadcast. Children without votes get their parent's mean.
    """
    both = children.join(parents.select(by, F.col("mean").alias("prior")), by)
    one = both.where("n > 0").agg(
        F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("spread"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("within"))
    v = F.col("within") / F.col("N")
    between = (F.col("spread") - (F.col("k") - 1) * v) / (F.col("N") - F.col("N2") / F.col("N"))
    share = F.when((F.col("k") > 1) & (v > 0) & (F.col("N") * F.col("N") > F.col("N2")), between / v)
    strength = F.when(share > 0, F.least(F.greatest(1 / share - 1, F.lit(LEAST)), F.lit(MOST))).otherwise(F.lit(MOST))
    out = both.crossJoin(F.broadcast(one.select(strength.alias("strength"))))  # one row, no groups
    a = F.col("prior") * F.col("strength") + F.col("bad")
    total = F.col("strength") + F.col("n")
    mean = a / total
    return out.select(*children.columns, mean.alias("mean"),
                      F.sqrt(mean * (1 - mean) / (total + 1)).alias("sd"))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """Posterior mean and deviation of the share of bad pages, for each host of (host, n, bad).

    n and bad count a host's labelled and bad pages. Hosts without labels get what their domain has.
    """
    domain, suffix = _levels(F.col("host"))
    hosts = hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix"))
    up = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*up)
    suffixes = domains.groupBy("suffix").agg(*up).withColumn("all", F.lit(1))
    top = suffixes.groupBy("all").agg(*up).select("all", ((F.col("bad") + 1) / (F.col("n") + 2)).alias("mean"))
    suffixes = _shrink(suffixes, top, "all")
    domains = _shrink(domains, suffixes, "suffix")
    return _shrink(hosts, domains, "domain").select("host", "n", "bad", "mean", "sd")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """Verdict on each URL of ``pages`` (page_id, url); ``labels`` (doc_id, quality, toxic) are outcomes of pages.

    A labelled page is bad if its quality is 0 or it is toxic; labels that are both null don't vote, repeated
    labels of one page vote once (bad if any is). Returns page_id, host, path, rule, verdict, n_labelled long,
    bad_mean and bad_low double. Rows are kept one for one; a null or odd URL has an empty host, which is a host of
    its own. Only the counts by host are shuffled whole; a host with very many pages is summed before it moves.
    """
    host, path = parts(F.col("url"))
    rule, by_rule = matching_rule(F.col("host"), F.col("path"), rules)
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    votes = labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce("quality", F.lit(1)) == 0)
                          | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("bad"),
                          F.coalesce("quality", "toxic").alias("known"))
    votes = votes.where("known is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.select("page_id", "host").join(votes, "page_id", "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    posterior = host_reputation(hosts).select(
        "host", F.col("n").alias("n_labelled"), F.round("mean", 9).alias("bad_mean"),
        F.round(F.greatest(F.col("mean") - z * F.col("sd"), F.lit(0.0)), 9).alias("bad_low"))
    judged = F.when(F.col("bad_low") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return pages.join(posterior, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, judged).alias("verdict"),
        "n_labelled", "bad_mean", "bad_low")


def _sql_shrink(name: str, children: str, parents: str, by: str, keep: str) -> str:
    return f"""
{name}_b as (select c.*, p.mean as prior from {children} c join {parents} p on c.{by} = p.{by}),
{name}_s as (select sum(n)::double N, sum(n * n)::double N2, count(*)::double k,
                    sum(n * pow(bad / n - prior, 2)) spread, sum(n * prior * (1 - prior)) within_
             from {name}_b where n > 0),
{name}_v as (select case when k > 1 and within_ > 0 and N * N > N2
                         then ((spread - (k - 1) * within_ / N) / (N - N2 / N)) / (within_ / N) end as share
             from {name}_s),
{name}_k as (select case when share > 0 then least(greatest(1 / share - 1, {LEAST}), {MOST}) else {MOST} end
                    as strength from {name}_v),
{name}_m as (select b.*, (prior * strength + bad) / (strength + n) as mean, strength + n as total
             from {name}_b b, {name}_k),
{name} as (select {keep}, n, bad, mean, sqrt(mean * (1 - mean) / (total + 1)) as sd from {name}_m)"""


def oracle_sql() -> str:
    """DuckDB SQL of ``filter_urls(pages, labels)`` with its defaults."""
    case = lambda value: "case " + " ".join(
        f"when (host = '{t.split('/')[0]}' or ends_with(host, '.{t.split('/')[0]}')) "
        f"and starts_with(path, '/{t.partition('/')[2]}') then '{value(k, t)}'"
        for k, t in sorted(RULES, key=lambda r: -len(r[1]))) + " end"
    return f"""
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest
             from pages),
p as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
votes as (select doc_id as page_id,
                 max((coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1)::int) as bad
          from labels where coalesce(quality, toxic) is not null group by 1),
hosts as (select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as bad,
                 array_to_string((string_split(host, '.'))[-2:], '.') as domain,
                 (string_split(host, '.'))[-1] as suffix
          from p left join votes using (page_id) group by host),
domains0 as (select domain, suffix, sum(n) n, sum(bad) bad from hosts group by 1, 2),
suffixes0 as (select suffix, 1 as one, sum(n) n, sum(bad) bad from domains0 group by 1),
top as (select 1 as one, (sum(bad) + 1) / (sum(n) + 2) as mean from suffixes0),
{_sql_shrink('suffixes', 'suffixes0', 'top', 'one', 'suffix')},
{_sql_shrink('domains', 'domains0', 'suffixes', 'suffix', 'domain')},
{_sql_shrink('rep', 'hosts', 'domains', 'domain', 'host')}
select page_id, host, path, {case(lambda k, t: t)} as rule,
       coalesce({case(lambda k, t: k)},
                case when round(greatest(mean - {Z} * sd, 0), 9) > {LIMIT} then 'block' else 'allow' end) as verdict,
       n::bigint as n_labelled, round(mean, 9) as bad_mean, round(greatest(mean - {Z} * sd, 0), 9) as bad_low
from p left join rep using (host)"""
