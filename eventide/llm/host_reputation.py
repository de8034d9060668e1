"""URL filter by empirical-Bayes host reputation (operator 7), JVM-side only.

Labelled outcomes of pages (1 = poor) are counted per host. Rates shrink level by level: the
corpus rate is the prior of each public suffix, the suffix posterior of each registered domain,
that of each host. Priors are beta distributions: mean from the level above, strength estimated
from the spread of the children's rates (method of moments, within ``STRENGTH``). A page is
blocked if the lower bound of its host's posterior, ``Z`` standard deviations below the mean,
exceeds ``MAX_RATE``: few labels never block by themselves, many poor ones do. Listed rules come
before the model's verdict.

Counting and joining happen per host, so a host with a third of the pages costs one row; its pages
meet that row in a join left to Spark's skew handling.

A null url, or one without ``://``, has empty host and path and belongs to the reputation of the
empty host. Null labels are no outcome; repeated labels of a page count once (poor if any is);
repeated pages are judged each. Empty tables give no rows; without any label everything that no
rule blocks is allowed. Input columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import read
from eventide.session import cut_lineage

Z = 1.645
MAX_RATE = 0.5
STRENGTH = (2.0, 200.0)
#: public suffixes of two labels; every other suffix is the last label
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
#: (rule, verdict): host, then the start of the path
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), *_A_Z), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix(host: Column) -> Column:
    """Public suffix; an address of digits has itself."""
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return (F.when(host.rlike(r"^[0-9.]+(:[0-9]+)?$") | host.startswith("["), host)
            .when(two.isin(*LONG_SUFFIXES), two)
            .otherwise(F.element_at(F.split(host, r"\."), -1)))


def domain(host: Column) -> Column:
    """Registered domain: one label more than the suffix, or the host itself if it has none."""
    s = suffix(host)
    label = F.regexp_extract(F.substring(host, F.lit(1), F.length(host) - F.length(s) - 1), r"([^.]*)$", 1)
    return F.when(F.length(host) <= F.length(s) + 1, host).otherwise(F.concat_ws(".", label, s))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does.

    Rules are configuration, spelled into the plan; keep them to some hundreds.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _prior_strength(children: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate, strength) from children's counts (n, bad); Laplace-smoothed rate.

    Over children of at least two labels, the variance of their rates less the part expected from
    sampling gives rate * (1 - rate) / (strength + 1).
    """
    low, high = STRENGTH
    lab = children.groupBy(*by).agg(
        F.sum("bad").alias("b"), F.sum("n").alias("m"),
        F.var_pop(F.when(F.col("n") >= 2, F.col("bad") / F.col("n"))).alias("spread"),
        F.avg(F.when(F.col("n") >= 2, 1 / F.col("n"))).alias("inverse"))
    rate = (F.col("b") + 1) / (F.col("m") + 2)
    noise = rate * (1 - rate)
    # spread = noise * (inverse + (1 - inverse) / (strength + 1))
    share = (F.col("spread") / noise - F.col("inverse")) / (1 - F.col("inverse"))
    strength = F.when(share.isNull() | (share <= 0), high).otherwise(
        F.least(F.lit(high), F.greatest(F.lit(low), 1 / share - 1)))
    return lab.select(*by, "b", "m", rate.alias("rate"), strength.alias("strength"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, rate, bound) for every host of ``outcomes(host, n, bad)`` with one row per host."""
    h = outcomes.select("host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad")
    h = cut_lineage(h, "hosts")
    doms = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sufs = h.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = _prior_strength(sufs, []).first()  # two numbers, null for an empty table
    p0, k0 = F.lit(top["rate"] or 0.5), F.lit(top["strength"] or STRENGTH[1])
    suf = _prior_strength(doms, ["suffix"])
    mean_s = (F.col("b") + k0 * p0) / (F.col("m") + k0)
    suf = suf.select("suffix", mean_s.alias("p1"), F.col("strength").alias("k1"))
    dom = _prior_strength(h, ["suffix", "domain"]).join(suf, "suffix")
    mean_d = (F.col("b") + F.col("k1") * F.col("p1")) / (F.col("m") + F.col("k1"))
    dom = dom.select("suffix", "domain", mean_d.alias("p2"), F.col("strength").alias("k2"))
    a = F.col("bad") + F.col("k2") * F.col("p2")
    b = F.col("n") - F.col("bad") + F.col("k2") * (1 - F.col("p2"))
    rate = a / (a + b)
    return (h.join(dom, ["suffix", "domain"])
            .select("host", rate.alias("rate"),
                    (rate - Z * F.sqrt(rate * (1 - rate) / (a + b + 1))).alias("bound")))


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages(page_id, url)`` plus host, path, rule, verdict, rate and bound.

    ``outcomes(host, bad)`` has a row for each labelled page.
    """
    p = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    counts = (p.select("host", F.lit(0).alias("n"), F.lit(0).alias("bad"))
              .unionAll(outcomes.where("bad is not null").select("host", F.lit(1).alias("n"), F.col("bad").cast("int").alias("bad")))
              .groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    rep = cut_lineage(reputation(counts), "reputation")
    fit = rule_of(F.col("host"), F.col("path"), rules)
    return (p.join(rep, "host").withColumn("_fit", fit)
            .select("page_id", "url", "host", "path", F.col("_fit.rule").alias("rule"),
                    F.coalesce(F.col("_fit.verdict"),
                               F.when(F.col("bound") > MAX_RATE, "block").otherwise("allow")).alias("verdict"),
                    "rate", "bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): outcomes of pages whose document is labelled.

    A page shows the document named by the number that ends its path; bad is a label of low
    quality or of toxicity.
    """
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})(\.html)?/?$", 1)
    shown = pages.select(host(F.col("url")).alias("host"),
                         F.when(F.length(number) > 0, number.cast("long")).alias("doc"))
    poor = F.greatest(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0),
                      F.when(F.col("toxic") > 0, 1).when(F.col("toxic").isNotNull(), 0))
    lab = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.max(poor).alias("bad"))
    return shown.join(lab, "doc").select("host", "bad")


def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: the verdict on every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    out = judged(pages, page_outcomes(pages, read(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bound", 9).alias("bound"))


def _prior_sql(children: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}b, m, rate, CASE WHEN share IS NULL OR share <= 0 THEN 200.0
       ELSE least(200.0, greatest(2.0, 1 / share - 1)) END AS strength FROM (
  SELECT *, (spread / (rate * (1 - rate)) - inverse) / nullif(1 - inverse, 0) AS share FROM (
    SELECT {keys}sum(bad) AS b, sum(n) AS m, (sum(bad) + 1) / (sum(n) + 2) AS rate,
           var_pop(CASE WHEN n >= 2 THEN bad / n END) AS spread, avg(CASE WHEN n >= 2 THEN 1 / n END) AS inverse
    FROM {children} {"GROUP BY " + by if by else ""}))"""


REPUTATION_SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u
           FROM pages),
p AS (SELECT page_id, translate(regexp_extract(u, '(?s)^([^/?#]*)', 1), '{_A_Z[0]}', '{_A_Z[1]}') AS host,
             regexp_extract(u, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
s AS (SELECT *, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS two FROM p),
f AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') OR starts_with(host, '[') THEN host
                     WHEN two IN {LONG_SUFFIXES} THEN two ELSE split_part(host, '.', -1) END AS suffix FROM s),
q AS (SELECT page_id, host, path, suffix,
             CASE WHEN length(host) <= length(suffix) + 1 THEN host
                  ELSE regexp_extract(substr(host, 1, length(host) - length(suffix) - 1), '([^.]*)$', 1) || '.' || suffix
             END AS domain FROM f),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic > 0 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
      FROM labels GROUP BY doc_id),
h AS (SELECT q.host, q.domain, q.suffix, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad
      FROM q LEFT JOIN o ON o.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(\.html)?/?$', 1) AS BIGINT)
      GROUP BY 1, 2, 3),
dm AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
sf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1),
r0 AS ({_prior_sql("sf", "")}),
r1 AS (SELECT x.suffix, (x.b + r0.strength * r0.rate) / (x.m + r0.strength) AS p1, x.strength AS k1
       FROM ({_prior_sql("dm", "suffix")}) x, r0),
r2 AS (SELECT x.domain, (x.b + k1 * p1) / (x.m + k1) AS p2, x.strength AS k2
       FROM ({_prior_sql("h", "suffix, domain")}) x JOIN r1 ON r1.suffix = x.suffix),
ab AS (SELECT host, bad + k2 * p2 AS a, n - bad + k2 * (1 - p2) AS b FROM h JOIN r2 ON r2.domain = h.domain),
bd AS (SELECT host, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM ab),
v AS (SELECT page_id, q.host, path, bound, CASE
        WHEN (q.host = 'example.net' OR ends_with(q.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (q.host = 'example.com' OR ends_with(q.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (q.host = 'org' OR ends_with(q.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (q.host = 'net' OR ends_with(q.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM q JOIN bd ON bd.host = q.host)
SELECT page_id, host, path, rule, round(bound, 9) AS bound,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
                 WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN bound > {MAX_RATE} THEN 'block' ELSE 'allow' END END AS verdict
FROM v
"""
