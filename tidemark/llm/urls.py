"""URL verdicts: explicit rules first, then the host's reputation, in DataFrame functions only.

A host's share of good pages is shrunk towards its registered domain's, that towards its suffix's, and
that towards the whole, by beta-binomial priors whose strength is estimated from how much the shares of
hosts (domains, suffixes) vary around their parents. A host is blocked only if even the upper bound of
its posterior is below the threshold, so few labels block nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import stage
from .tables import read

#: A host is blocked if its posterior mean plus Z standard deviations is below THRESHOLD.
THRESHOLD, Z = 0.5, 1.645
#: Limits of the estimated correlation of pages within a group; 1 / correlation - 1 is the prior's weight in pages, 2 at least.
LEAST, MOST = 0.001, 1 / 3

#: Rules of the query: verdict, and host and path prefix as one text.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    after = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: str) -> Column:
    after = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`pages` (host, path and any other columns) with rule and rule_verdict, null where no rule fits.

    rules: (verdict, rule), a rule being a host and a path prefix. One left join for each number of labels
    that rules' hosts have; the longest fitting rule wins, of equal ones the later in the alphabet, then
    block. Null rules fit nothing. The rules of one host are one array, so no row multiplies."""
    split = rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).select(
        F.regexp_extract("rule", "^[^/]*", 0).alias("_host"),
        F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("_path"),
        "rule",
        "verdict",
    )
    by_host = split.groupBy("_host").agg(
        F.collect_set(F.struct(F.length("rule").alias("n"), "rule", "verdict", F.col("_path").alias("path"))).alias("_rules")
    )
    labels = [r[0] for r in split.select(F.size(F.split("_host", r"\.")).alias("k")).distinct().orderBy("k").collect()]
    best = []
    for k in labels:
        tail = F.when(F.size(F.split("host", r"\.")) >= k, F.substring_index("host", ".", -k))
        own = by_host.withColumnsRenamed({"_host": f"_host{k}", "_rules": f"_rules{k}"})
        pages = pages.join(own, tail == F.col(f"_host{k}"), "left")
        best.append(F.array_max(F.filter(f"_rules{k}", lambda r: F.col("path").startswith(r["path"]))))
    winner = F.greatest(*best, *best[:1]) if best else F.lit(None).cast("struct<n int, rule string, verdict string>")
    named = pages.withColumn("_best", winner)
    named = named.withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")})
    return named.drop("_best", *[f"_{x}{k}" for k in labels for x in ("host", "rules")])


def _level(groups: DataFrame, key: str) -> DataFrame:
    """groups (key, n, good, prior) with `mean`: the posterior mean after this level's beta-binomial prior."""
    p = F.col("prior")
    terms = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - p, F.lit(2))).alias("spread"),
        F.sum(p * (1 - p)).alias("noise"),
        F.sum((F.col("n") - 1) * p * (1 - p)).alias("more"),
    ).first()
    rho = (terms.spread - terms.noise) / terms.more if terms.more else LEAST
    weight = 1 / min(max(rho, LEAST), MOST) - 1
    return groups.withColumns({"a": F.col("good") + weight * p, "b": F.col("n") - F.col("good") + weight * (1 - p)}).withColumn(
        "mean", F.col("a") / (F.col("a") + F.col("b"))
    )


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, good, mean, upper) of every host of pages (page_id, host) from outcomes (page_id, good 0 or 1).

    Pages without an outcome count for nothing; null outcomes and page_ids are left out; a page with two
    outcomes counts with both. Without any outcome the mean is 0.5 everywhere."""
    known = outcomes.where(F.col("good").isNotNull() & F.col("page_id").isNotNull())
    labelled = pages.select("page_id", "host").join(known, "page_id", "left")
    hosts = stage(
        labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")), "hosts"
    )
    hosts = hosts.withColumns(
        {"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)}
    )
    total = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    base = total.good / total.n if total.n else 0.5
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    suffixes = _level(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(base)), "suffix")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    domains = _level(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"), "domain")
    rated = _level(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), "host")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return rated.select("host", "n", "good", "mean", (F.col("mean") + Z * spread).alias("upper"))


def url_verdicts(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation, upper) of every row of pages (page_id, url).

    A null url or one without `://` has an empty host and path, fits no rule and is judged by the
    reputation of the empty host. Repeated rows stay; an empty table gives no rows; other columns of pages
    are not read. The last join is on the host: a host with a third of all pages is split by AQE."""
    parts = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    rated = host_reputation(parts, outcomes).select("host", F.col("mean").alias("reputation"), "upper")
    judged = with_rules(parts, rules).join(rated, "host")
    by_method = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    verdict = F.coalesce("rule_verdict", by_method).alias("verdict")
    return judged.select("page_id", "host", "path", "rule", verdict, "reputation", "upper")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    values = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, rule)")
    found = url_verdicts(read(spark, sf_dir, "pages"), rules, labels)
    return found.select("page_id", "host", "path", "rule", "verdict")


def _sql_level(name: str, source: str) -> str:
    return f"""{name}_rho AS (SELECT 1 / least(greatest(CASE WHEN coalesce(sum((n - 1) * prior * (1 - prior)), 0) = 0 THEN {LEAST}
    ELSE (sum(n * power(good / n - prior, 2)) - sum(prior * (1 - prior))) / sum((n - 1) * prior * (1 - prior)) END, {LEAST}), {MOST}) - 1 AS w
    FROM {source} WHERE n > 0),
  {name} AS (SELECT *, (good + w * prior) / (n + w) AS mean, n + w AS ab FROM {source}, {name}_rho)"""


OP9_SQL = f"""
WITH rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}),
  split AS (SELECT verdict, rule, regexp_extract(rule, '^[^/]*', 0) AS h, regexp_extract(rule, '^[^/]*(.*)$', 1) AS p FROM rules),
  cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
  parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
  hosts AS (SELECT host, count(quality) AS n, coalesce(sum(quality), 0)::DOUBLE AS good,
    array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix
    FROM parts LEFT JOIN labels ON page_id = doc_id GROUP BY host),
  s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT coalesce(sum(good) / nullif(sum(n), 0), 0.5) FROM hosts) AS prior
    FROM hosts GROUP BY suffix),
  {_sql_level("s1", "s0")},
  d0 AS (SELECT domain, sum(h.n) AS n, sum(h.good) AS good, any_value(s1.mean) AS prior FROM hosts h JOIN s1 USING (suffix) GROUP BY domain),
  {_sql_level("d1", "d0")},
  h0 AS (SELECT h.host, h.n, h.good, d1.mean AS prior FROM hosts h JOIN d1 USING (domain)),
  {_sql_level("h1", "h0")},
  best AS (SELECT *, (SELECT max(struct_pack(n := length(rule), r := rule, v := verdict)) FROM split
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS b FROM parts)
SELECT page_id, host, path, b.r AS rule,
  coalesce(b.v, CASE WHEN mean + {Z} * sqrt(mean * (1 - mean) / (ab + 1)) < {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM best JOIN h1 USING (host)
"""
