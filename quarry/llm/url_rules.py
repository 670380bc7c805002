"""URL filter rules by hashed host-suffix and path-prefix expressions.

A url is expanded into every (host suffix, path prefix) expression whose number of
labels and prefix length occur among the rules. The expressions meet the rules by an
equi-join on the first bytes of their digest; the whole digest then confirms the hit,
and the longest rule wins. Each different url is judged once; the last join brings the
verdicts to the rows by url, with whatever columns they have: select the slim ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, without

#: (host, path, verdict) rules of the query.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Verdict where no rule fits.
DEFAULT = "allow"
#: Hex digits of the digest that the join compares.
SHORT = 8
#: Rule tables of up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """pages with host, path, rule (host + path, null if none fits) and verdict.

    rules: (host, path, verdict); of repeated (host, path) the smallest verdict by name
    counts ("allow" before "block"). A rule fits its host and all subdomains where the
    url's path starts with the rule's; the longest rule text wins, ties go to the longer
    host. Null urls and urls without `://` have empty host and path. Very long urls are
    read whole. Repeated rows are judged alike and stay. Without rules every verdict is the
    default; an empty table gives an empty one. Input columns named like the added ones are
    replaced.
    """
    spark = pages.sparkSession
    given = rules is not None
    if rules is None:
        rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    rules = rules.groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("r_verdict"))
    rules = rules.withColumn("r_labels", F.size(F.split("r_host", "\\."))).withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
    shape = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("r_labels")).alias("labels"), F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths")).first()
    pages = without(pages, "host", "path", "rule", "verdict")
    urls = pages.select(F.col(url).alias("u_url")).where(F.col("u_url").isNotNull()).distinct()
    urls = urls.select("u_url", host_of(F.col("u_url")).alias("host"), path_of(F.col("u_url")).alias("path"))
    label = F.split("host", "\\.")
    ints = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<int>")
    suffixes = F.transform(F.filter(ints(shape["labels"]), lambda n: n <= F.size(label)), lambda n: F.concat_ws(".", F.slice(label, F.size(label) - n + 1, n)))
    prefixes = F.transform(F.filter(ints(shape["lengths"]), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    asked = urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)).withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
    asked = asked.select("u_url", "digest", F.substring("digest", 1, SHORT).alias("short"))
    # the rules of a short prefix together: nearly always one
    keyed = rules.withColumn("r_short", F.substring("r_digest", 1, SHORT)).groupBy("r_short").agg(F.collect_list(F.struct("r_digest", "r_host", "r_path", "r_verdict")).alias("rules"))
    if not given or shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    met = asked.join(keyed, F.col("short") == F.col("r_short")).select("u_url", "digest", F.explode("rules").alias("r"))
    hits = met.where(F.col("digest") == F.col("r.r_digest")).select("u_url", "r.*")
    best = hits.groupBy("u_url").agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    out = pages.join(best, pages[url] == best["u_url"], "left")
    return out.select(*[pages[c] for c in pages.columns], host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
v AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM u),
r(r_host, r_path, r_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT v.*, r.*, row_number() OVER (PARTITION BY rid ORDER BY length(r_host) + length(r_path) DESC NULLS LAST, length(r_host) DESC) AS rn
  FROM v LEFT JOIN r ON (v.host = r_host OR ends_with(v.host, '.' || r_host)) AND starts_with(v.path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""
