"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes (native)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, host, path) of the rules that the query fixes.
QUERY_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hex digits of the digest that the equi-join compares: 4 bytes.
PREFIX = 8


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules as a frame of (verdict, host, path)."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    if not rows:
        return spark.sql("SELECT '' verdict, '' host, '' path WHERE false")
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row (id, host, path, rule, verdict) for each input row.

    A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's.
    The rule with the longest host + path wins; of equally long ones that with the longer host, then a block.
    No rule: null and ``default``. Null urls and urls without ``://`` have an empty host and path, which no rule
    fits. Repeated rows stay repeated. Null rules count as absent; extra columns are ignored.

    Plan: distinct (host, path) -> explode to suffix x prefix expressions, no deeper than the deepest rule ->
    equi-join with the rules on 4 bytes of SHA-256 -> confirm the full digest at the rule's own length ->
    best rule per (host, path) -> left join back of the rows that have a host; the others, one value however many, pass by. A rule is found under its path up to the last ``/``, so rules
    that end inside a segment work too. Only sides that the planner has measured are broadcast.
    """
    judged = urls.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_h"), path_of(F.col(url_col)).alias("_p"))
    ruled = rules.select(
        F.col("verdict").alias("_v"), ascii_lower(F.col("host")).alias("_rh"), F.col("path").alias("_rp")
    ).where("_v IS NOT NULL AND _rh IS NOT NULL AND _rh <> '' AND _rp IS NOT NULL")
    anchored = ruled.select(
        "_v", "_rh", "_rp", F.sha2(F.concat("_rh", "_rp"), 256).alias("_full"),
        F.substring(F.sha2(F.concat("_rh", F.regexp_extract("_rp", r"(?s)\A(.*/)?", 0)), 256), 1, PREFIX).alias("_key"),
    )
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    depth = ruled.agg(F.max(count(F.col("_rh"), ".")), F.max(count(F.col("_rp"), "/"))).first()
    labels, slashes = (depth[0] or 0) + 1, depth[1] or 0
    places = judged.select("_h", "_p").where("_h <> ''").distinct()
    suffixes = places.select(
        "_h", "_p",
        F.explode(F.expr(f"transform(sequence(1, least({labels}, 1 + length(_h) - length(replace(_h, '.', '')))), k -> substring_index(_h, '.', -k))")).alias("_s"),
    )
    expressions = suffixes.select(
        "_h", "_p", "_s",
        F.explode(F.expr(f"transform(sequence(0, least({slashes}, length(_p) - length(replace(_p, '/', '')))), k -> if(k = 0, '', concat(substring_index(_p, '/', k), '/')))")).alias("_x"),
    ).withColumn("_key", F.substring(F.sha2(F.concat("_s", "_x"), 256), 1, PREFIX))
    fits = expressions.join(anchored, "_key").where(
        (F.col("_s") == F.col("_rh")) & (F.sha2(F.concat("_s", F.expr("substring(_p, 1, length(_rp))")), 256) == F.col("_full"))
    )
    best = fits.groupBy("_h", "_p").agg(
        F.max(F.struct(
            F.length(F.concat("_rh", "_rp")).alias("n"), F.length("_rh").alias("h"), (F.col("_v") == "block").alias("b"),
            F.concat("_rh", "_rp").alias("rule"), F.col("_v").alias("verdict"),
        )).alias("_best")
    )
    out = lambda rows, rule, verdict: rows.select(F.col("_id").alias(id_col), F.col("_h").alias("host"), F.col("_p").alias("path"), rule.alias("rule"), verdict.alias("verdict"))
    hosted = out(judged.where("_h <> ''").join(best, ["_h", "_p"], "left"), F.col("_best.rule"), F.coalesce("_best.verdict", F.lit(default)))
    return hosted.unionByName(out(judged.where("_h = ''"), F.lit(None).cast("string"), F.lit(default)))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, QUERY_RULES))


OP10_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
k AS (SELECT DISTINCT host, path FROM u),
f AS (
  SELECT host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) AS n
  FROM k, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON f.host = u.host AND f.path = u.path AND f.n = 1
"""
