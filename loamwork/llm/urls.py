"""URL filters: host-suffix and path-prefix expressions, found by hash prefix and confirmed by digest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (action, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What becomes of a URL that no rule fits.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Host suffixes joined to path prefixes, one for each shape (host labels, path length) that fits.

    The shapes are one map in the plan, from labels to lengths, whatever their number; only the
    suffixes that the host has are looked up.
    """
    if not shapes:
        return F.array().cast("array<string>")
    lengths: dict[int, list[int]] = {}
    for n, m in sorted(set(shapes)):
        lengths.setdefault(n, []).append(m)
    table = F.from_json(F.lit(json.dumps(lengths)), "map<string,array<int>>")
    has = F.size(F.split(host, "\\."))
    suffixes = F.sequence(F.lit(1), F.least(has, F.lit(max(lengths))))

    def prefixes(n: Column) -> Column:
        fitting = F.filter(F.coalesce(F.try_element_at(table, n.cast("string")), F.array().cast("array<int>")), lambda m: m <= F.length(path))
        return F.transform(fitting, lambda m: F.concat(F.call_function("substring_index", host, F.lit("."), -n), F.substring(path, F.lit(1), m)))

    return F.array_distinct(F.flatten(F.transform(suffixes, prefixes)))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = DEFAULT) -> DataFrame:
    """(*keep, host, path, rule, verdict) for each row of ``pages``.

    Different (host, path) pairs are expanded once. A rule shape is its number of host labels and
    its path length; a pair yields one expression a shape: that many last labels and that long a
    path prefix. An expression meets rules by the first 32 bits of its SHA-256, the full digest
    confirms, and the longest rule wins, then the one with the longer host, then block. Spark
    broadcasts the rules only where their size is known to be small.

    A null or malformed URL has an empty host and path. With no fitting rule ``rule`` is null and
    the verdict ``default``. Repeated rows are judged each; repeated rules and those with a null
    part count once or not. Of ``keep`` the columns named host, path, rule or verdict are replaced.
    Empty tables make no rows, or default verdicts.
    """
    kept = [c for c in keep if c.lower() not in ("host", "path", "rule", "verdict")]
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND action IS NOT NULL")
    labels = F.size(F.split("host", "\\."))
    listed = rules.select("action", F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule"), labels.alias("labels"), F.length("path").alias("chars")).dropDuplicates(["rule", "action"])
    listed = listed.withColumn("rule_digest", _digest(F.col("rule"))).withColumn("prefix", _prefix(F.col("rule_digest")))
    # at most 127 labels by some hundred lengths, whatever the number of rules
    shapes = [(r["labels"], r["chars"]) for r in listed.select("labels", "chars").distinct().collect()]

    judged = pages.select(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`") for c in kept)).alias("kept"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    pairs = judged.select("host", "path").distinct()
    asked = pairs.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("expression"))
    asked = asked.withColumn("digest", _digest(F.col("expression"))).withColumn("prefix", _prefix(F.col("digest"))).drop("expression")
    met = asked.join(listed, "prefix").where("digest = rule_digest")
    order = F.struct(F.length("rule"), F.length("rule_host"), (F.col("action") == "block").cast("int"), "rule", "action")
    best = met.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    out = judged.join(best, ["host", "path"], "left")
    return out.select(*(F.col(f"kept.`{c}`") for c in kept), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


ORACLE = """
WITH rules(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
parsed AS (
  SELECT page_id, row_number() OVER () AS row_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fits AS (
  SELECT p.row_id, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY p.row_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.row_id = p.row_id AND f.n = 1
"""
