"""URL filters: a blocked Bloom filter in front of an exact hash join.

Every listed rule is a canonical (host, path prefix). A page offers the keys
(host suffix, path prefix) a rule could have; each key is hashed to one block
of 256 bits and must find its four bits there before it reaches the exact
join, which removes the false positives. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, table

WORDS = 4
KEYS_PER_BLOCK = 16
#: A Bloom filter of at most this many blocks (48 bytes each) is broadcast.
BROADCAST_BLOCKS = 1 << 16

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(fold(F.regexp_extract(after, "^[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(n_blocks: int) -> list[Column]:
    """The block of the key in columns ``k_host``, ``k_path``, and its bit in each word."""
    h, g = F.xxhash64("k_host", "k_path"), F.xxhash64("k_path", "k_host", F.lit(7))
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]
    return [F.pmod(h, F.lit(n_blocks)).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(bit))]


def bloom(rules: DataFrame, n_blocks: int) -> DataFrame:
    """One row for each block that is not empty: its four 64-bit words."""
    return (
        rules.select(F.col("host").alias("k_host"), F.col("path").alias("k_path"))
        .select(*_bits(n_blocks))
        .groupBy("block")
        .agg(*(F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` has host, path and verdict. The rule that fits with the longest
    host and path decides, and among equally long ones that with the longer
    host; ``default`` holds where none fits. Null URLs and URLs without
    ``://`` have an empty host and path and match no rule; repeated rows stay;
    columns of ``pages`` named like a result are replaced. Repeated rules
    count once, the alphabetically last verdict winning. An empty rule list
    gives ``default`` everywhere.
    """
    host, path = host_and_path(F.col(url))
    judged = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    # Bounded however long the list is: label counts and path lengths of URLs.
    about = rules.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("host", "\\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    n_blocks = 1 << max(0, (about["n"] // KEYS_PER_BLOCK)).bit_length()
    filter_ = bloom(rules, n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        filter_ = F.broadcast(filter_)

    labels = F.split("host", "\\.")
    sites = judged.select("host", "path").distinct()
    suffix = F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(about["labels"] or 1))))
    keys = (
        sites.select("host", "path", suffix.alias("n"))
        .select("host", "path", F.expr("array_join(slice(split(host, '\\\\.'), -n, n), '.')").alias("k_host"))
        .withColumn("length", F.explode(F.array(*map(F.lit, sorted(about["lengths"])) or [F.lit(0)])))
        .filter(F.col("length") <= F.length("path"))
        .withColumn("k_path", F.expr("substring(path, 1, length)"))
    )
    passed = reduce(
        lambda df, i: df.filter(F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0),
        range(WORDS),
        keys.select("host", "path", "k_host", "k_path", *_bits(n_blocks)).join(filter_, "block"),
    )
    listed = rules.select(F.col("host").alias("k_host"), F.col("path").alias("k_path"), "verdict")
    size = F.length("k_host") + F.length("k_path")
    best = (
        passed.join(listed, ["k_host", "k_path"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(size.alias("size"), F.length("k_host").alias("of_host"), F.concat("k_host", "k_path").alias("rule"), "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return judged.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op6_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_VALUES}),
parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT row_number() OVER () AS k, page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
fit AS (
  SELECT k, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fit USING (k)
"""
