"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is a host and a path. Every URL is expanded into those of its host suffixes and path prefixes whose numbers of
labels and characters some rule has; expressions and rules are equi-joined on the first 32 bits of their SHA-256, the
full digests confirm a match, and the longest rule wins (of equal lengths, block before allow). Equal URLs are judged
once. All steps are DataFrame expressions.

Defined cases: null URLs and those without ``://`` have an empty host and path and get the default verdict; hosts
compare in ASCII lower case; repeated rows get repeated results; a URL of any length gives
only as many expressions as rules have lengths; no rules or an empty table are allowed; columns other
than the id and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path); a rule fits its host and all subdomains if the URL's path starts with the rule's.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    after = F.coalesce(F.nullif(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), F.lit(""))
    return F.translate(after, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    made = spark.createDataFrame(rules or [], "verdict string, rule_host string, rule_path string")
    digest = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    return made.select("verdict", F.concat("rule_host", "rule_path").alias("rule"), digest.alias("digest"), F.substring(digest, 1, 8).alias("prefix"), F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row. ``rules`` is rule_table's; its shapes are few, its rows may be many."""
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    urls = rows.select("url").distinct().withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    shapes = [(r["labels"], r["chars"]) for r in rules.select("labels", "chars").distinct().collect()]  # lengths of rules, not rules
    parts = F.split("host", r"\.")
    asked = [
        F.when(
            (F.col("host") != "") & (F.size(parts) >= n) & (F.length("path") >= c),
            F.concat_ws("\n", F.array_join(F.slice(parts, -n, n), "."), F.substring("path", 1, c)),
        )
        for n, c in shapes
    ]
    asked = F.array_compact(F.array(*asked)) if asked else F.array().cast("array<string>")
    asks = urls.select("url", F.explode(asked).alias("expression")).select("url", F.sha2("expression", 256).alias("asked"))
    asks = asks.withColumn("prefix", F.substring("asked", 1, 8))
    hits = asks.join(rules, "prefix").filter("asked = digest")
    best = hits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    found = best.select("url", "best.rule", "best.verdict")
    out = rows.join(found, "url", "left")
    return out.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8(spark, sf_dir: str) -> DataFrame:
    from pelagia.llm.shared import table

    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP8_SQL = r"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(verdict, h, q) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m as (
  select p.page_id, max({'n': length(h || q), 'b': verdict = 'block', 'rule': h || q, 'verdict': verdict}) as best
  from p join r on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.q)
  group by p.page_id)
select p.page_id, p.host, p.path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
from p left join m using (page_id)
"""
