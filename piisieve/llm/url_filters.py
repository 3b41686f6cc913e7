"""URL rules by host and path: expand, join on hash prefixes, confirm, and let the longest rule win."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hexadecimal digits of the SHA-256 digest that the join compares; the whole digest is confirmed behind it.
PREFIX_DIGITS = 8
# The rules of the registered query as (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, in lower case (A-Z); else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What stands behind the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A host holds no slash and a path is empty or starts with one, so the text stands for the pair.
    return F.sha2(F.concat(host, path), 256)


def judge_urls(
    df: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """Rows (id_col, host, path, rule, verdict), one for each row of `df`.

    `rules` has the columns host, path and verdict (allow or block). A rule fits its host and all its subdomains if
    the URL's path starts with the rule's; the longest host and path wins, and block before allow among equals. Each URL
    is expanded only into as many host labels and path characters as some rule has, so the number of expressions
    does not grow with the URL. Rules are joined by equality and are broadcast only where Spark finds them small;
    rows with the same id and URL are judged once and returned as often as they stand. A null URL, or one without
    "://", has an empty host and path; only a rule with neither would fit it. Rules with a null part fit nothing.
    Other columns are not read.
    """
    rules = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    ).dropna()
    shape = F.struct(
        F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")
    ).alias("shape")
    # At most (labels of a host) x (characters of a path) rows, however many rules there are.
    shapes = [(r.shape.labels, r.shape.chars) for r in rules.select(shape).distinct().collect()]
    rules = rules.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"),
        F.length(F.concat("rule_host", "rule_path")).alias("chars"),
        F.col("verdict").alias("rule_verdict"),
        _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"),
    )
    rules = rules.withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))

    urls = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(
        F.count(F.lit(1)).alias("copies")
    )
    urls = urls.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    host, path = F.col("host"), F.col("path")
    expressions = [
        F.when(F.length(path) >= chars, _digest(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))
        for labels, chars in shapes
    ]
    empty = F.array().cast("array<string>")
    expanded = urls.withColumn("digests", F.array_distinct(F.array_compact(F.array(*expressions))) if shapes else empty)
    expanded = expanded.select("id", "url", "copies", "host", "path", F.explode_outer("digests").alias("digest"))
    expanded = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    # Joined on the short prefix alone; the full digest is confirmed above the join.
    confirmed = F.col("rule").isNotNull() & (F.col("digest") == F.col("rule_digest"))
    judged = (
        expanded.join(rules, F.col("prefix") == F.col("rule_prefix"), "left")
        .groupBy("id", "url", "copies", "host", "path")
        .agg(F.max(F.when(confirmed, F.struct("chars", "blocks", "rule", "rule_verdict"))).alias("best"))
    )
    judged = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(otherwise)).alias("verdict"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP10_SQL = r"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule FROM parts
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
