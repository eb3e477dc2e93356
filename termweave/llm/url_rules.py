"""URL filter by hashed host-suffix and path-prefix expressions.

A url's expressions are every host suffix (the whole host, and what follows each dot) with every path prefix that ends
in a slash (and the empty one), as deep as the deepest rule goes: two numbers that the rule table gives. A rule is filed under its host and its path up to the last slash, so it
can only fit a url one of whose expressions is that key. Distinct urls are expanded, joined with the rules on a
short prefix of the key's SHA-256, confirmed by the full digest and the rest of the rule's path, and the
longest fitting rule decides.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; an
empty rule table leaves every row to the default verdict; repeated rows and ids are kept; equal longest
rules: longer host first, then ``block`` before ``allow``. Columns of the pages never clash, because only
the url travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hexadecimal digits of the digest that the join uses.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, labels: int) -> Column:
    """The host and what follows each of its dots, of at most so many labels."""
    parts = F.split(host, r"\.", -1)
    first = F.greatest(F.size(parts) - (labels - 1), F.lit(1))
    return F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, labels), "."))


def path_prefixes(path: Column, slashes: int) -> Column:
    """The empty path and every prefix that ends in a slash, of at most so many slashes."""
    parts = F.split(path, "/", slashes + 1)
    last = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Keys ``host NUL path-prefix`` of a url."""
    prefixes = path_prefixes(path, slashes)
    return F.flatten(F.transform(host_suffixes(host, labels), lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\0"), p))))


def depths(rules: DataFrame) -> tuple[int, int]:
    """Labels of the deepest rule host and slashes of the deepest rule path."""
    labels, slashes = F.size(F.split("host", r"\.", -1)), F.size(F.split("path", "/", -1)) - 1
    row = rules.filter("host is not null and path is not null").agg(F.max(labels), F.max(slashes)).first()
    return max(row[0] or 1, 1), row[1] or 0


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the digest of their key and its short prefix."""
    host = F.translate(F.col("host"), UPPER, UPPER.lower())
    stem = F.regexp_extract("path", r"(?s)^(.*/)?", 1)
    name = F.concat(host, F.col("path"))
    return (
        rules.filter("host is not null and path is not null and verdict is not null")
        .select(
            F.sha2(F.concat(host, F.lit("\0"), stem), 256).alias("rule_digest"),
            host.alias("rule_host"),
            F.col("path").alias("rule_path"),
            name.alias("rule"),
            F.col("verdict").alias("rule_verdict"),
        )
        .withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )


def judged_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that a rule fits, with that rule and its verdict."""
    split = urls.select("url").filter("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = expressions(F.col("host"), F.col("path"), *depths(rules))
    asked = split.filter("host <> ''").select("url", "path", F.explode(keys).alias("key"))
    asked = asked.select("url", "path", F.sha2("key", 256).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    # The rules are joined by Spark's choice: broadcast below its size limit, else a shuffle join.
    found = asked.join(keyed_rules(rules), "short").filter("digest = rule_digest and startswith(path, rule_path)")
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("rule_verdict"))
    best = F.max_by(F.struct("rule", "rule_verdict"), rank)
    return found.groupBy("url").agg(best.alias("best")).select("url", "best.rule", F.col("best.rule_verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """``keep`` columns, host, path, the longest fitting rule (or null) and the verdict of each page.

    No rule: the ``default`` verdict.
    """
    rows = pages.select(*[F.col(c) for c in keep], F.col(url).cast("string").alias("_url"))
    # Only urls that a rule fits come back, so the rest stay in place in the outer join.
    found = judged_urls(rows.select(F.col("_url").alias("url")), rules).withColumnRenamed("url", "_found")
    joined = rows.join(found, rows["_url"] == found["_found"], "left")
    return joined.select(
        *keep,
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
