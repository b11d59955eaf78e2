"""URL filter by host-suffix and path-prefix expressions.

A URL stands for all expressions "host suffix + path prefix" that a rule could have. Expressions and rules meet in an
equi-join on the first hex digits of their SHA-256; the whole digest confirms a meeting, and the longest rule decides.

- Expressions are made once per different (host, path), so a host that owns a third of all pages costs nothing extra.
- Only suffixes and prefixes of a length that some rule has are made: label counts of rule hosts and lengths of rule paths,
  both bounded by the longest rule.
- Neither side is broadcast by hand: Spark broadcasts a small rule table by its size and shuffles a large one.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule. A rule that is null in any
field, or whose host is empty, fits nothing. Of rules with the same host and path but different verdicts, block holds.
Repeated pages are judged one by one. Further columns of the pages stay; ``host``, ``path``, ``rule`` and ``verdict`` of
the input are replaced; the name ``_verdict`` is reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import ascii_lower

PREFIX_DIGITS = 8  # of the digest, in the join key


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """From (host, path, verdict): one row per host and path, with the digest and the joined key."""
    host = ascii_lower(F.col("host"))
    return (
        rules.filter(F.col("path").isNotNull() & F.col("verdict").isin("allow", "block") & (F.col("host") != ""))
        .groupBy(host.alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("_verdict"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (host and path of the longest fitting rule, else null) and verdict (the rule's, else
    ``default``)."""
    host, path = url_parts(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    rules = prepare_rules(rules)
    sizes = rules.agg(
        F.sort_array(F.collect_set(F.size(_labels(F.col("rule_host"))))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()

    labels = _labels(F.col("host"))
    suffixes = F.array(*[
        F.when(F.size("labels") >= n, F.array_join(F.slice("labels", -n, n), ".")) for n in sizes["labels"]
    ]).cast("array<string>")
    prefixes = F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sizes["lengths"]
    ]).cast("array<string>")
    best = (
        parsed.filter(F.col("host") != "").select("host", "path").distinct()
        .withColumn("labels", labels)
        .select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .filter(F.col("suffix").isNotNull())
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .filter(F.col("prefix").isNotNull())
        .select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("expression"))
        .withColumn("key", F.substring("expression", 1, PREFIX_DIGITS))
        .join(rules, "key")
        .filter(F.col("expression") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("length"), "rule_host", "rule_path", "_verdict",
        )).alias("found"))
        .select("host", "path", F.concat("found.rule_host", "found.rule_path").alias("rule"),
                F.col("found._verdict").alias("_verdict"))
    )
    return (
        parsed.drop("rule", "verdict").join(best, ["host", "path"], "left")
        .withColumn("verdict", F.coalesce("_verdict", F.lit(default)))
        .drop("_verdict")
    )
