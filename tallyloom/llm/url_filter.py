"""URL filter: rules for hosts and path prefixes, looked up by hashes of the url's expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import ascii_lower, whole

#: Hex digits of the digest that the join compares; the rest of the digest is confirmed after it.
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Host with its port and user, A-Z lower-cased; empty for NULL and without ``://``."""
    return ascii_lower(whole(F.regexp_extract(url, _URL, 1)))


def url_path(url: Column) -> Column:
    return whole(F.regexp_extract(url, _URL, 2))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _depth(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with the digest of host and path up to its last slash, where a lookup can meet them."""
    host, path = ascii_lower(whole(F.col("host"))), whole(F.col("path"))
    anchor = F.regexp_extract(path, r"(?s)^(.*/)?", 1)
    rows = rules.select(host.alias("rule_host"), path.alias("rule_path"), F.col("action").alias("action"),
                        _digest(F.concat(host, anchor)).alias("rule_digest"),
                        (_depth(host, ".") + 1).alias("host_depth"), _depth(path, "/").alias("path_depth"))
    return rows.filter(F.col("rule_host") != "").withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))


def expressions(host: Column, path: Column, host_depth: int, path_depth: int) -> Column:
    """Every host suffix with every path prefix that ends in a slash or is empty, as deep as some rule goes."""
    labels = F.split(host, r"\.")
    deep = F.least(F.size(labels), F.lit(host_depth))
    suffixes = F.transform(F.sequence(F.lit(1), deep), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    slashes = F.least(_depth(path, "/"), F.lit(path_depth))
    prefixes = F.when(slashes > 0, F.transform(
        F.sequence(F.lit(1), slashes), lambda n: F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/"))
    )).otherwise(F.array().cast("array<string>"))
    prefixes = F.concat(F.array(F.lit("")), prefixes)
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with (host, path, rule, verdict) for each row.

    A rule fits its host and all hosts below it, where the url's path starts with the rule's. The longest rule
    string wins; then the longer host; then block, for a rule that is listed with both actions. Urls are
    judged once per distinct host and path, so repeated urls and a hot host add no work; a shuffled join splits
    what is hot. Expressions that are deeper than every rule can meet none and are not made. A rule
    whose path ends inside a segment is met at its last slash and confirmed by the whole path.

    NULL, empty and malformed urls have an empty host and path, no rule and the default verdict. Rules without a
    host fit nothing; a NULL path is empty. Without rules every url gets the default. Repeated pages stay.
    The results replace columns of these four names.
    """
    hashed = hashed_rules(rules)
    deepest = hashed.agg(F.max("host_depth"), F.max("path_depth")).first()
    judged = pages.drop("host", "path", "rule", "verdict").withColumns(
        {"host": url_host(pages[url]), "path": url_path(pages[url])})
    if deepest[0] is None:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    distinct = judged.select("host", "path").filter(F.col("host") != "").distinct()
    expanded = distinct.withColumn(
        "digest", F.explode(F.transform(expressions(F.col("host"), F.col("path"), *deepest), _digest)))
    candidates = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).join(
        hashed.drop("host_depth", "path_depth"), "prefix")
    fitting = candidates.filter((F.col("digest") == F.col("rule_digest"))
                                & F.expr("startswith(path, rule_path)"))
    name = F.concat("rule_host", "rule_path")
    best = fitting.groupBy("host", "path").agg(F.max(F.struct(
        F.length(name), F.length("rule_host"), F.col("action") == "block", name.alias("rule"), "action")).alias("__best"))
    return (judged.join(best, ["host", "path"], "left")
            .select(*(c for c in judged.columns), F.col("__best.rule").alias("rule"),
                    F.coalesce("__best.action", F.lit(default)).alias("verdict")))
