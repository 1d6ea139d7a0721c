"""URL rules found by equi-joins on hashes of host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import _LOWER, _UPPER

SHORT = 8  # hexadecimal digits of a digest that the join compares: 32 bits


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """The host (A-Z in lower case) and the path of a url; both empty without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (verdict, host, path) with what the join needs.

    Repeated rules count once; of an allowing and a blocking rule with the same
    host and path, the blocking one holds.
    """
    expression = F.concat("host", "path")
    return (
        rules.groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            "verdict",
            expression.alias("rule"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("depth"),
            _digest("host", "path").alias("digest"),
        )
        .withColumn("short", F.substring("digest", 1, SHORT))
    )


def _digest(host, path) -> Column:
    # a line break stands in neither part of a rule
    return F.sha2(F.concat_ws("\n", host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The pages with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's.
    The longest rule wins; among equally long ones the one with the longer host,
    then a blocking one. Without a rule the verdict is ``default``. A null url,
    or one without ``://``, has an empty host and path and fits no rule. Each
    distinct (host, path) is judged once, so repeated rows and a host with a
    third of all rows cost nothing extra; it is expanded only to the numbers of
    host labels and the path lengths that rules have. Columns of the pages that
    bear a name of the result are replaced. No rows give no rows.
    """
    host, path = url_parts(url)
    pages = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    rules = rule_table(rules)
    # at most one pair per label count and path length, however many rules there are
    shapes = sorted(map(tuple, rules.select("labels", "depth").distinct().collect()))
    parts = F.split("host", r"\.")
    expressions = [
        F.when(
            (F.size(parts) >= labels) & (F.length("path") >= depth),
            _digest(F.array_join(F.slice(parts, -labels, labels), "."), F.substring("path", 1, depth)),
        )
        for labels, depth in shapes
    ]
    urls = pages.select("host", "path").distinct().where("host != ''")
    expanded = (
        urls.select("host", "path", F.explode(F.array(*expressions).cast("array<string>")).alias("full"))
        .where("full is not null")
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    order = F.struct(F.length("rule").alias("n"), "labels", F.col("verdict") == "block", "rule", "verdict")
    best = (
        expanded.join(rules, "short")
        .where("full = digest")
        .groupBy("host", "path")
        .agg(F.max(order).alias("best"))
    )
    return (
        pages.join(best, ["host", "path"], "left")
        .withColumn("rule", F.col("best.rule"))
        .withColumn("verdict", F.coalesce("best.verdict", F.lit(default)))
        .drop("best")
    )
