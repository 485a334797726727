"""Source trees and JSON-lines logs as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowmill.operators.code import TEST_NAME, language_of

#: Folders and files that are never indexed.
EXCLUDED = ["node_modules", "__pycache__", "target", "dist", "build", ".git", ".next", ".nuxt", "coverage", ".cache", "vendor"]
AUDIT = "ts string, tool string, agent string, has_actor boolean, project_id string, input_tokens bigint, output_tokens bigint, input_keys array<string>, _bad string"


def ignore_pattern(rule: str) -> str:
    """A line of an ignore file as a regular expression on relative paths."""
    rule = rule.rstrip("/")
    anchored = rule.startswith("/") or "/" in rule[:-1]
    body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*|\?)", rule.lstrip("/")))
    return ("^" if anchored else "(^|/)") + body + "(/|$)"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches ignores the path; a rule behind ! takes it back in."""
    verdict = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            verdict = F.when(path.rlike(ignore_pattern(rule.removeprefix("!"))), F.lit(not rule.startswith("!"))).otherwise(verdict)
    return verdict


def ignore_rules(spark: SparkSession, root: str) -> list[str]:
    """The lines of the root's ignore file, if there is one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", ".gitignore").load(root).select(F.decode("content", "UTF-8").alias("c")).first()
    return found["c"].splitlines() if found else []


def source_tree(spark: SparkSession, root: str, exclude: list[str] = (), include: list[str] = ()) -> DataFrame:
    """(path, language, is_test, content) of the source files below ``root``; the root's ignore file, the fixed exclusions
    and ``exclude`` leave files out, in this order, and ``include`` leaves out all others.

    Spark lists and reads the files; each rule is a regular expression on the relative path.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx,py,rs}").format("binaryFile").load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:"))
    path = F.regexp_replace("path", f"^(file:)?/*?(?=/){base}/", "")
    files = rows.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))
    files = files.where(~ignored(F.col("path"), [*ignore_rules(spark, root), *EXCLUDED, *exclude]))
    if include:
        files = files.where(ignored(F.col("path"), list(include)))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", language_of(F.col("path")).alias("language"), name.rlike(TEST_NAME).alias("is_test"), "content")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines audit log; malformed lines are dropped."""
    rows = spark.read.schema(AUDIT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL AND tool IS NOT NULL").drop("_bad")


def agent_usage(log: DataFrame, prefix: str = "", in_price: float = 3e-6, out_price: float = 15e-6) -> DataFrame:
    """(agent, calls, input_tokens, output_tokens, cost) of the tools under a prefix; blank agents as unknown."""
    agent = F.coalesce(F.when(F.trim("agent") != "", F.col("agent")), F.lit("unknown"))
    sums = log.where(F.col("tool").startswith(prefix)).groupBy(agent.alias("agent")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return sums.withColumn("cost", F.round(F.col("input_tokens") * in_price + F.col("output_tokens") * out_price, 4))


def usage_totals(usage: DataFrame) -> DataFrame:
    """(calls, known, input_tokens, output_tokens, attributed): sums over ``agent_usage`` and the percentage of calls of known agents, 100 without calls."""
    known = F.coalesce(F.sum(F.when(F.col("agent") != "unknown", F.col("calls"))), F.lit(0))
    total = F.coalesce(F.sum("calls"), F.lit(0))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return usage.agg(total.alias("calls"), known.alias("known"), *sums, F.when(total == 0, 100).otherwise(F.round(100 * known / F.greatest(total, F.lit(1)))).cast("int").alias("attributed"))
