"""Grouped counts and top-k reports. One aggregate each, with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knowmill.functions.text import token_estimate
from knowmill.sources.tables import instant, trimmed, utc_text


def language_breakdown(code: DataFrame) -> DataFrame:
    """(language, files, chunks), missing languages as unknown."""
    language = F.coalesce(F.when(trimmed(F.col("language")) != "", F.lower(trimmed(F.col("language")))), F.lit("unknown"))
    return code.groupBy(language.alias("language")).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"))


def project_overview(documents: DataFrame) -> DataFrame:
    """Per project: documents, and their counts by status, of current versions."""
    status = [F.count_if(F.col("status") == s).alias(s) for s in ("draft", "active", "approved", "archived")]
    return documents.where("status <> 'superseded'").groupBy("project_id").agg(F.count("*").alias("documents"), F.countDistinct("category").alias("categories"), *status)


def recent(rows: DataFrame, by: str, key: str, k: int = 5) -> DataFrame:
    """The k latest rows of each project; the limit is applied before the shuffle too."""
    order = W.partitionBy("project_id").orderBy(F.desc(instant(F.col(by))), F.desc(key))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def usage_by_actor(log: DataFrame) -> DataFrame:
    """Per actor: calls, actions, estimated tokens of the metadata; blank actors as unknown."""
    actor = F.coalesce(F.when(trimmed(F.col("actor")) != "", trimmed(F.col("actor"))), F.lit("unknown"))
    return log.groupBy(actor.alias("actor")).agg(F.count("*").alias("calls"), F.countDistinct("action").alias("actions"), F.sum(F.coalesce(token_estimate(F.col("metadata")), F.lit(0))).alias("tokens"))


def daily_activity(log: DataFrame) -> DataFrame:
    """Actions per project and UTC day."""
    return log.groupBy("project_id", utc_text(instant(F.col("created_at")), "yyyy-MM-dd").alias("day"), "action").agg(F.count("*").alias("n"))


def metadata_numbers(log: DataFrame) -> DataFrame:
    """Per action: rows whose metadata is an object, and sums of its ``count``; malformed text counts as none."""
    parsed = log.select("action", F.from_json("metadata", "count bigint, ok boolean, chunks_deleted bigint").alias("m"))
    return parsed.groupBy("action").agg(
        F.count_if(F.col("m.count").isNotNull() | F.col("m.ok").isNotNull() | F.col("m.chunks_deleted").isNotNull()).alias("parsed"),
        F.coalesce(F.sum("m.count"), F.lit(0)).alias("counted"), F.coalesce(F.sum("m.chunks_deleted"), F.lit(0)).alias("chunks_deleted"),
    )
