"""Sources, validation, embedding and streaming as queries over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowmill.operators import ingest
from knowmill.operators.embedding import HashEmbedder, embed
from knowmill.functions.text import token_estimate
from knowmill.sources.files import agent_usage, usage_totals
from knowmill.sources.schemas import NULLABLE, TABLES, violations
from knowmill.sources.tables import instant, key_of, table
from knowmill.streaming import activity

#: Given table -> the store's table whose rules its rows must keep.
GIVEN = {"kb_documents": "documents", "doc_chunks": "doc_chunks", "code_chunks": "code_chunks", "relationships": "relationships", "decisions": "decisions", "tasks": "tasks", "activity_log": "activity_log", "project_meta": "project_meta"}
DIM = 64


def src_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Broken row rules of every table."""
    one = lambda given, name: violations(table(spark, folder, given), name).select(F.lit(given).alias("table_name"), "rule", F.col("rows").alias("n"))
    return reduce(DataFrame.unionByName, [one(g, n) for g, n in GIVEN.items()])


def _violations_sql() -> str:
    """The same rules, a count each."""
    parts = []
    for given, name in GIVEN.items():
        schema, key = TABLES[name]
        broken = {f"{f.name} is missing": f"{f.name} IS NULL" for f in schema if f.name not in NULLABLE or (name == "code_chunks" and f.name == "vector")}
        broken |= {f"{k} is blank": f"coalesce(trim(CAST({k} AS VARCHAR)), '') = ''" for k in key}
        if "vector" in schema.names:
            broken["vector has another length"] = f"vector IS NOT NULL AND len(vector) <> {DIM}"
        if "created_at" in schema.names:
            broken["created_at is no time"] = "created_at IS NOT NULL AND TRY_CAST(created_at AS TIMESTAMPTZ) IS NULL"
        parts += [f"SELECT '{given}' table_name, '{rule}' AS \"rule\", count(*) n FROM {given} WHERE {where} HAVING count(*) > 0" for rule, where in broken.items()]
    return " UNION ALL ".join(parts)


def src_current_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as they are now, with versions as upserts and logged hard deletions as tombstones: of each key the last operation
    by time, an upsert before a deletion of the same time; deleted ones are gone."""
    puts = table(spark, folder, "kb_documents").select("project_id", key_of(F.col("doc_id")).alias("k"), instant(F.col("updated_at")).alias("at"), F.lit(0).alias("gone"), "version", "doc_id", "status")
    ends = table(spark, folder, "activity_log").where("action = 'hard_delete_document'")
    ends = ends.select("project_id", key_of(F.col("target_id")).alias("k"), instant(F.col("created_at")).alias("at"), F.lit(1).alias("gone"), F.lit(0).alias("version"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("status"))
    log = puts.unionByName(ends).where("k IS NOT NULL")
    last = log.groupBy("project_id", "k").agg(F.max(F.struct("at", "gone", "version", "doc_id", "status")).alias("x"))
    return last.where("x.gone = 0").select("project_id", "x.doc_id", "x.version", "x.status")


def src_upserted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The latest versions written over the first ones: each keeps the created_at of the row it replaces."""
    kb = table(spark, folder, "kb_documents")
    old = kb.where("version = 1").groupBy("doc_id").agg(F.min("created_at").alias("first"))
    new = kb.groupBy("doc_id").agg(F.max("version").alias("version"), F.max_by("created_at", F.struct("version", "created_at")).alias("created_at"))
    return new.join(old, "doc_id", "left").select("doc_id", "version", F.coalesce("first", "created_at").alias("created_at"))


def src_audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The activity rows that storing every document version writes: actor, action, target and JSON metadata."""
    kb = table(spark, folder, "kb_documents").select("project_id", "doc_id", "version", "category").distinct()
    metadata = F.to_json(F.struct("version", "category"))
    return kb.select("project_id", F.lit("agent").alias("actor"), F.lit("store_document").alias("action"), F.col("doc_id").alias("target_id"), F.lit("document").alias("target_type"), metadata.alias("metadata"))


def agg_agent_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, tokens and cost of each agent in the activity log, its metadata read as input, its target as output."""
    return agent_usage(_audit(spark, folder)).select("agent", "calls", "input_tokens", "output_tokens", "cost")


def agg_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """All calls and tokens, and the share of calls whose agent is known."""
    return usage_totals(agent_usage(_audit(spark, folder)))


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "activity_log").dropDuplicates(["log_id"])
    tokens = lambda c: F.coalesce(token_estimate(F.col(c)), F.lit(0)).cast("bigint")
    return log.select(F.col("action").alias("tool"), F.col("actor").alias("agent"), tokens("metadata").alias("input_tokens"), tokens("target_id").alias("output_tokens"))


def emb_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A vector of every document chunk's content, each distinct text embedded once."""
    chunks = table(spark, folder, "doc_chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "content")
    return embed(chunks, "content", HashEmbedder(), 64).select("chunk_id", "vector")


def agg_next_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The version that each document would get if it were stored again."""
    kb = table(spark, folder, "kb_documents")
    return ingest.next_versions(kb, kb.select("doc_id").distinct().withColumn("version", F.lit(0))).select("doc_id", "version")


def stream_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Actions per UTC day, streamed from the log into a table; late rows count."""
    return activity.ingest(spark, folder)


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Actions per UTC day from the live view, whose state is bounded by a watermark. A table of several batches loses the rows that come too late for it."""
    return activity.live(spark, folder)


QUERIES = {f.__name__: f for f in (src_violations, src_current_documents, src_upserted_documents, src_audit_rows, agg_agent_usage, agg_attribution, emb_documents, agg_next_versions, stream_activity, stream_windows)}
_DAYS = """SELECT strftime(CAST(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d') AS "day", action, count(DISTINCT log_id) n FROM activity_log GROUP BY ALL"""
_USAGE = """WITH al AS (SELECT DISTINCT ON (log_id) * FROM activity_log ORDER BY log_id), u AS (SELECT CASE WHEN trim(coalesce(actor, '')) = '' THEN 'unknown' ELSE actor END agent, count(*) calls,
CAST(sum(coalesce(ceil(length(metadata) / 4), 0)) AS BIGINT) input_tokens, CAST(sum(coalesce(ceil(length(target_id) / 4), 0)) AS BIGINT) output_tokens FROM al GROUP BY 1)"""
SQL = {
    "src_violations": _violations_sql(),
    "src_current_documents": """WITH l AS (SELECT project_id, lower(trim(doc_id)) k, CAST(updated_at AS TIMESTAMPTZ) t, 0 gone, "version", doc_id, status FROM kb_documents
UNION ALL SELECT project_id, lower(trim(target_id)), CAST(created_at AS TIMESTAMPTZ), 1, 0, NULL, NULL FROM activity_log WHERE action = 'hard_delete_document' AND trim(target_id) <> '')
SELECT project_id, doc_id, "version", status FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY project_id, k ORDER BY t DESC NULLS LAST, gone DESC, "version" DESC, doc_id DESC NULLS LAST, status DESC NULLS LAST) = 1) WHERE gone = 0""",
    "src_upserted_documents": """SELECT n.doc_id, n."version", coalesce(o.f, n.c) created_at FROM (SELECT doc_id, max("version") "version", arg_max(created_at, ("version", created_at)) c FROM kb_documents GROUP BY doc_id) n
LEFT JOIN (SELECT doc_id, min(created_at) f FROM kb_documents WHERE "version" = 1 GROUP BY doc_id) o USING (doc_id)""",
    "src_audit_rows": """SELECT DISTINCT project_id, 'agent' actor, 'store_document' AS "action", doc_id target_id, 'document' target_type, CAST(json_object('version', "version", 'category', category) AS VARCHAR) metadata FROM kb_documents""",
    "agg_agent_usage": _USAGE + " SELECT *, round(input_tokens * 0.000003 + output_tokens * 0.000015, 4) \"cost\" FROM u",
    "agg_attribution": _USAGE + " SELECT CAST(sum(calls) AS BIGINT) calls, CAST(coalesce(sum(calls) FILTER (agent <> 'unknown'), 0) AS BIGINT) known, CAST(sum(input_tokens) AS BIGINT) input_tokens, CAST(sum(output_tokens) AS BIGINT) output_tokens, CAST(round(100 * coalesce(sum(calls) FILTER (agent <> 'unknown'), 0) / sum(calls)) AS INTEGER) attributed FROM u",
    "agg_next_versions": 'SELECT doc_id, max(version) + 1 "version" FROM kb_documents GROUP BY doc_id',
    "stream_activity": _DAYS,
    "stream_windows": _DAYS,
}
