"""The store's tables: columns, keys and row rules, as data; a violations report before any write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType())}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


#: Name -> (columns, key).
TABLES: dict[str, tuple[T.StructType, list[str]]] = {
    "documents": (_schema("doc_id string, project_id string, title string, content string, category string, status string, version int, created_at string, updated_at string, tags string, phase string, priority int, parent_id string, depth int, decision_type string"), ["doc_id", "version"]),
    "doc_chunks": (_schema("chunk_id string, project_id string, doc_id string, chunk_index int, content string, vector array<float>, header string, version int, status string, token_count int, created_at string"), ["chunk_id"]),
    "code_chunks": (_schema("chunk_id string, project_id string, doc_id string, file_path string, symbol_name string, symbol_type string, scope_chain string, content string, language string, imports string, exports string, start_line int, end_line int, created_at string, file_hash string, vector array<float>"), ["chunk_id"]),
    "relationships": (_schema("relationship_id string, project_id string, from_id string, to_id string, type string, source string, created_at string, metadata string"), ["relationship_id"]),
    "project_meta": (_schema("project_id string, name string, created_at string, updated_at string, description string, last_index_at string, settings string"), ["project_id"]),
    "activity_log": (_schema("log_id string, project_id string, actor string, action string, target_id string, target_type string, metadata string, created_at string"), ["log_id"]),
    "decisions": (_schema("decision_id string, project_id string, subject string, context string, rationale string, choice string, tier int, tier_name string, decision_type string, status string, actor string, phase string, tags string, superseded_by string, created_at string, updated_at string, vector array<float>"), ["decision_id"]),
    "tasks": (_schema("task_id string, project_id string, parent_id string, root_id string, depth int, title string, description string, status string, is_blocked boolean, is_cancelled boolean, block_reason string, priority string, assigned_agent string, estimated_effort string, tags string, phase string, context_doc_ids string, context_decision_ids string, spec string, output_doc_ids string, created_at string, updated_at string, vector array<float>"), ["task_id"]),
}
#: Columns that may be null, beside vectors of these tables' chunks, decisions and tasks.
NULLABLE = {"phase", "priority", "parent_id", "depth", "decision_type", "symbol_name", "symbol_type", "scope_chain", "language", "start_line", "end_line", "file_hash", "description", "last_index_at", "settings", "target_id", "target_type", "metadata", "superseded_by", "block_reason", "assigned_agent", "estimated_effort", "tags", "context_doc_ids", "context_decision_ids", "spec", "output_doc_ids", "vector"}


def rules(name: str, dim: int = 64) -> dict[str, Column]:
    """What every row must fulfil, by a name for the report."""
    schema, key = TABLES[name]
    out = {f"{f.name} is missing": F.col(f.name).isNotNull() for f in schema if f.name not in NULLABLE or (name == "code_chunks" and f.name == "vector")}
    out |= {f"{k} is blank": F.trim(F.col(k).cast("string")) != "" for k in key}
    if "vector" in schema.names:
        out["vector has another length"] = F.col("vector").isNull() | (F.size("vector") == dim)
    if "created_at" in schema.names:
        out["created_at is no time"] = F.col("created_at").isNull() | F.try_to_timestamp("created_at").isNotNull()
    return out


def violations(rows: DataFrame, name: str, dim: int = 64) -> DataFrame:
    """(rule, rows): the broken rules; empty if all rows may be written."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), rule) for rule, ok in rules(name, dim).items()]))
    return rows.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))
