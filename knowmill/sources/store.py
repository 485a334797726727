"""Mutable tables on plain Parquet: an append-only change log and its current view.

Every write is one appended batch with a sequence number and an operation (U or D); the current
state is the last change of each key that isn't a deletion. A single writer is assumed. Batches are
validated whole before anything is written.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowmill.sources.schemas import TABLES, violations


class InvalidRows(ValueError):
    """Rows break rules of their table; nothing was written."""


class Store:
    def __init__(self, spark: SparkSession, folder: str, dim: int = 64):
        self.spark, self.folder, self.dim = spark, folder.rstrip("/"), dim

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self.path(name)).schema
        except AnalysisException:
            return False
        return True

    def create(self) -> tuple[int, int]:
        """Makes the missing tables; (created, skipped)."""
        made = [n for n in TABLES if not self.exists(n)]
        for name in made:
            self._log_schema(self.spark.createDataFrame([], TABLES[name][0])).write.parquet(self.path(name))
        return len(made), len(TABLES) - len(made)

    def _log_schema(self, rows: DataFrame, seq: int = 0, op: str = "U") -> DataFrame:
        return rows.withColumns({"_seq": F.lit(seq).cast("bigint"), "_op": F.lit(op)})

    def log(self, name: str) -> DataFrame:
        schema = T.StructType([*TABLES[name][0], T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType())])
        return self.spark.read.schema(schema).parquet(self.path(name))

    def current(self, name: str) -> DataFrame:
        """The rows as they are now."""
        schema, key = TABLES[name]
        last = self.log(name).groupBy(*key).agg(F.max_by(F.struct("_op", *[c for c in schema.names if c not in key]), "_seq").alias("r")).where("r._op <> 'D'")
        return last.select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in schema.names])

    def append(self, name: str, rows: DataFrame, op: str = "U") -> None:
        schema = TABLES[name][0]
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        if op == "U" and (bad := violations(rows, name, self.dim).orderBy("rule").take(20)):
            raise InvalidRows(f"{name}: " + "; ".join(f"{r['rule']} ({r['rows']})" for r in bad))
        self._log_schema(rows, time.time_ns(), op).write.mode("append").parquet(self.path(name))

    def update(self, name: str, where: Column, values: dict[str, Column]) -> None:
        self.append(name, self.current(name).where(where).withColumns(values))

    def delete(self, name: str, where: Column) -> None:
        self.append(name, self.current(name).where(where), "D")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows replace those of their key but keep the first created_at."""
        key = TABLES[name][1]
        old = self.current(name).select(*key, F.col("created_at").alias("_c"))
        self.append(name, rows.join(old, key, "left").withColumn("created_at", F.coalesce("_c", "created_at")).drop("_c"))

    def audit(self, project_id: str, action: str, target_id: str | None, target_type: str | None, metadata: dict) -> None:
        """One row of the activity log for a change."""
        row = self.spark.range(1).select(
            F.expr("uuid()").alias("log_id"), F.lit(project_id).alias("project_id"), F.lit("agent").alias("actor"), F.lit(action).alias("action"),
            F.lit(target_id).cast("string").alias("target_id"), F.lit(target_type).cast("string").alias("target_type"),
            F.to_json(F.create_map(*[F.lit(str(x)) for kv in metadata.items() for x in kv])).alias("metadata") if metadata else F.lit(None).cast("string").alias("metadata"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
        )
        self.append("activity_log", row)
