"""The append-only activity log as a stream. An extension: the store itself answers requests only.

``windowed_counts`` is the live view: counts of a window with bounded state, rows later than the
watermark left out. ``ingest`` is the whole one: it streams the log into a table, batch by batch, without
state, so no row is too late; the table is counted when it is asked, each log_id once.

Defined results: windows and days are those of UTC, whatever the session's time zone; rows without a
readable time have a null day in the whole view and are left out of the live one; an empty log gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowmill.sources.schemas import TABLES
from knowmill.sources.tables import instant, shared_folder, utc_text

#: How far behind the latest row of earlier batches a row may be, and how far apart two copies of it.
LATE = "30 days"
#: Files of one batch.
FILES = 4


def windowed_counts(log: DataFrame, window: str = "1 day", late: str = LATE) -> DataFrame:
    """(day, action, n) of a streaming log: windows of UTC, a log_id once."""
    at = log.select("log_id", "action", instant(F.col("created_at")).alias("at")).where("at IS NOT NULL").withWatermark("at", late).dropDuplicatesWithinWatermark(["log_id"])
    counts = at.groupBy(F.window("at", window).alias("w"), "action").agg(F.count("*").alias("n"))
    return counts.select(utc_text(F.col("w.start"), "yyyy-MM-dd").alias("day"), "action", "n")


def source(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    return spark.readStream.schema(TABLES["activity_log"][0]).option("maxFilesPerTrigger", files).parquet(f"{folder}/activity_log.parquet*")


def _drained(stream: DataFrame, mode: str, out: str) -> DataFrame:
    """Runs the stream over what is there; its batches as a table, with their number. A batch that runs again replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch_{number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/rows/*")


def live(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each window of ``windowed_counts``."""
    rows = _drained(windowed_counts(source(spark, folder)), "update", f"{shared_folder(spark)}/activity-{uuid.uuid4().hex}")
    return rows.groupBy("day", "action").agg(F.max_by("n", "batch").alias("n"))


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """(day, action, n) of every row that was ever logged, however late it came."""
    day = utc_text(instant(F.col("created_at")), "yyyy-MM-dd").alias("day")
    rows = _drained(source(spark, folder).select("log_id", "action", day), "append", f"{shared_folder(spark)}/activity-{uuid.uuid4().hex}")
    once = rows.groupBy("log_id").agg(F.min(F.struct("day", "action")).alias("x"))
    return once.groupBy("x.day", "x.action").agg(F.count("*").alias("n"))
