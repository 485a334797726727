"""Reading the given tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that may surround a key or a value (fixed set: Unicode white space and the zero-width marks).
SPACE = r"[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"


#: The temporary folder of this process, once it was needed.
_LOCAL: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in that of ``spark.checkpoint.dir``; its tables may go when the application has ended. Only a local master (tests, a laptop) may leave it unset: a temporary
    folder of this machine is made then, and removed at the end."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/knowmill-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-knowmill-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    The plan starts anew at the written files, so an iterative job neither grows its plan nor
    depends on any one executor; the file sizes let the optimizer choose joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def key_of(col: Column) -> Column:
    """Keys are the same when they differ only in outer white space or letter case; a blank key is null."""
    key = F.lower(trimmed(col))
    return F.when(key != "", key)


def instant(col: Column) -> Column:
    """ISO-8601 text of any offset and precision as a point in time; anything else is null."""
    return F.try_to_timestamp(col)


def utc_text(at: Column, pattern: str) -> Column:
    """A point in time written in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), pattern)


class Rounds:
    """A table in the shared folder that grows by one batch a round, for jobs that work on what is unfinished.

    Rows with a null ``jump`` are finished. All rounds are read as one table, so each round's plan
    is the same, however many there were.
    """

    def __init__(self, name: str):
        self.name, self.path, self.last, self.schema, self.spark = name, "", -1, None, None

    def put(self, df: DataFrame) -> DataFrame:
        """Writes the next round's rows and reads them back."""
        if self.spark is None:
            self.spark, self.schema = df.sparkSession, df.schema
            self.path = f"{shared_folder(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        self.last += 1
        df.select(*self.schema.names).write.parquet(f"{self.path}/round={self.last}")
        return self.rows().where(F.col("round") == self.last).drop("round")

    def rows(self) -> DataFrame:
        """The rows of all rounds, with their ``round``."""
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField("round", T.IntegerType())])).parquet(self.path)

    def standing(self) -> DataFrame:
        """Finished rows of all rounds, and the last round's others."""
        return self.rows().where(F.col("jump").isNull() | (F.col("round") == self.last)).drop("round")

    def finished(self) -> DataFrame:
        return self.rows().where(F.col("jump").isNull()).drop("round", "jump")
