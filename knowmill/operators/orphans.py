"""References to records that do not exist, by a skew-aware split.

1. References are pre-aggregated by key (target table, project, ref), place and period, with their
   number and the earliest and latest time.
2. Keys that hold more than one in ``HEAVY_SHARE`` of all references are heavy, hence fewer than
   ``HEAVY_SHARE``. They are broadcast: records and deletions are filtered by them where they are read.
3. The remaining keys are looked up by shuffle, one row a key, place and period: those without a record
   (the anti-join), and those whose record came after a reference of the period.
4. The orphan counts of both are united. Where a key's record was made in the very period, the
   references of that key and period are counted one by one.

Single references are joined to the orphan keys last: heavy ones by broadcast, taken out before the
others are shuffled.

Defined results: a null or blank reference is none; a reference whose time can't be read has a null
period and is never late; rows without a project_id are of one project; rows that share a key count once (least text first); an empty target
table makes every reference missing or deleted; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.sources.tables import cut, instant, key_of, utc_text

#: A key is heavy if it holds more than one in so many references; also the bound of the broadcast rows.
HEAVY_SHARE = 1000
#: Which logged action deletes a row of which table.
DELETIONS = {"hard_delete_document": "kb_documents", "delete_task": "tasks", "delete_decision": "decisions"}


#: What makes a key, and the place and period of its references.
BY = ["target", "project_id", "ref"]
PLACE = ["src", "fld", "period"]


def _project() -> Column:
    return F.coalesce("project_id", F.lit(""))


def references(relationships: DataFrame, decisions: DataFrame) -> DataFrame:
    """(src, fld, record_id, target, project_id, ref, at, period): every reference, each record once."""
    rel = relationships.groupBy("relationship_id").agg(
        F.min(F.struct(_project().alias("project_id"), "type", "from_id", "to_id", "created_at")).alias("r")
    ).select("relationship_id", "r.*")
    ends = rel.select(
        F.lit("relationships").alias("src"), F.col("relationship_id").alias("record_id"), "project_id",
        F.when(F.col("type") == "task_depends_on", "tasks").otherwise("kb_documents").alias("target"),
        instant(F.col("created_at")).alias("at"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("fld"), key_of(F.col(c)).alias("ref")) for c in ("from_id", "to_id")])).alias("x"),
    ).select("src", "x.fld", "record_id", "target", "project_id", "x.ref", "at")
    dec = decisions.where(key_of(F.col("superseded_by")).isNotNull()).groupBy("decision_id").agg(
        F.max(F.struct(instant(F.col("updated_at")).alias("at"), _project().alias("project_id"), key_of(F.col("superseded_by")).alias("ref"))).alias("r")
    ).select(F.lit("decisions").alias("src"), F.lit("superseded_by").alias("fld"), F.col("decision_id").alias("record_id"), F.lit("decisions").alias("target"), "r.project_id", "r.ref", "r.at")
    return ends.unionByName(dec).where(F.col("ref").isNotNull()).withColumn("period", utc_text(F.col("at"), "yyyy-MM"))


def records(kb: DataFrame, tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(target, project_id, ref, since): the rows that references may mean."""
    one = lambda df, name, key: df.select(F.lit(name).alias("target"), _project().alias("project_id"), key_of(F.col(key)).alias("ref"), instant(F.col("created_at")).alias("since"))
    rows = one(kb, "kb_documents", "doc_id").unionByName(one(tasks, "tasks", "task_id")).unionByName(one(decisions, "decisions", "decision_id"))
    return rows.where(F.col("ref").isNotNull())


def deletions(log: DataFrame) -> DataFrame:
    """(target, project_id, ref): the logged deletions."""
    target = F.create_map(*[F.lit(x) for kv in DELETIONS.items() for x in kv])[F.col("action")]
    return log.where(F.col("action").isin(*DELETIONS)).select(target.alias("target"), _project().alias("project_id"), key_of(F.col("target_id")).alias("ref")).where("ref IS NOT NULL")


class Lookup:
    """The references of all places against the records: counts of each key and period, split by the key's weight."""

    def __init__(self, relationships: DataFrame, decisions: DataFrame, kb: DataFrame, tasks: DataFrame, log: DataFrame):
        there, gone = records(kb, tasks, decisions), deletions(log)
        self.refs = cut(references(relationships, decisions), "references")
        counts = cut(self.refs.groupBy(*BY, *PLACE).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")), "reference-counts")
        total = self.refs.count()
        self.heavy = cut(counts.groupBy(*BY).agg(F.sum("n").alias("n")).where(F.col("n") * HEAVY_SHARE > F.lit(total)).select(*BY), "heavy-keys")
        of_heavy = lambda df: df.join(F.broadcast(self.heavy), BY, "left_semi")  # noqa: E731  # fewer than HEAVY_SHARE rows, by definition
        since = lambda df: df.groupBy(*BY).agg(F.min("since").alias("since")).withColumn("there", F.lit(True))
        marked = lambda df: df.distinct().withColumn("gone", F.lit(True))
        status = self.heavy.join(since(of_heavy(there)), BY, "left").join(marked(of_heavy(gone)), BY, "left")
        self.hot = counts.join(F.broadcast(status), BY).where(self.may_lack())
        light = counts.join(F.broadcast(self.heavy), BY, "left_anti")
        self.rest = light.join(since(there), BY, "left").where(self.may_lack()).join(marked(gone), BY, "left")

    @staticmethod
    def may_lack() -> Column:
        """Whether some of the references from ``lo`` on have no record at their time."""
        return F.col("there").isNull() | F.coalesce(F.col("since") > F.col("lo"), F.lit(False))

    @staticmethod
    def kind() -> Column:
        return F.when(F.col("there"), "late").when(F.col("gone"), "deleted").otherwise("missing")

    def single(self, hot: DataFrame, rest: DataFrame) -> DataFrame:
        """The orphans among the single references of the given keys (and periods, where they have one)."""
        by = [c for c in (*BY, *PLACE) if c in hot.columns]
        light = self.refs.join(F.broadcast(self.heavy), BY, "left_anti")
        both = self.refs.join(F.broadcast(hot), by).unionByName(light.join(rest, by))  # hot: fewer than HEAVY_SHARE keys
        return both.where(F.col("there").isNull() | (F.col("since") > F.col("at")))

    def orphans(self) -> DataFrame:
        keys = lambda df: df.groupBy(*BY).agg(F.min("since").alias("since"), F.bool_or("there").alias("there"), F.bool_or("gone").alias("gone"))
        return self.single(keys(self.hot), keys(self.rest)).select("src", "fld", "record_id", "period", self.kind().alias("kind"))

    def counts(self) -> DataFrame:
        every = cut(self.hot.unionByName(self.rest), "orphan-counts")
        # a record made in the period: after some of its references, before others
        some = F.col("there") & (F.coalesce(F.col("since") <= F.col("hi"), F.lit(False)))
        split = every.where(some).drop("n", "lo", "hi")
        whole = every.where(~F.coalesce(some, F.lit(False))).select(*PLACE, self.kind().alias("kind"), "n")
        late = self.single(split.join(F.broadcast(self.heavy), BY, "left_semi"), split).select(*PLACE, F.lit("late").alias("kind"), F.lit(1).cast("bigint").alias("n"))
        return whole.unionByName(late).groupBy(*PLACE, "kind").agg(F.sum("n").alias("orphans"))


def orphan_references(relationships: DataFrame, decisions: DataFrame, kb: DataFrame, tasks: DataFrame, log: DataFrame) -> DataFrame:
    """One row (src, fld, record_id, period, kind) for each reference whose record is not there."""
    return Lookup(relationships, decisions, kb, tasks, log).orphans()


def orphan_report(relationships: DataFrame, decisions: DataFrame, kb: DataFrame, tasks: DataFrame, log: DataFrame) -> DataFrame:
    """(src, fld, period, kind, orphans): the united counts of heavy and other keys."""
    return Lookup(relationships, decisions, kb, tasks, log).counts()
