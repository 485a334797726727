import pytest
from pyspark.sql import functions as F

from knowmill.operators.orphans import Lookup, orphan_references, orphan_report

T0, T1, T2 = "2024-01-01T00:00:00.000Z", "2024-01-31T23:30:00-05:00", "2024-03-01 00:00:00+00:00"


def tables(spark, rel=(), dec=(), kb=(), tasks=(), log=()):
    return (
        spark.createDataFrame(list(rel), "relationship_id string, project_id string, type string, from_id string, to_id string, created_at string, kind string"),
        spark.createDataFrame(list(dec), "decision_id string, project_id string, superseded_by string, created_at string, updated_at string"),
        spark.createDataFrame(list(kb), "doc_id string, project_id string, created_at string, period string"),
        spark.createDataFrame(list(tasks), "task_id string, project_id string, created_at string"),
        spark.createDataFrame(list(log), "project_id string, action string, target_id string"),
    )


def found(spark, **t):
    return {(r["fld"], r["record_id"]): (r["period"], r["kind"]) for r in orphan_references(*tables(spark, **t)).collect()}


def test_reasons(spark):
    got = found(
        spark,
        rel=[
            ("r1", "p", "references", " doc1 ", "DOC1", T1, "x"), ("r2", "p", "references", "gone", "never", T1, "x"), ("r3", "p", "references", "late", "doc1", T1, "x"),
            ("r4", "q", "references", "doc1", None, T1, "x"), ("r5", "p", "task_depends_on", "t1", "doc1", T1, "x"), ("r5", "p", "task_depends_on", "t1", "doc1", T1, "x"),
            ("r6", "p", "references", "", "  ", T1, "x"), ("r7", "p", "references", "never", "doc1", None, "x"), ("r8", "p", "references", "alive", "alive", T1, "x"),
        ],
        dec=[("d1", "p", "d2", T0, T1), ("d2", "p", None, T2, T2), ("d3", "p", " D9 ", T0, T1)],
        kb=[("Doc1", "p", T0, "x"), ("late", "p", T2, "x"), ("alive", "p", T0, "x"), ("alive", "p", T2, "x")],
        tasks=[("t1", "p", T0)],
        log=[("p", "hard_delete_document", "GONE "), ("p", "archive_document", "never"), ("p", "delete_decision", "d9"), ("p", "hard_delete_document", "late"), ("p", "hard_delete_document", "alive"), ("q", "hard_delete_document", "never"), ("p", "delete_decision", "d9")],
    )
    assert got == {
        ("from_id", "r2"): ("2024-02", "deleted"), ("to_id", "r2"): ("2024-02", "missing"), ("from_id", "r3"): ("2024-02", "late"), ("from_id", "r4"): ("2024-02", "missing"),
        ("to_id", "r5"): ("2024-02", "missing"), ("from_id", "r7"): (None, "missing"), ("superseded_by", "d1"): ("2024-02", "late"), ("superseded_by", "d3"): ("2024-02", "deleted"),
    }


def test_empty_tables(spark):
    assert found(spark) == {}
    assert found(spark, rel=[("r", "p", "x", "a", None, T0, "x")]) == {("from_id", "r"): ("2024-01", "missing")}


@pytest.mark.parametrize("hot", [0.34, 0.9])
def test_hot_keys_are_whole_and_leave_the_shuffle(spark, hot):
    n = 6000
    base = spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("relationship_id"), F.lit("p").alias("project_id"), F.lit("references").alias("type"),
        F.when(F.col("id") < int(n * hot), "hot").otherwise(F.concat(F.lit("k"), "id")).alias("from_id"), F.lit("there").alias("to_id"), F.lit(T1).alias("created_at"),
    )
    _, dec, kb, tasks, log = tables(spark, kb=[("there", "p", T0, "x")])
    given = (base, dec, kb, tasks, log)
    assert orphan_references(*given).count() == n and [r["orphans"] for r in orphan_report(*given).collect()] == [n]
    look = Lookup(*given)
    assert {r["ref"] for r in look.heavy.collect()} == {"hot", "there"}
    # what is looked up by shuffle, and what the single references are joined to by it, has no row of a heavy key
    assert look.rest.where("ref IN ('hot', 'there')").count() == 0 and look.rest.count() == n - int(n * hot)
    plan = look.orphans()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") >= 2 and look.hot.count() == 1


def test_a_record_made_in_the_period_of_its_references(spark):
    days = [f"2024-03-{d:02}T00:00:00Z" for d in range(1, 29)]
    rel = [(f"r{i}", "p", "x", "new", None, d, "x") for i, d in enumerate(days)] + [(f"q{i}", "p", "x", f"k{i}", None, days[0], "x") for i in range(3000)]
    given = tables(spark, rel=rel, kb=[("new", "p", "2024-03-15T00:00:00Z", "x")] + [(f"k{i}", "p", days[2], "x") for i in range(0, 3000, 2)])
    report = {(r["period"], r["kind"]): r["orphans"] for r in orphan_report(*given).collect()}
    assert report == {("2024-03", "late"): 14 + 1500, ("2024-03", "missing"): 1500}
    assert {r["record_id"] for r in orphan_references(*given).where("kind = 'late' AND record_id LIKE 'r%'").collect()} == {f"r{i}" for i in range(14)}


def test_the_report_counts_the_references(spark, sf):
    given = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("relationships", "decisions", "kb_documents", "tasks", "activity_log")]
    counted = orphan_references(*given).groupBy("src", "fld", "period", "kind").count().collect()
    assert sorted(map(str, map(tuple, orphan_report(*given).collect()))) == sorted(map(str, map(tuple, counted)))
