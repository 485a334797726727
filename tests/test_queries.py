"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import __spark_entry__ as entry
import pytest
from compare import duck_rows, spark_rows

from knowmill.plans import ingestion, numbered, reference

CORE = {n: f for m in (reference, ingestion, numbered) for n, f in m.QUERIES.items()}
SQL = {n: q for m in (reference, ingestion, numbered) for n, q in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, duck, name):
    got = spark_rows(CORE[name](spark, sf))
    if name in SQL:
        assert got == duck_rows(duck, SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["chunk_id", "doc_id", "title", "category", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())
