"""Token-budgeted context: candidates of two kinds, a weighted score, and a greedy fill that skips what doesn't fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knowmill.sources.tables import cut, instant, key_of

def candidates(documents: DataFrame, code: DataFrame, bias: float = 0.5) -> DataFrame:
    """(project_id, kind, id, tokens, score, ...): current documents and code chunks, whose ``tokens`` are counted, with their weights."""
    base = F.when(F.col("priority").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("priority") / 10)))
    docs = documents.where("status <> 'superseded' AND category <> 'code_file'").select(
        "project_id", F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "tokens",
        (base * (1 + bias)).alias("score"), F.coalesce("priority", F.lit(999)).alias("priority"), instant(F.col("updated_at")).alias("updated"),
    )
    chunks = code.select(
        "project_id", F.lit("code").alias("kind"), F.col("chunk_id").alias("id"), "tokens",
        F.lit(0.5 * (2 - bias)).alias("score"), F.lit(999).alias("priority"), instant(F.col("created_at")).alias("updated"),
    )
    return docs.unionByName(chunks)


def placed(rows: DataFrame) -> DataFrame:
    """Adds the place of each candidate in its project. A hot project is placed in two steps: by score, kind, priority
    and day, then inside those."""
    parts = ["project_id", "score", "kind", "priority", "day"]
    rows = cut(rows.select("project_id", "kind", "id", "tokens", "score", "priority", "updated", F.expr("unix_seconds(updated) div 86400").alias("day")), "candidates")
    sizes = rows.groupBy(*parts).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("project_id").orderBy(F.desc("score"), F.desc("kind"), "priority", F.desc("day")).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in parts], F.coalesce(before, F.lit(0)).alias("before"))
    inner = rows.withColumn("i", F.row_number().over(W.partitionBy(*parts).orderBy(F.desc("updated"), "id")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts])
    return inner.join(starts, same).select("project_id", (F.col("before") + F.col("i")).cast("int").alias("place"), "kind", "id", "tokens")


def fill(rows: DataFrame, key: list[str], order: list[str], budget: int) -> DataFrame:
    """Of each key's rows, in order, those that fit the budget after ``spent``: one too large is skipped, later smaller
    ones still count. Adds ``used``.

    What is left only shrinks, so of equal sizes those taken are the first ones, left / size at most. The rest can't be
    taken and is dropped before the fold, which then holds at most left * (1 + ln(left)) rows of a key, however many
    it has. Rows without tokens take nothing and don't enter the fold.
    """
    left = F.lit(budget) - F.col("spent")
    fits = rows.where((F.col("tokens") >= 0) & (F.col("tokens") <= left))
    nth = F.row_number().over(W.partitionBy(*key, "tokens").orderBy(*order))
    able = fits.where("tokens > 0").withColumn("_n", nth).where(F.col("_n") <= F.floor(left / F.col("tokens"))).drop("_n")
    names = [*order, *[c for c in rows.columns if c not in {*key, *order, "spent"}]]
    lists = able.groupBy(*key).agg(F.min("spent").alias("spent"), F.sort_array(F.collect_list(F.struct(*names))).alias("xs"))
    kind = ",".join(f"`{c}`:{dict(rows.dtypes)[c]}" for c in names)
    start = F.struct(F.col("spent").cast("bigint").alias("used"), F.expr(f"cast(array() as array<struct<{kind},used:bigint>>)").alias("kept"))
    step = lambda acc, x: F.when(
        acc["used"] + x["tokens"] <= budget,
        F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(acc["kept"], F.array(F.struct(*[x[c].alias(c) for c in names], (acc["used"] + x["tokens"]).alias("used")))).alias("kept")),
    ).otherwise(acc)
    taken = lists.select(*key, F.explode(F.aggregate("xs", start, step)["kept"]).alias("x")).select(*key, "x.*")
    steps = taken.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.collect_list(F.struct(F.struct(*order).alias("at"), "used")).alias("steps"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    earlier = F.transform(F.filter("steps", lambda s: s["at"] < F.struct(*order)), lambda s: s["used"])
    free = fits.where("tokens = 0").join(steps, same, "left").select(*key, *names, F.coalesce(F.array_max(earlier), F.col("spent").cast("bigint")).alias("used"))
    return taken.unionByName(free)


def budget_fill(rows: DataFrame, budget: int) -> DataFrame:
    """Of each project's candidates those that fit the budget, in order: one too large is skipped, later
    smaller ones still count. (project_id, place, kind, id, tokens, used)."""
    filled = fill(placed(rows).withColumn("spent", F.lit(0)), ["project_id"], ["place"], budget)
    return filled.select("project_id", "place", "kind", "id", "tokens", F.col("used").cast("int"))


def detailed(requested: DataFrame, documents: DataFrame, related: DataFrame, budget: int, code: DataFrame | None = None, key: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Requested documents whole, and code chunks of the requested ids that are no document, then the project's related
    documents under what is left of the budget. Documents and chunks come with their ``tokens``, not with their contents.

    requested: (key, project_id, k), one request a key, which holds project_id; code: (project_id, chunk_id, tokens);
    related: best relations (here, related_id, nearness).
    (key, part, id, tokens, used)
    """
    key = list(key)
    of = list(dict.fromkeys([*key, "project_id"]))
    live = cut(documents.where("status <> 'superseded'").select("project_id", "k", F.col("doc_id").alias("id"), "tokens"), "live")
    requested = cut(requested.select(*of, "k"), "requested")
    asked = requested.join(live, ["project_id", "k"])
    if code is not None:
        chunks = code.select("project_id", key_of(F.col("chunk_id")).alias("k"), F.col("chunk_id").alias("id"), "tokens")
        unmatched = requested.join(live.select("project_id", "k"), ["project_id", "k"], "left_anti")
        asked = asked.unionByName(unmatched.join(chunks, ["project_id", "k"]))
    spent = asked.groupBy(*key).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("spent"))
    near = requested.select(*of, F.col("k").alias("here")).join(related, "here").groupBy(*of, "related_id").agg(F.min("nearness").alias("nearness"))
    held = near.join(live.withColumnRenamed("id", "related_id"), ["project_id", "related_id"]).join(requested, [*of, "k"], "left_anti")
    rows = held.join(spent, key, "left").select(*key, "nearness", F.col("related_id").alias("id"), "tokens", F.coalesce("spent", F.lit(0)).alias("spent"))
    rest = fill(rows, key, ["nearness", "id"], budget).select(*key, F.lit("related").alias("part"), "id", "tokens", "used")
    return asked.select(*key, F.lit("requested").alias("part"), "id", "tokens", F.lit(None).cast("bigint").alias("used")).unionByName(rest)
