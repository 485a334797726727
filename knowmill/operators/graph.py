"""One-hop neighbours, dependency states, cycles and rankings on the relationship graph.

Ends are compared by key (outer white space and case don't count). Defined results: blank ends make
no edge, repeated rows of a relationship count once, empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knowmill.sources.tables import cut, instant, key_of

#: How near a related document is by the type of its relationship; others come last.
NEARNESS = {"depends_on": 1, "implements": 1, "references": 2, "related_to": 2, "contradicts": 3, "child_of": 3, "supersedes": 3}
LAST = 99
#: Hops of a round between two written tables.
STEPS = 3


def edges(relationships: DataFrame) -> DataFrame:
    """(relationship_id, project_id, type, a, b, created_at): keyed ends, each relationship once."""
    once = relationships.dropDuplicates(["relationship_id"])
    return once.select("relationship_id", "project_id", "type", key_of(F.col("from_id")).alias("a"), key_of(F.col("to_id")).alias("b"), "created_at").where("a IS NOT NULL AND b IS NOT NULL")


def both_directions(e: DataFrame) -> DataFrame:
    """(relationship_id, project_id, type, here, there, direction): each edge seen from both ends."""
    out = e.select("relationship_id", "project_id", "type", F.col("a").alias("here"), F.col("b").alias("there"), F.lit("outgoing").alias("direction"))
    return out.unionByName(e.select("relationship_id", "project_id", "type", F.col("b").alias("here"), F.col("a").alias("there"), F.lit("incoming").alias("direction")))


def neighbours(e: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each edge and direction whose other end is a current document that isn't superseded."""
    live = documents.where("status <> 'superseded'").select(key_of(F.col("doc_id")).alias("there"), F.col("doc_id").alias("related_id"), F.col("title").alias("related_title"))
    return both_directions(e).join(live, "there").select("here", "related_id", "related_title", "type", "direction", "relationship_id")


def best_relation(near: DataFrame) -> DataFrame:
    """Of each pair the nearest relationship: by type, outgoing before incoming, then by id."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in NEARNESS.items() for x in kv])[F.col("type")], F.lit(LAST))
    order = W.partitionBy("here", "related_id").orderBy("nearness", F.desc("direction"), "relationship_id")
    return near.withColumn("nearness", rank).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def degrees(e: DataFrame) -> DataFrame:
    """(node, outgoing, incoming): partial sums, so a hot node is one row a task."""
    return both_directions(e).groupBy(F.col("here").alias("node")).agg(F.count_if(F.col("direction") == "outgoing").alias("outgoing"), F.count_if(F.col("direction") == "incoming").alias("incoming"))


def repeated_edges(e: DataFrame) -> DataFrame:
    """Edges of the same ends and type that stand more than once."""
    return e.groupBy("project_id", "a", "b", "type").agg(F.count("*").alias("n"), F.min("relationship_id").alias("first_id")).where("n > 1")


def current_tasks(tasks: DataFrame) -> DataFrame:
    """The row of each task with the latest updated_at."""
    latest = tasks.groupBy(key_of(F.col("task_id")).alias("k")).agg(
        F.max_by(F.struct("task_id", "project_id", "parent_id", "title", "status", "is_blocked", "is_cancelled", "block_reason", "priority", "created_at", "updated_at"), instant(F.col("updated_at"))).alias("t")
    )
    return latest.where("k IS NOT NULL").select("k", "t.*")


def blocked_tasks(e: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, dependencies, open, blocked): a task is blocked while a dependency that exists is neither done
    nor cancelled; without dependencies a block stands if a reason is given."""
    need = e.where("type = 'task_depends_on'").select(F.col("a").alias("k"), F.col("b").alias("d")).distinct()
    state = tasks.select(F.col("k").alias("d"), ((F.col("status") != "done") & ~F.coalesce("is_cancelled", F.lit(False))).alias("is_open"))
    held = need.join(state, "d").groupBy("k").agg(F.count("*").alias("dependencies"), F.count_if("is_open").alias("open"))
    manual = F.coalesce("is_blocked", F.lit(False)) & (F.coalesce("block_reason", F.lit("")) != "")
    return tasks.join(held, "k", "left").select(
        "task_id", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("open", F.lit(0)).alias("open"),
        F.when(F.col("dependencies") > 0, F.col("open") > 0).otherwise(manual).alias("blocked"),
    )


def cyclic_nodes(e: DataFrame) -> DataFrame:
    """(node): the nodes on a directed cycle, that is of strongly connected components of more than one node, or with a self-loop.

    1. Nodes without an edge in or out are trimmed, ``STEPS`` layers a written round.
    2. Of what is left every node takes the greatest node that reaches it as its colour; a colour's own node and
       those of its colour that reach it are one component.
    3. Components and all edges that leave or enter a colour are taken out, and so on with the rest.
    Only edges and one row a node are shuffled, never pairs of nodes that reach each other.
    """
    every = cut(e.select("a", "b").distinct(), "cycle-edges")
    loops = every.where("a = b").select(F.col("a").alias("node"))
    found, left = [loops], _trimmed(every.where("a <> b"))
    while left.limit(1).count():
        colour = _spread(left, left.select(F.col("a").alias("node")).distinct().withColumn("c", F.col("node")))
        # edges inside a colour, and their nodes that reach the colour's own one
        inner = left.join(colour.select(F.col("node").alias("a"), "c"), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("d")), "b").where("c = d").select("a", "b", "c")
        inner = cut(inner, "cycle-inner")
        back = inner.select(F.col("b").alias("a"), F.col("a").alias("b"))
        part = _spread(back, colour.withColumn("c", F.when(F.col("node") == F.col("c"), F.col("c"))))
        part = part.where("c IS NOT NULL")
        several = part.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        found.append(part.join(several, "c", "left_semi").select("node"))
        rest = inner.join(part.select(F.col("node").alias("a")), "a", "left_anti").join(part.select(F.col("node").alias("b")), "b", "left_anti")
        left = _trimmed(rest.select("a", "b"))
    return reduce(DataFrame.unionByName, found).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without an edge in or without one out are taken off, again and again.

    A round keeps the edges that its last step takes off, marked, so that a step without any ends it.
    """
    ends = lambda e: e.select(F.col("b").alias("a")).distinct()
    starts = lambda e: e.select(F.col("a").alias("b")).distinct()
    left = edges.select("a", "b")
    while True:
        for _ in range(STEPS - 1):
            left = left.join(ends(left), "a", "left_semi").join(starts(left), "b", "left_semi").select("a", "b")
        last = left.join(ends(left).withColumn("i", F.lit(True)), "a", "left").join(starts(left).withColumn("o", F.lit(True)), "b", "left")
        marked = cut(last.select("a", "b", (F.col("i").isNotNull() & F.col("o").isNotNull()).alias("stays")), "cycle-edges")
        left = marked.where("stays").select("a", "b")
        if not marked.where("NOT stays").limit(1).count():
            return left


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(node, c): the greatest c among each node and all that reach it along the edges (a, b); a last hop that changes none ends it."""
    now = colour.select("node", "c")
    while True:
        for _ in range(STEPS):
            sent = edges.join(now.select(F.col("node").alias("a"), "c"), "a").groupBy(F.col("b").alias("node")).agg(F.max("c").alias("s"))
            now = now.join(sent, "node", "left").select("node", F.greatest("c", "s").alias("c"), F.col("c").alias("was"))
        now = cut(now, "cycle-colours")
        if not now.where(~F.col("c").eqNullSafe(F.col("was"))).limit(1).count():
            return now.select("node", "c")


def new_edges(e: DataFrame, proposed: DataFrame, both_ways: bool = False) -> DataFrame:
    """The proposed (project_id, type, a, b), and their reverses if asked for, that don't stand yet."""
    if both_ways:
        proposed = proposed.unionByName(proposed.select("project_id", "type", F.col("b").alias("a"), F.col("a").alias("b")))
    return proposed.select("project_id", "type", "a", "b").distinct().join(e, ["project_id", "type", "a", "b"], "left_anti")


def what_if(e: DataFrame, replaced: DataFrame, proposed: DataFrame) -> DataFrame:
    """(a, b): the edges without those that leave the ``replaced`` nodes (node), with the proposed ones."""
    kept = e.join(replaced.select(F.col("node").alias("a")), "a", "left_anti").select("a", "b")
    return kept.unionByName(proposed.select("a", "b")).distinct()
