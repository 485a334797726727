"""Parent-child links to full hierarchies by nested sets, in rounds that double the reach.

1. Upward: ``jump`` of round k is the 2^k-th ancestor. A node's subtree size doubles its reach each
   round (S(u) += sum of S(v) over the v whose 2^k-th ancestor is u), so sizes, depths and roots of
   a tree of depth d take log2(d) rounds. A round moves only the nodes that haven't met their root;
   nodes that no round finishes are in or below a ring.
2. Siblings get disjoint preorder ranges by prefix sums of their subtree sizes. The sums are taken
   in two steps, over buckets of a parent's children and inside a bucket, so that a parent of a
   third of all rows is not one task's window.
3. Downward: ranges and paths add up along the ancestors, again by doubling.
   lft..rgt is the preorder range inside the tree of ``root``; descendants and ancestors are range
   conditions on it, and n_below = rgt - lft.

Each round is cut by a table in the shared folder. A join by ``jump`` meets one row a key on its
other side, so a hot parent is split by AQE and pre-aggregated by the partial sums.

Defined results: a null, blank or unknown parent makes a root; a node that is its own parent is a
ring of one; of several rows of a key the last (highest ``rank``) counts, of equal ones the greatest
parent; empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knowmill.sources.tables import Rounds, cut, instant, key_of

#: Buckets of one parent's children for the two-step prefix sums.
BUCKETS = 256


def node_rows(df: DataFrame, src: str, node_id: str, parent_id: str, rank: Column) -> DataFrame:
    """(src, k, id, p): one row a node, with its key, its id as written and its parent's key."""
    return (
        df.select(key_of(F.col(node_id)).alias("k"), F.col(node_id).alias("id"), key_of(F.col(parent_id)).alias("p"), rank.alias("rank"))
        .where("k IS NOT NULL")
        .groupBy("k").agg(F.max_by(F.struct("id", "p"), F.struct("rank", F.coalesce("p", F.lit("")))).alias("x"))
        .select(F.lit(src).alias("src"), "k", "x.id", "x.p")
    )


def linked(nodes: DataFrame) -> DataFrame:
    """(src, k, id, parent): the parent is null where the table has no such node."""
    there = nodes.select("src", F.col("k").alias("p"), F.lit(True).alias("there"))
    return nodes.join(there, ["src", "p"], "left").select("src", "k", "id", F.when(F.col("there"), F.col("p")).alias("parent"), *[c for c in nodes.columns if c == "at"])


def _upward(nodes: DataFrame, measures: list[str]) -> tuple[DataFrame, DataFrame]:
    """(src, k, depth, root) of the nodes of trees, and (src, k, *measures) summed over each node and all below it.

    ``nodes``: (src, k, parent, *measures), a written table. A round works on the nodes that haven't
    met their root yet; the others only stand to be looked up. What a round adds to the sums of the
    nodes it reaches is kept and summed once in the end.
    """
    is_root = F.col("parent").isNull()
    tree = Rounds("tree-up")
    state = [F.col("parent").alias("jump"), F.when(is_root, 0).otherwise(1).alias("depth"), F.when(is_root, F.col("k")).alias("root")]
    now = tree.put(nodes.select("src", "k", *state, *measures, F.lit(False).alias("added")))
    active = now.where("jump IS NOT NULL")
    n, before = active.count(), -1
    while n and n != before:  # depths leave no gap, so a round that finishes none finishes no later one: rings
        sums = active.groupBy("src", F.col("jump").alias("k")).agg(*[F.sum(m).alias(m) for m in measures])
        above = tree.standing().where("NOT added").select("src", F.col("k").alias("jump"), F.col("depth").alias("d2"), F.col("root").alias("r2"), F.col("jump").alias("j2"))
        more = sums.select("src", "k", *[F.col(m).alias(f"_{m}") for m in measures])
        moved = active.join(above, ["src", "jump"]).join(more, ["src", "k"], "left").select(
            "src", "k", F.col("j2").alias("jump"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("r2").alias("root"),
            *[(F.col(m) + F.coalesce(f"_{m}", F.lit(0))).alias(m) for m in measures], F.lit(False).alias("added"),
        )
        # one written table a round: the nodes that moved, and what was added to the nodes they had reached
        kept = sums.select("src", "k", *[F.lit(None).cast(kind).alias(c) for c, kind in (("jump", "string"), ("depth", "int"), ("root", "string"))], *measures, F.lit(True).alias("added"))
        now = tree.put(moved.unionByName(kept))
        active = now.where("jump IS NOT NULL")
        n, before = active.count(), n
    every = nodes.select("src", "k", *measures).unionByName(tree.rows().where("added").select("src", "k", *measures))
    return tree.finished().where("NOT added").select("src", "k", "depth", "root"), every.groupBy("src", "k").agg(*[F.sum(m).alias(m) for m in measures])


def subtree_sums(nodes: DataFrame, measures: list[str]) -> DataFrame:
    """(src, k, parent, *measures): each numeric measure summed over a node and all below it.

    Nodes in or below a ring are left out. ``nodes`` are ``linked`` rows with the measures.
    """
    nodes = cut(nodes.select("src", "k", "parent", *measures), "tree-nodes")
    trees, sums = _upward(nodes, measures)
    return nodes.select("src", "k", "parent").join(trees.select("src", "k"), ["src", "k"]).join(sums, ["src", "k"])


def _offsets(tree: DataFrame) -> DataFrame:
    """Adds ``off``: how far right of its parent's left end a node's range begins (0 of a root). Siblings stand in the
    order of ``at`` where there is such a column, then of their key; the buckets are days of it, else hashes."""
    timed = "at" in tree.columns
    kids = tree.where("parent IS NOT NULL").withColumn("bucket", F.coalesce(F.expr("unix_seconds(at) div 86400"), F.lit(-(2**62))) if timed else F.pmod(F.xxhash64("k"), F.lit(BUCKETS)))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    sums = kids.groupBy("src", "parent", "bucket").agg(F.sum("size").alias("held"))
    starts = sums.select("src", "parent", "bucket", F.coalesce(F.sum("held").over(before.partitionBy("src", "parent").orderBy("bucket")), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum("size").over(before.partitionBy("src", "parent", "bucket").orderBy(*(["at"] if timed else []), "k")), F.lit(0))
    placed = kids.withColumn("inner", inner).join(starts, ["src", "parent", "bucket"])
    roots = tree.where("parent IS NULL").withColumn("off", F.lit(0).cast("bigint"))
    return placed.select(*tree.columns, (1 + F.col("start") + F.col("inner")).alias("off")).unionByName(roots)


def nested_sets(nodes: DataFrame) -> DataFrame:
    """(src, k, id, parent, root, top, depth, path, lft, rgt) of every node, top being the root's id; root, top, path, lft and rgt are null in or below a ring.

    nodes: (src, k, id, p), and ``at`` where siblings have an order in time.
    """
    all_nodes = cut(linked(nodes).withColumn("size", F.lit(1).cast("bigint")), "tree-nodes")
    trees, sums = _upward(all_nodes, ["size"])
    whole = all_nodes.drop("size").join(trees, ["src", "k"], "left").join(sums, ["src", "k"])
    tree = cut(_offsets(whole.where("root IS NOT NULL")), "tree-ranges")
    down = Rounds("tree-down")
    now = down.put(tree.select("src", "k", F.col("parent").alias("jump"), F.col("off").alias("lft"), F.col("id").alias("path"), F.col("id").alias("top")))
    active = now.where("jump IS NOT NULL")
    while active.limit(1).count():
        above = down.standing().select("src", F.col("k").alias("jump"), F.col("lft").alias("l2"), F.col("path").alias("p2"), F.col("top").alias("t2"), F.col("jump").alias("j2"))
        now = down.put(
            active.join(above, ["src", "jump"]).select("src", "k", F.col("j2").alias("jump"), (F.col("lft") + F.col("l2")).alias("lft"), F.concat("p2", F.lit(">"), "path").alias("path"), F.col("t2").alias("top"))
        )
        active = now.where("jump IS NOT NULL")
    placed = tree.drop("off").join(down.finished(), ["src", "k"]).select("src", "k", "id", "parent", "root", "top", "depth", "path", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"))
    null = lambda kind: F.lit(None).cast(kind)
    ring = all_nodes.join(trees.select("src", "k"), ["src", "k"], "left_anti").select("src", "k", "id", "parent", null("string").alias("root"), null("string").alias("top"), F.lit(-1).alias("depth"), null("string").alias("path"), null("bigint").alias("lft"), null("bigint").alias("rgt"))
    return placed.unionByName(ring)


def descendants_of(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(src, ancestor, k, depth) of all nodes below the chosen (src, k): left ends inside the chosen one's range.

    A range is cut into at most two pieces of each power of two, a left end lies in one block of each, and pieces and
    blocks meet by equality. A block of a piece lies wholly in the range, so the join makes no row that isn't a
    result, however large the tree.
    """
    levels = int(sets.agg(F.max("rgt")).first()[0] or 0).bit_length() + 1
    a = sets.where("rgt > lft").join(chosen.select("src", "k").distinct(), ["src", "k"], "left_semi")
    none = F.expr("cast(array() as array<struct<level:int,block:bigint>>)")
    piece = lambda b, block, odd: F.when(odd, F.array(F.struct(b.alias("level"), block.alias("block")))).otherwise(none)

    def step(acc, b):
        left, right = acc["l"] % 2 == 1, (acc["r"] % 2 == 1) & (acc["l"] + (acc["l"] % 2) < acc["r"])
        more = F.concat(piece(b, acc["l"], left & (acc["l"] < acc["r"])), piece(b, acc["r"] - 1, right))
        lo, hi = acc["l"] + (acc["l"] % 2), acc["r"] - (acc["r"] % 2)
        return F.struct(F.shiftright(lo, 1).alias("l"), F.shiftright(hi, 1).alias("r"), F.concat(acc["p"], more).alias("p"))

    start = F.struct((F.col("lft") + 1).alias("l"), (F.col("rgt") + 1).alias("r"), none.alias("p"))
    pieces = F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step)["p"]
    a = a.select("src", "root", F.col("k").alias("ancestor"), F.explode(pieces).alias("x")).select("src", "root", "ancestor", "x.level", "x.block")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda b: F.struct(b.alias("level"), F.call_function("shiftright", F.col("lft"), b).alias("block")))
    b = sets.where("lft IS NOT NULL").select("src", "root", "k", "depth", F.explode(blocks).alias("x")).select("src", "root", "k", "depth", "x.level", "x.block")
    return b.join(a, ["src", "root", "level", "block"]).select("src", "ancestor", "k", "depth")


def subtrees(sets: DataFrame, max_depth: int = 5, max_nodes: int = 200) -> DataFrame:
    """(src, start, k, level, place): of each node's tree the nodes less than ``max_depth`` below it, at most ``max_nodes``
    level by level, siblings in their order.

    Inside a level that order is the one of the left ends. Ancestors are read off the path (ids without '>'), so that a node gives
    at most ``max_depth`` rows; places beyond the limit are dropped before the shuffle.
    """
    above = F.split(F.lower("path"), ">")
    up = F.least(F.size(above), F.lit(max_depth))
    each = sets.where("path IS NOT NULL").select("src", "k", "lft", F.posexplode(F.reverse(F.slice(above, -up, up))).alias("level", "start"))
    order = W.partitionBy("src", "start").orderBy("level", "lft")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_nodes).select("src", "start", "k", "level", "place")


def truncations(sets: DataFrame, shown: DataFrame) -> DataFrame:
    """(src, k, shown, hidden, in_tree): of each node's subtree the nodes ``subtrees`` gives and leaves out, and the nodes of its whole tree."""
    counts = shown.groupBy("src", F.col("start").alias("k")).agg(F.count("*").alias("shown"))
    roots = sets.where("k = root").select("src", "root", (F.col("rgt") + 1).alias("in_tree"))
    held = sets.where("root IS NOT NULL").select("src", "k", "root", (F.col("rgt") - F.col("lft") + 1).alias("size"))
    both = held.join(counts, ["src", "k"]).join(roots, ["src", "root"])
    return both.select("src", "k", "shown", (F.col("size") - F.col("shown")).alias("hidden"), "in_tree")


def hierarchies(nodes: DataFrame) -> DataFrame:
    """(src, node_id, root_id, depth, path, n_below); '' and -1 in or below a ring."""
    sets = nested_sets(nodes)
    return sets.select(
        "src", F.col("id").alias("node_id"), F.coalesce("top", F.lit("")).alias("root_id"), F.col("depth").cast("int").alias("depth"),
        F.coalesce("path", F.lit("")).alias("path"), F.coalesce(F.col("rgt") - F.col("lft"), F.lit(-1)).cast("bigint").alias("n_below"),
    )


def task_and_document_nodes(kb: DataFrame, tasks: DataFrame) -> DataFrame:
    """The parent of a document is that of its highest version, of a task that of its latest row."""
    return node_rows(kb, "kb_documents", "doc_id", "parent_id", F.col("version")).unionByName(
        node_rows(tasks, "tasks", "task_id", "parent_id", instant(F.col("updated_at")))
    )
