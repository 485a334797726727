"""Most similar vectors for every vector: pruned graphs over shards, beam search of the right shards.

1. Cells: spherical k-means on a bounded sample (``SAMPLE`` vectors at most); neighbouring cells are
   put together to shards of about ``SHARD`` vectors.
2. Equal vectors are one class (pre-aggregated group by a hash of 128 bits); only one of each
   goes on, and at most k + 1 members of a class, the first by id, take part as neighbours.
3. Routes: every vector is a member of its nearest cell's shard, and a query to the shards of those of its
   ``PROBES`` nearest cells whose centre is at most ``RATIO`` times as far as the nearest one, or less similar
   by ``MARGIN`` at most (or to all shards). Member and query of one shard travel as one row.
4. Hot shards are split: members beyond ``PIECE`` times ``SHARD`` into pieces by hash, each a graph that
   all the shard's queries search; queries beyond ``CHUNK`` into chunks that each meet the members.
   So no group holds many more members or queries than that, and nothing is left out.
5. In each group the graph is built (greedy searches propose neighbours, relaxed pruning keeps diverse
   edges) and beam search answers the queries. A group's answers to a query travel as one row of arrays;
   the best k of all groups are ranked per query.

Broadcast are the cells, at most ``CELLS`` times 64 floats, and the names of classes that hold more than
one in ``HEAVY_SHARE`` of all copies, so fewer than that.

Vectors that are null, of another length, zero or not finite belong to no pair. Ties are broken by
id; rows that share an id count once; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knowmill.llm.vectorgraph import Graph
from knowmill.sources.tables import cut

DIM = 64
SHARD, CHUNK = 2_000, 60_000
#: A piece holds at most so many times the members of a shard.
PIECE = 3
CELLS_A_SHARD, PROBES, RATIO, MARGIN = 16, 16, 1.2, 0.08
TASKS = 10_000
CELLS, SAMPLE = 16_384, 131_072
DEGREE, BUILD_BEAM, BEAM, ALPHA = 24, 30, 20, 1.2
#: A class is heavy if it holds more than one in so many of all copies; also the bound of the broadcast rows.
HEAVY_SHARE = 1000


def unit_vectors(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors (lists of ``dim`` numbers) are usable, and those at length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    most = np.abs(x).max(axis=1, initial=0)  # a null is read as NaN
    usable = np.isfinite(most) & (most > 0)
    x = x[usable] / most[usable, None]
    return usable, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _packed(x: np.ndarray) -> pa.Array:
    n, width = len(x), x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _unpacked(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([_unpacked(c, dim) for c in column.chunks]) if column.num_chunks else np.empty((0, dim), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of spherical k-means and how much of the sample each holds."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = _nearest(sample, c, 1)[0][:, 0]
        order = np.argsort(home, kind="stable")
        held = np.bincount(home, minlength=len(c))
        some = held > 0
        sums = np.add.reduceat(sample[order], np.r_[0, np.cumsum(held[some])[:-1]], axis=0)
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32), np.bincount(_nearest(sample, c, 1)[0][:, 0], minlength=len(c))


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest centres of each vector, best first, and their cosines; in blocks of a few million products."""
    k, block = min(k, len(c)), max(64, 2**22 // len(c))
    near, cos = np.empty((len(x), k), np.int32), np.empty((len(x), k), np.float32)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ c.T
        top = s.argmax(1)[:, None] if k == 1 else np.argpartition(-s, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(s, top, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        near[a : a + block], cos[a : a + block] = np.take_along_axis(top, order, 1), np.take_along_axis(own, order, 1)
    return near, cos


def group_cells(centres: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each cell: halved along the direction of most spread until the weights are small enough."""
    out, todo, number = np.zeros(len(centres), np.int32), [np.arange(len(centres))], 0
    limit = weight.sum() / max(1, shards)
    while todo:
        part = todo.pop()
        w = weight[part]
        if len(part) == 1 or w.sum() <= limit:
            out[part] = number
            number += 1
            continue
        x = centres[part] - centres[part].mean(0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        order = np.argsort(along, kind="stable")
        half = int(np.clip(np.searchsorted(np.cumsum(w[order]), w.sum() / 2) + 1, 1, len(part) - 1))
        todo += [part[order[:half]], part[order[half:]]]
    return out


def nearest_vectors(
    rows: DataFrame, k: int = 10, min_cos: float = -1.0, probes: int | None = PROBES, query_share: int = 1,
    shard: int = SHARD, beam: int = BEAM, dim: int = DIM,
) -> DataFrame:
    """(id, vector) -> (id, other, cos, place): the k most similar other vectors of each, of cosine ``min_cos`` at least.

    probes: cells whose shards a query may search; None means every shard. query_share: only ids whose
    hash is divisible by it are queries (all are indexed).
    """
    spark = rows.sparkSession
    # 128 bits stand for the vector
    long = rows.where(F.coalesce(F.size("vector"), F.lit(-1)) == dim).select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    total = long.count()
    if total == 0:
        return spark.createDataFrame([], "id string, other string, cos double, place int")
    shards = max(1, math.ceil(total / shard))
    cells = min(CELLS, shards * CELLS_A_SHARD)
    size = min(SAMPLE, max(1000, 32 * cells))
    # at most SAMPLE vectors, for the centres only
    sample = [r["vector"] for r in long.select("vector").sample(min(1.0, 0.95 * size / total), seed=7).limit(size).collect()]
    points = np.unique(unit_vectors(pa.array(sample, pa.list_(pa.float32())), dim)[1], axis=0) if sample else np.empty((0, dim), np.float32)
    points = points if len(points) else np.ones((1, dim), np.float32)
    centres, weight = fit_cells(points, min(cells, len(points)))
    held = spark.sparkContext.broadcast((centres, group_cells(centres, weight, shards)))
    everywhere = probes is None

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard_of = held.value
        for batch in batches:
            usable, x = unit_vectors(batch.column(0), dim)
            near, cos = _nearest(x, c, 1 if everywhere else probes)
            near = shard_of[near]
            home = near[:, 0].copy()
            far = np.sqrt(np.maximum(2 - 2 * cos, 0))
            near[(far > RATIO * far[:, :1]) & (cos < cos[:, :1] - MARGIN)] = -1
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            offsets = np.r_[0, np.cumsum(fresh.sum(1))].astype(np.int32)
            asked = pa.ListArray.from_arrays(pa.array(offsets), pa.array(near[fresh].astype(np.int32)))
            rest = batch.select([1, 2, 3]).filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays([*rest.columns, _packed(x), pa.array(home.astype(np.int32)), asked], ["id", "last", "is_query", "v", "home", "asked"])

    asks = F.pmod(F.xxhash64("id"), F.lit(query_share)) == 0
    repeats = cut(long.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"), "vector-repeats")
    # a vector that stands once isn't shuffled for this
    once = long.join(repeats, ["h1", "h2"], "left_anti").select("vector", "id", F.col("id").alias("last"), asks.alias("is_query"))
    several = long.join(repeats.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.min("id").alias("id"), F.max("id").alias("last"), F.max(asks).alias("is_query")).drop("h1", "h2")
    routed = cut(once.unionByName(several).mapInArrow(route, "id string, last string, is_query boolean, v binary, home int, asked array<int>"), "vector-routes")
    # sizes of the shards: at most CELLS rows
    members = dict(routed.groupBy("home").count().collect())
    asked = routed.where("is_query")
    if everywhere:
        n_asked = asked.count()
        queries = dict.fromkeys(members, n_asked)
        asked = asked.withColumn("asked", F.array(*map(F.lit, sorted(members))))
    else:
        queries = dict(asked.select(F.explode("asked").alias("s")).groupBy("s").count().collect())
    pieces = {s: math.ceil(n / (PIECE * shard)) for s, n in members.items()}
    chunks = {s: max(1, math.ceil(queries.get(s, 0) / CHUNK)) for s in members}
    plan = F.broadcast(spark.createDataFrame([(s, pieces[s], chunks[s]) for s in sorted(members)], "shard int, pieces int, chunks int"))
    piece, chunk = F.pmod(F.xxhash64(F.lit(2), "id"), F.col("pieces")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "id"), F.col("chunks")).cast("int")
    ask = (
        asked.select("id", "v", "home", F.explode("asked").alias("shard")).join(plan, "shard")
        .select("id", "v", "shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), chunk.alias("chunk"), F.lit(True).alias("asks"), (F.col("home") == F.col("shard")).alias("at_home"), piece.alias("own"))
        .select("id", "v", "shard", "piece", "chunk", "asks", (F.col("at_home") & (F.col("piece") == F.col("own"))).alias("member"))
    )
    # members that aren't among the queries of their own group already
    be = (
        routed.withColumnRenamed("home", "shard").join(plan, "shard")
        .select("id", "v", "is_query", "shard", piece.alias("piece"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), chunk.alias("own"))
        .where(~F.col("is_query") | (F.col("chunk") != F.col("own"))).select("id", "v", "shard", "piece", "chunk", F.lit(False).alias("asks"), F.lit(True).alias("member"))
    )

    def answer(table: pa.Table) -> pa.Table:
        asking, being = (table.column(c).to_numpy().astype(bool) for c in ("asks", "member"))
        ids = np.array(table.column("id").to_pylist(), object)
        x = _unpacked(table.column("v"), dim)
        index, question = np.flatnonzero(being), np.flatnonzero(asking)
        if not len(index) or not len(question):
            return pa.table({"id": pa.array([], pa.string()), "others": pa.array([], pa.list_(pa.string())), "cos": pa.array([], pa.list_(pa.float32()))})
        place = np.full(len(ids), -1)
        place[index] = np.arange(len(index))
        near, cos = Graph(x[index], DEGREE, BUILD_BEAM, ALPHA).nearest(x[question], k, beam, place[question])
        good = (near >= 0) & (cos >= min_cos)
        some = good.any(1)
        near, cos, good = near[some], cos[some], good[some]
        offsets = pa.array(np.r_[0, np.cumsum(good.sum(1))].astype(np.int32))
        lists = lambda values: pa.ListArray.from_arrays(offsets, values)
        return pa.table({"id": pa.array(ids[question][some], pa.string()), "others": lists(pa.array(ids[index][near[good]], pa.string())), "cos": lists(pa.array(cos[good], pa.float32()))})

    groups = sum(pieces[s] * chunks[s] for s in members)
    # a task a group, within reason: groups of one task can't be split later
    met = ask.unionByName(be).repartition(max(1, min(groups, TASKS)), "shard", "piece", "chunk").groupBy("shard", "piece", "chunk").applyInArrow(answer, "id string, others array<string>, cos array<float>")
    # the arrays go through the shuffle; the ranking keeps that partitioning
    each = met.repartition("id").select("id", F.explode(F.arrays_zip("others", "cos")).alias("x")).select("id", F.col("x.others").alias("other"), F.col("x.cos").cast("double").alias("cos"))
    ranked = W.partitionBy("id").orderBy(F.desc("cos"), "other")
    found = each.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
    classes = repeats.where("rep <> last").join(routed.where("id <> last").select(F.col("id").alias("rep")), "rep", "left_semi")
    return _with_copies(long.select("id", "h1", "h2"), classes, found, k, query_share).where(F.col("cos") >= min_cos)


def _with_copies(rows: DataFrame, classes: DataFrame, found: DataFrame, k: int, query_share: int) -> DataFrame:
    """Neighbours of all members of the classes, from those of the classes' first members.

    A class is named by its first member. The members of a heavy class are dealt to as many parts as it
    holds thousandths of all copies, and what each member gets, at most 2 k + 1 neighbours, goes to every part.
    """
    members = cut(rows.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id").distinct(), "vector-copies")
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    first = members.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1)  # limited before the shuffle
    parts = F.ceil(F.col("size") * HEAVY_SHARE / F.lit(max(1, members.count()))).cast("int")  # 1 unless heavy
    held = cut(first.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("firsts")).join(sizes, "rep").withColumn("parts", parts), "vector-firsts")
    every = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    heavy = held.where("parts > 1").select("rep", "parts")  # fewer than HEAVY_SHARE
    dealt = members.join(F.broadcast(heavy), "rep", "left").select("rep", F.col("id").alias("copy"), F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    asks = F.pmod(F.xxhash64("id"), F.lit(query_share)) == 0
    # inside a class: the first k others by id
    own = dealt.join(every(held.select("rep", "firsts", "parts")), ["rep", "part"])
    inside = own.select(F.col("copy").alias("id"), F.posexplode(F.slice(F.filter("firsts", lambda x: x != F.col("copy")), 1, k)).alias("n", "other")).select("id", "other", F.lit(1.0).alias("cos"), (F.col("n") + 1).alias("place"))
    # across: a neighbour stands for its first members, a class of k or fewer members asks for all of them
    others = found.join(held.select(F.col("rep").alias("other"), "firsts"), "other", "left").select("id", F.explode(F.coalesce("firsts", F.array("other"))).alias("other"), "cos")
    others = others.join(held.select(F.col("rep").alias("id"), "size", "parts"), "id", "left")
    before = F.coalesce(F.col("size") - 1, F.lit(0))
    ranked = others.withColumn("place", (before + F.row_number().over(W.partitionBy("id").orderBy(F.desc("cos"), "other"))).cast("int")).where(F.col("place") <= k)
    across = every(ranked).join(dealt.withColumnRenamed("rep", "id"), ["id", "part"], "left").where("size IS NULL OR copy IS NOT NULL")  # a part may be empty
    across = across.select(F.coalesce("copy", "id").alias("id"), "other", "cos", "place")
    return across.unionByName(inside).where(asks)


def collection(code: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, vector) of both chunk tables."""
    one = lambda df: df.select(F.col("chunk_id").alias("id"), "vector")
    return one(code).unionByName(one(chunks))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b): each pair once, smaller id first."""
    return neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
