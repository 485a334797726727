"""Retrieval over chunks: exact cosine and L2 neighbours, BM25, rank fusion, filters, enrichment.

One query's side is a literal. Rows are scored where they are read and only their keys and scores go
on, so no shuffle holds vectors or contents; the best are taken by TakeOrderedAndProject. Defined
results: null, zero and other-length vectors drop out, a null text has no words, ties go to the
lesser id, of rows that share a key the best counts once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knowmill.functions.text import words
from knowmill.functions.vector import cosine_distance, distance_score, l2_squared
from knowmill.sources.tables import cut

K1, B, RRF = 1.2, 0.75, 60


def current(rows: DataFrame, *key: str, rank: Column | None = None) -> DataFrame:
    """One row a key: the one of highest rank, or any of equal copies."""
    if rank is None:
        return rows.dropDuplicates(list(key))
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(rank.desc()))).where("_r = 1").drop("_r")


def vector_of(rows: DataFrame, column: str, key: str, value: str) -> list[float] | None:
    """One row's vector, to be asked with."""
    row = rows.where(F.col(key) == value).select(column).first()
    return [float(x) for x in row[0]] if row and row[0] is not None else None


def with_documents(chunks: DataFrame, documents: DataFrame, add: tuple[str, ...] = ()) -> DataFrame:
    """Only the chunks of the given documents (a true semi-join, without a cap on the ids), with columns of these, a row each, where asked for."""
    if add:
        return chunks.join(documents.select("doc_id", *add), "doc_id")
    return chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def best(scored: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The ``limit`` best rows by ``order`` and key, a key once: a multiple of the limit is taken from the
    scan, and a larger one as long as copies fill it."""
    surplus = 2 * limit
    while True:
        rows = scored.orderBy(*order, key).limit(surplus).collect()  # bounded by the limit and the copies of its rows
        once: dict = {}
        for row in rows:
            once.setdefault(row[key], row)
        if len(once) >= limit or len(rows) < surplus:
            return scored.sparkSession.createDataFrame(list(once.values())[:limit], scored.schema)
        surplus *= 4


def nearest(rows: DataFrame, query: list[float], key: str, limit: int, metric: str = "cosine", vector: str = "vector", keep: tuple[str, ...] = (), documents: DataFrame | None = None, add: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, distance, *add) of the ``limit`` nearest rows, of the given documents only and with ``add`` of theirs."""
    asked = F.array(*[F.lit(x) for x in query])
    distance = cosine_distance(F.col(vector), asked) if metric == "cosine" else l2_squared(F.col(vector), asked)
    scored = rows.select(key, *keep, distance.alias("distance")).where("distance IS NOT NULL")
    return best(scored if documents is None else with_documents(scored, documents, add), key, [F.asc("distance")], limit)


def vector_search(rows: DataFrame, query: list[float], key: str, limit: int = 5, min_score: float = 0.0, metric: str = "cosine", keep: tuple[str, ...] = (), documents: DataFrame | None = None, add: tuple[str, ...] = ()) -> DataFrame:
    """The nearest rows with a score of 0 to 1, from ``min_score`` on."""
    found = nearest(rows, query, key, limit, metric, keep=keep, documents=documents, add=add)
    return found.withColumn("score", distance_score(F.col("distance"))).where(F.col("score") >= min_score)


def occurrences(array: Column, word: str) -> Column:
    return F.size(F.filter(array, lambda x: x == word))


def bm25(rows: DataFrame, query: str, key: str, text: str = "content", among: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, bm25) of the rows that hold a query word. Counts are those of all rows; ``among`` filters after.

    The text is read once: its length and the query's words in it become a narrow table, each key once,
    from which both the statistics (one row of partial sums) and the scores come.
    """
    terms = sorted(set(query.lower().split()))
    if not terms:
        raise ValueError("a query has at least one word")
    counted = rows.select(key, *keep, F.coalesce(among if among is not None else F.lit(True), F.lit(False)).alias("_ok"), words(F.col(text)).alias("_w"))
    counts = [occurrences(F.col("_w"), t).alias(f"_t{i}") for i, t in enumerate(terms)]
    counted = cut(counted.select(key, *keep, "_ok", F.size("_w").alias("_n"), *counts).dropDuplicates([key]), "word-counts")
    stats = counted.agg(F.count("*").alias("_rows"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_t{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_rows") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
    hit = counted.where(F.col("_ok") & F.expr(" + ".join(f"_t{i}" for i in range(len(terms))) + " > 0"))
    return hit.crossJoin(F.broadcast(stats)).select(key, *keep, F.round(score, 9).alias("bm25"))  # stats is one row


def text_search(rows: DataFrame, query: str, key: str, limit: int = 5, min_score: float = 0.0, among: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The best rows by BM25 with a score of 0 to 1."""
    top = bm25(rows, query, key, among=among, keep=keep).orderBy(F.desc("bm25"), key).limit(limit)
    return top.withColumn("score", F.when(F.col("bm25") <= 0, 0.0).otherwise(F.col("bm25") / (F.col("bm25") + 1))).where(F.col("score") >= min_score)


def hybrid_search(rows: DataFrame, vector: list[float] | None, query: str, key: str, limit: int = 5, min_score: float = 0.0, among: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Vector and text ranks fused (sum of 1 / (60 + rank), ranks from 0, lists of twice the limit).

    (key, *keep, score); the score isn't rescaled. Without a vector it is the text search, with its score.
    """
    if vector is None:
        return text_search(rows, query, key, limit, min_score, among, keep).drop("bm25")
    ranked = lambda df, order: df.select(key, *keep, F.row_number().over(W.orderBy(*order)).alias("_rank"))  # noqa: E731  # of 2 * limit rows
    near = ranked(nearest(rows.where(among) if among is not None else rows, vector, key, 2 * limit, keep=keep), [F.col("distance"), F.col(key)])
    worded = bm25(rows, query, key, among=among, keep=keep).orderBy(F.desc("bm25"), key).limit(2 * limit)
    both = near.unionByName(ranked(worded, [F.desc("bm25"), F.col(key)]))
    fused = both.groupBy(key).agg(*[F.first(c).alias(c) for c in keep], F.sum(1 / (F.lit(RRF) + F.col("_rank") - 1)).alias("score"))
    return fused.orderBy(F.desc(F.round("score", 12)), key).limit(limit).where(F.col("score") >= min_score)


def term_statistics(rows: DataFrame, text: str = "content") -> DataFrame:
    """(term, rows, occurrences) of every word: the statistics of an inverted index."""
    mark = lambda array, n, k: F.transform(array, lambda t: F.struct(t.alias("term"), F.lit(n).alias("n"), F.lit(k).alias("k")))
    every = rows.select(words(F.col(text)).alias("w")).select(F.explode(F.concat(mark(F.col("w"), 1, 0), mark(F.array_distinct("w"), 0, 1))).alias("x"))
    return every.groupBy("x.term").agg(F.sum("x.k").alias("rows"), F.sum("x.n").alias("occurrences"))


def postings(rows: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(term, key, tf, first_pos, last_pos): the inverted index of the texts, positions from 1."""
    each = rows.select(key, F.posexplode(words(F.col(text))).alias("pos", "term"))
    return each.groupBy("term", key).agg(F.count("*").alias("tf"), (F.min("pos") + 1).alias("first_pos"), (F.max("pos") + 1).alias("last_pos"))
