"""The numbered problems on texts and vectors as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowmill.llm import leakage, mojibake, neighbours, splitting, tokens
from knowmill.sources.tables import table


#: Pairs of this cosine and more are reported.
SIMILAR = 0.92


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.collection(table(spark, folder, "code_chunks"), table(spark, folder, "doc_chunks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's ten most similar, of cosine SIMILAR and more."""
    return neighbours.similar_pairs(neighbours.nearest_vectors(_vectors(spark, folder), min_cos=SIMILAR))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar other vectors of every vector."""
    return neighbours.nearest_vectors(_vectors(spark, folder))


def p3_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of every id whose hash is divisible by 50, searched in every shard."""
    return neighbours.nearest_vectors(_vectors(spark, folder), probes=None, query_share=50, shard=8_000, beam=64)


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all oversized documents and chunk bodies."""
    return splitting.split_oversized(splitting.items(table(spark, folder, "kb_documents"), table(spark, folder, "doc_chunks")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that had to be cut."""
    return splitting.split_items(p4_pieces(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p7_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """All verified overlaps of documents and evaluation items, reworked ones included."""
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items that leaked into them: at least RUN words in common, one after the other."""
    return p7_overlaps(spark, folder).where(F.col("run") >= leakage.RUN).select("doc_id", "item_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with garbled text and the hash of the text as it was."""
    return mojibake.garbled_documents(table(spark, folder, "documents"))


def p8_chains(spark: SparkSession, folder: str) -> DataFrame:
    """The transformations learned from near-twins, with their support."""
    return mojibake.learn_chains(mojibake.twin_pairs(table(spark, folder, "documents")))


QUERIES = {f.__name__: f for f in (p3_found, p3_neighbours, p3_search, p4_pieces, p4_found, p6_ids, p7_overlaps, p7_found, p8_found, p8_chains)}

SQL = {
    "p4_found": r"""
SELECT DISTINCT 'kb_documents' src, doc_id record_id, version FROM kb_documents WHERE length(content) > 2000
UNION ALL
SELECT DISTINCT 'doc_chunks', chunk_id, version FROM doc_chunks
WHERE length(regexp_replace(content, '^Document: [^\r\n]* \| Section:[^\r\n]*(\r\n|\n|\r|$)([ \t]*(\r\n|\n|\r))?', '')) > 2000""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents WHERE text IS NOT NULL),
t AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') run FROM d, unnest(range(1, len(w) - 10)) x(i)),
tr AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') run FROM t, unnest(range(1, len(w) - 10)) x(i))
SELECT DISTINCT doc_id, item_id FROM dr JOIN tr USING (run)""",
}
