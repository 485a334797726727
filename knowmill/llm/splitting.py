"""Splitting oversized items at natural boundaries, with SQL regex and array functions.

One bounded-quantifier pattern cuts a text into fresh parts. Its alternatives stand in the order of
boundary strength (before a heading, after a blank line, a line, a sentence, a word) and each takes
as much as it can up to ``limit - overlap`` characters; the strong ones first look at the last three
quarters of that window, then at all of it, and plain characters are the fallback. The parts
concatenate to the text exactly. Each piece after the first repeats up to ``overlap`` characters
of the part before, from a word's beginning where there is one, so it stays within the limit.

Characters are Unicode code points. Defined results: null, empty and short texts are no items;
rows that share a key count once; a text without any boundary is cut by length; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LIMIT, OVERLAP = 2000, 200
#: Fixed value: the line that an earlier splitter put before a chunk's body, and the blank line after it.
PREFIX = r"^Document: [^\r\n]* \| Section:[^\r\n]*(?:\r\n|\n|\r|$)(?:[ \t]*(?:\r\n|\n|\r))?"
HEADING = r"(?m)^#{1,6}[ \t]+(\S[^\r\n]*)"
#: Boundary conditions by strength; each holds between two characters.
BOUNDARIES = [
    r"(?<=\n)(?=#{1,6}[ \t])",  # before a heading
    r"(?<=\n[ \t]{0,8}\r?\n)",  # after a blank line
    r"(?<=\n)",  # after a line
    r"(?<=[.!?…][\"'”’)\]]{0,2}[ \t]{1,4})|(?<=[。！？])",  # after a sentence
    r"(?<=\s)",  # after a word
]


def part_pattern(size: int) -> str:
    ways = [rf".{{1,{size}}}\z"]
    ways += [rf".{{{max(1, size // 4)},{size}}}(?:{b})" for b in BOUNDARIES[:4]]
    ways += [rf".{{1,{size}}}(?:{b})" for b in BOUNDARIES]
    return "(?s)(?:" + "|".join([*ways, rf".{{1,{size}}}"]) + ")"


def token_estimate(text: Column) -> Column:
    """Tokens of a text at four characters each, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("int")


def items(kb: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, record_id, version, title, text): documents and chunk bodies, each key once."""
    docs = kb.select(F.lit("kb_documents").alias("src"), F.col("doc_id").alias("record_id"), "version", "title", F.col("content").alias("text"))
    body = F.regexp_replace("content", PREFIX, "")
    bodies = chunks.select(F.lit("doc_chunks").alias("src"), F.col("chunk_id").alias("record_id"), "version", F.col("header").alias("title"), body.alias("text"))
    return docs.unionByName(bodies)


def split_oversized(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(src, record_id, version, title, text) -> one row for each piece of an item over the limit.

    chunk_index counts from 0; start is the fresh part's offset in the text and overlap the number
    of repeated characters before it; header is the piece's first heading, else the last one above
    it, else the title.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    # only the few long items are shuffled for the one row a key
    long = rows.where(F.char_length("text") > limit).groupBy("src", "record_id", "version").agg(F.min(F.struct("text", "title")).alias("x"))
    key = ["src", "record_id", "version"]
    # the pattern runs once an item; a row gets its part and the end of the one before, so the work grows with the text
    parts = long.select(*key, "x.title", F.regexp_extract_all("x.text", F.lit(part_pattern(limit - overlap)), 0).alias("parts"))
    before = F.concat(F.array(F.lit("")), F.transform("parts", lambda p: F.right(p, F.lit(overlap))))
    each = parts.select(*key, "title", F.posexplode(F.arrays_zip(F.col("parts").alias("part"), F.slice(before, 1, F.size("parts")).alias("tail"))).alias("i", "x"))
    each = each.select(*key, "title", "i", "x.part", "x.tail", F.regexp_extract("x.part", HEADING, 1).alias("first"), F.try_element_at(F.regexp_extract_all("x.part", F.lit(HEADING), 1), F.lit(-1)).alias("last"))
    # the grouping above has brought an item's rows together, so the window shuffles nothing
    earlier = W.partitionBy(*key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("part")).over(earlier), F.lit(0)).cast("int")
    above = F.last(F.when(F.trim("last") != "", F.col("last")), ignorenulls=True).over(earlier)
    from_word = F.regexp_extract("tail", r"(?s)^\S*\s+(\S.*)$", 1)
    repeated = F.when((F.col("i") == 0) | (F.lit(overlap) == 0), "").when(from_word != "", from_word).otherwise(F.col("tail"))
    return each.select(
        *key, F.col("i").alias("chunk_index"), F.coalesce(F.trim(F.coalesce(F.when(F.col("first") != "", F.col("first")), above)), "title", F.lit("")).alias("header"),
        start.alias("start"), repeated.alias("_b"), "part",
    ).select(
        *key, "chunk_index", "header", "start", F.char_length("_b").alias("overlap"),
        F.concat("_b", "part").alias("content"), token_estimate(F.concat("_b", "part")).alias("token_count"),
    )


def split_items(pieces: DataFrame) -> DataFrame:
    """The items that were cut, from their first pieces."""
    return pieces.where("chunk_index = 0").select("src", "record_id", "version")
