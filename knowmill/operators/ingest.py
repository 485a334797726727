"""Chunkers, manifests, change classification and versions for ingestion.

Lengths are in code points. A null text is an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowmill.functions.text import first_heading, line_count, token_estimate
from knowmill.operators.code import TEST_NAME
from knowmill.operators.packed import WHITE

SIZE, OVERLAP = 2000, 200
PART, PART_OVERLAP = 200, 20


def fixed_chunks(rows: DataFrame, key: list[str], text: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` characters, each beginning ``size - overlap`` after the one before; an empty text is one chunk."""
    step = size - overlap
    body = F.coalesce(F.col(text), F.lit(""))
    last = F.greatest(F.lit(0), F.ceil((F.char_length(body) - size) / step)).cast("int")
    cut = rows.select(*key, body.alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return cut.select(*key, "chunk_index", F.substring("_t", F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


def paragraph_chunks(rows: DataFrame, key: list[str], text: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Paragraphs packed up to ``size`` characters; a new chunk repeats the last ``overlap`` of the one before.
    A longer paragraph stays whole; a blank text has no chunk."""
    start = F.struct(F.lit("").alias("now"), F.expr("cast(array() as array<string>)").alias("out"))

    def pack(acc, p):
        full = (F.char_length(acc["now"]) + F.char_length(p) + 2 > size) & (acc["now"] != "")
        carried = F.concat(F.right(acc["now"], F.lit(overlap)), F.lit("\n\n"), p)
        return F.when(full, F.struct(carried.alias("now"), F.concat(acc["out"], F.array(F.trim(acc["now"]))).alias("out"))).otherwise(
            F.struct(F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p)).alias("now"), acc["out"].alias("out"))
        )

    done = lambda acc: F.when(F.trim(acc["now"]) != "", F.concat(acc["out"], F.array(F.trim(acc["now"])))).otherwise(acc["out"])
    chunks = F.aggregate(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\n+"), start, pack, done)
    return rows.select(*key, F.posexplode(chunks).alias("chunk_index", "content"))


#: Which chunker a category of documents goes through; others go through the first.
STRATEGIES = {
    "semantic_section": ["plan", "task_spec", "requirement", "technical_context", "architecture_decision", "design_pattern", "research"],
    "paragraph": ["learning", "change_record", "glossary"],
    "fixed_size": ["code_pattern", "dependency"],
}
#: What Markdown is cut before, the strongest first; in the end single characters.
MARKS = ["\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n\n", "\n\n***\n\n", "\n\n---\n\n", "\n\n___\n\n", "\n\n", "\n", " "]


def strategy(category: Column) -> Column:
    named = F.create_map(*[F.lit(x) for name, categories in STRATEGIES.items() for c in categories for x in (c, name)])
    return F.coalesce(named[category], F.lit("semantic_section"))


def _packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to ``size``, the next chunk beginning with the last ones of up to ``overlap``."""
    out, begin, total = [], 0, 0
    for i, part in enumerate(parts):
        if total + len(part) > size and begin < i:
            out.append("".join(parts[begin:i]))
            while begin < i and (total > overlap or total + len(part) > size):
                total -= len(parts[begin])
                begin += 1
        total += len(part)
    return [*out, "".join(parts[begin:])]


def sections(text: str, size: int = SIZE, overlap: int = OVERLAP, marks: list[str] = MARKS) -> list[str]:
    """Cut before the first mark that occurs; parts that are still too long before the next ones; short ones packed."""
    at = next((k for k, m in enumerate(marks) if m in text), None)
    if at is None:
        return [c for k in range(0, max(1, len(text) - overlap), size - overlap) if (c := text[k : k + size].strip(WHITE))]
    out: list[str] = []
    short: list[str] = []
    for part in [p for p in re.split(f"(?={re.escape(marks[at])})", text) if p]:
        if len(part) < size:
            short.append(part)
            continue
        out += _packed(short, size, overlap) + sections(part, size, overlap, marks[at + 1 :])
        short = []
    return [c for x in out + _packed(short, size, overlap) if (c := x.strip(WHITE))]


def section_chunks(rows: DataFrame, key: list[str], text: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Markdown cut at headings, rules, paragraphs, lines and words, in this order; a blank text is one chunk."""

    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sections(t, size, overlap) or [t] for t in batch])

    body = F.coalesce(F.col(text), F.lit(""))
    # a text that fits needs no cutting
    whole = F.array(F.when(F.btrim(body, F.lit(WHITE)) != "", F.btrim(body, F.lit(WHITE))).otherwise(body))
    short = rows.where(F.char_length(body) < size).select(*key, F.posexplode(whole).alias("chunk_index", "content"))
    long = rows.where(F.char_length(body) >= size).select(*key, F.posexplode(F.pandas_udf(cut, "array<string>")(body)).alias("chunk_index", "content"))
    return short.unionByName(long)


def document_chunks(rows: DataFrame, key: list[str], category: str = "category", text: str = "content") -> DataFrame:
    """Every document in the chunks of its category's strategy; one without any has its text as the only one."""
    of = lambda name: rows.where(strategy(F.col(category)) == name)
    blank = of("paragraph").where(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").select(*key, F.lit(0).alias("chunk_index"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    parts = [section_chunks(of("semantic_section"), key, text), paragraph_chunks(of("paragraph"), key, text), fixed_chunks(of("fixed_size"), key, text), blank]
    return reduce(DataFrame.unionByName, parts)


def decorated(chunks: DataFrame, title: str = "title", tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """Adds the header (first heading, else the title), the prefix line before the content, and token_count, by an
    estimate or whatever counts the tokens of a column of texts."""
    header = F.when(first_heading(F.col("content")) != "", first_heading(F.col("content"))).otherwise(F.col(title))
    full = F.concat(F.lit("Document: "), F.col(title), F.lit(" | Section: "), header, F.lit("\n\n"), F.col("content"))
    return chunks.select("*", header.alias("header"), full.alias("full_text"), tokens(full).alias("token_count"))


def line_parts(rows: DataFrame, key: list[str], text: str = "content", size: int = PART, overlap: int = PART_OVERLAP) -> DataFrame:
    """Texts of more than ``size`` lines in parts of ``size`` lines, each repeating ``overlap`` lines: (key, part, parts, first_line, content)."""
    step = size - overlap
    lines = rows.select(*key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_l"))
    n = F.size("_l")
    parts = F.when(n > size, F.ceil((n - overlap) / step)).otherwise(1).cast("int")
    each = lines.select(*key, "_l", parts.alias("parts"), F.explode(F.sequence(F.lit(1), parts)).alias("part"))
    first = (F.col("part") - 1) * step
    return each.select(*key, "part", "parts", (first + 1).alias("first_line"), F.array_join(F.slice("_l", first + 1, F.when(F.col("parts") == 1, F.greatest(F.size("_l"), F.lit(1))).otherwise(size)), "\n").alias("content"))


def symbol_parts(found: DataFrame, key: str) -> DataFrame:
    """Symbols, those of more than ``PART`` lines in parts, each with a line before it that says where it stands:
    (key, path, symbol_type, symbol_name, scope_chain, part, parts, first_line, last_line, content)."""
    of = [key, "path", "symbol_type", "symbol_name", "scope_chain", "start_line"]
    parts = line_parts(found.select(*of, F.col("content").alias("_body")), of, "_body")
    first = F.col("start_line") + F.col("first_line") - 1
    name = F.when(F.col("parts") > 1, F.concat("symbol_name", F.lit(" (part "), "part", F.lit("/"), "parts", F.lit(")"))).otherwise(F.col("symbol_name"))
    header = F.concat(F.lit("File: "), "path", F.lit(" | "), "symbol_type", F.lit(": "), "scope_chain", F.lit("\n\n"))
    return parts.select(
        key, "path", "symbol_type", name.alias("symbol_name"), "scope_chain", "part", "parts", first.cast("int").alias("first_line"),
        (first + line_count(F.col("content")) - 1).cast("int").alias("last_line"), F.concat(header, "content").alias("content"),
    )


def manifest(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, hash, lines, is_test, extension): what the next run compares files with."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return files.select(
        F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"), line_count(F.coalesce(F.col(text), F.lit(""))).alias("lines"),
        name.rlike(TEST_NAME).alias("is_test"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("extension"),
    )


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two (path, hash) manifests: new, changed, same or deleted; a null hash counts as changed."""
    both = old.select("path", F.col("hash").alias("h0"), F.lit(True).alias("was")).join(new.select("path", F.col("hash").alias("h1"), F.lit(True).alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("h0") == F.col("h1"), "same").otherwise("changed")
    return both.select("path", change.alias("change"))


def next_versions(stored: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Incoming rows with the version after the greatest stored one, or 1."""
    last = stored.groupBy(key).agg(F.max("version").alias("_v"))
    return incoming.drop("version").join(last, key, "left").withColumn("version", F.coalesce(F.col("_v") + 1, F.lit(1))).drop("_v")
