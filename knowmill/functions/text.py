"""Column builders on text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)")), F.array().cast("array<string>"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("int")


def summary(text: Column, size: int = 400) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def has_tag(tags: Column, tag: str) -> Column:
    """Whether a pipe-delimited set holds just this tag."""
    return tags.contains(f"|{tag}|")


def has_tag_loosely(tags: Column, tag: str) -> Column:
    return tags.contains(f"|{tag}") | tags.contains(f"{tag}|") | (tags == tag)


def glob_to_like(glob: str) -> str:
    """A path pattern as a LIKE pattern: * and ** are any characters, slashes too, ? is one; LIKE's own marks are escaped."""
    escaped = re.sub(r"([%_])", r"\\\1", glob)
    return re.sub(r"\*\*|\*", "%", escaped).replace("?", "_")


def snippet(text: Column, query: str, tokens: int = 150) -> Column:
    """The text around the first query word, in the query's order, that occurs in it; whole if short."""
    size = 4 * tokens
    places = [F.instr(F.lower(text), w) for w in query.lower().split()]
    first = F.lit(1)
    for place in reversed(places):
        first = F.when(place > 0, place).otherwise(first)
    start = F.greatest(F.lit(0), first - 1 - size // 2)
    cut = F.rtrim(F.substring(text, start + 1, F.lit(size)))
    before, after = F.when(start > 0, "...").otherwise(""), F.when(start + size < F.char_length(text), "...").otherwise("")
    return F.when(token_estimate(text) <= tokens, text).otherwise(F.concat(before, cut, after))


def first_heading(text: Column) -> Column:
    """The first Markdown heading without outer white space, or ''."""
    return F.trim(F.regexp_extract(text, r"(?m)^#{1,6}\s+([^\r\n]+)", 1))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))
