"""Several values packed in one field: infer each source's separators, then split with position.

Stage 1 (``separator_scores``) runs over every field in SQL. A candidate separator of a source is
scored on (a) consistency: how little the number of pieces varies between the fields that hold it
(1 / (1 + squared coefficient of variation)), and (b) regularity: the share of its pieces that have a
piece type (letters, digits and marks reduced to classes) which the source also uses where nothing has to be
guessed, that is in bracketed lists and in fields without any candidate. A piece that still holds
another candidate, and isn't of such a type, speaks neither for nor against.
Candidates of at least ``ACCEPT`` are the source's separators. Where a source holds one of the plain marks in fewer
than ``SMALL`` fields or pieces, it is too small to score that mark and the mark is trusted.
Stage 2 (``split_packed``) splits every field by its source's separators and explodes the values with
their place: fields without quotes and brackets in SQL, the others in a small parser that minds quotes,
brackets and escapes.

Defined results: null, blank and empty-list fields give no row; repeated values keep their places;
a list whose closing bracket, brace or quote is missing gives the values that are there; rows that
share a key count once; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that may separate values. Space / : . - _ & never do.
CANDIDATES = [",", ";", "|", "\n", "\t", "\r", "\uff0c", "\u3001", "\uff1b", "\u00b7", "\u2022", "\u00a6", "\uff5c", "\x1f"]
#: Trusted where a source holds them too rarely to score: the plain list notations.
PLAIN = [",", ";", "|", "\n", "\t", "\r"]
ACCEPT, SMALL = 0.5, 30
#: Fixed value: outer white space of a value, the same set as around keys.
WHITE = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Stands for a quoted part while separators are scored.
QUOTED = "\ue000"
VALUES = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("val", T.StringType())]))


def stripped(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE))


def piece_type(col: Column) -> Column:
    """The piece with runs of letters and digits reduced to one mark each; quotes and outer space dropped."""
    bare = F.regexp_replace(stripped(col), "^[\"']|[\"']$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\p{L}+", "a"), r"(\d|a)[\da]*", "w")


def separator_scores(fields: DataFrame) -> DataFrame:
    """(src, fld, value) -> (src, fld, sep, n, decided, consistency, regularity, score, accepted).

    Pieces are counted by type before they are shuffled, and so are the types they are held against.
    """
    marks = "[" + "".join(re.escape(c) for c in CANDIDATES) + "]"
    base = fields.select("src", "fld", stripped(F.col("value")).alias("v")).where("v != ''")
    # quoted parts don't speak about separators
    base = base.select("src", "fld", "v", F.col("v").rlike(r"""^["']?\s*[\[{]""").alias("b"), F.regexp_replace("v", r"""(?<![^\s,;|])("[^"]*"|'[^']*')""", QUOTED).alias("u"))
    inner = F.split(F.regexp_replace("v", r"""^[^\[]*\[|[\]}"']+$""", ""), r"""["'\\]+\s*,\s*["'\\]+""")
    sure = base.select("src", "fld", F.explode(F.when(F.col("b"), inner).when(~F.col("u").rlike(marks), F.array("v"))).alias("x"))
    known = sure.groupBy("src", "fld", piece_type(F.col("x")).alias("t")).agg(F.lit(True).alias("known"))
    # of each field and candidate in it: its pieces' types, and once (without a type) their number
    kept = lambda c: F.filter(F.split("u", re.escape(c)), lambda x: stripped(x) != "")
    ways = F.array(*[F.when(F.contains(F.col("u"), F.lit(c)), F.struct(F.lit(c).alias("sep"), kept(c).alias("p"))) for c in CANDIDATES])
    split = base.where(~F.col("b")).select("src", "fld", F.explode(F.array_compact(ways)).alias("w"))
    entry = lambda t, k: F.struct(t.alias("t"), k.cast("double").alias("k"))
    none = F.lit(None)
    each = split.select("src", "fld", "w.sep", F.explode(F.concat(F.transform("w.p", lambda x: entry(piece_type(x), none)), F.array(entry(none.cast("string"), F.size("w.p"))))).alias("e"))
    counted = each.groupBy("src", "fld", "sep", "e.t").agg(F.count("*").alias("n"), F.sum("e.k").alias("k"), F.sum(F.col("e.k") * F.col("e.k")).alias("k2"))
    judged = counted.join(known, ["src", "fld", "t"], "left").withColumn("good", (F.col("t") == QUOTED) | F.coalesce("known", F.lit(False)))
    is_piece = F.col("t").isNotNull()
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    score = judged.groupBy("src", "fld", "sep").agg(
        of(~is_piece).alias("n"), of(is_piece & (F.col("good") | ~F.col("t").rlike(marks))).alias("decided"), of(is_piece & F.col("good")).alias("good"),
        F.sum("k").alias("k"), F.sum("k2").alias("k2"),
    )
    score = score.withColumn("consistency", F.when(F.col("k2") > 0, F.col("k") * F.col("k") / (F.col("n") * F.col("k2"))).otherwise(0.0))
    score = score.withColumn("regularity", F.when(F.col("decided") > 0, F.col("good") / F.col("decided")).otherwise(0.0))
    score = score.withColumn("score", F.col("consistency") * F.col("regularity"))
    rare = F.col("sep").isin(PLAIN) & (F.least("n", "decided") < SMALL)
    return score.select("src", "fld", "sep", "n", "decided", "consistency", "regularity", "score", ((F.col("score") >= ACCEPT) | rare).alias("accepted"))


def _unescape(text: str) -> str:
    """One layer of backslash escapes off; malformed ones stay as they are."""
    simple = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    return re.sub(
        r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)",
        lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else simple.get(m[1], m[1]),
        text,
        flags=re.S,
    ).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_ENDS = re.compile(r"\s*(,|\]|\}|$)")


def _bracketed(text: str) -> list[str]:
    """The values behind an opening bracket, up to its closing one or the end of a damaged list."""
    out, i, n = [], 0, len(text)
    while i < n and text[i] != "]":
        if text[i] in "\"'":
            mark, j = text[i], i + 1
            while j < n and not (text[j] == mark and _ENDS.match(text, j + 1)):
                j += 2 if text[j] == "\\" else 1
            out.append(_unescape(text[i + 1 : min(j, n)]))
            i = j + 1
        elif text[i].isspace() or text[i] == ",":
            i += 1
        else:
            j = i
            while j < n and text[j] not in ",]":
                j += 1
            out.append(text[i:j])
            i = j
    return out


def _delimited(text: str, seps: str) -> list[str]:
    out, i, n = [], 0, len(text)
    close = re.compile(rf"\s*([{re.escape(seps)}]|$)") if seps else re.compile(r"\s*$")
    while i < n:
        if text[i] in seps or text[i].isspace():
            i += 1
            continue
        if text[i] in "\"'":
            mark, j, held = text[i], i + 1, []
            while j < n:
                if text[j] == mark:
                    if text[j + 1 : j + 2] == mark and not (j == i + 1 and close.match(text, j + 2)):
                        held.append(mark)
                        j += 2
                        continue
                    if close.match(text, j + 1):
                        break
                held.append(text[j])
                j += 1
            if j < n:
                out.append("".join(held))
                i = j + 1
                continue
        j = i
        while j < n and text[j] not in seps:
            j += 1
        out.append(text[i:j])
        i = j
    return out


def parse_field(text: str | None, seps: str) -> list[str]:
    """The values of one field, in order, without outer white space; no blank ones."""
    text = (text or "").strip(WHITE)
    if m := re.match(r"""(["'])\s*[\[{]""", text):  # a list wrapped in a string
        try:
            inner = json.loads(text)
        except ValueError:
            inner = text[1:-1] if text[-1] == m[1] else text[1:]
            if re.match(r"""\s*[\[{]\s*\\["']""", inner):
                inner = _unescape(inner)
        if isinstance(inner, str) and inner.strip()[:1] in ("[", "{"):
            return parse_field(inner, seps)
    if text.startswith("{"):
        held = re.search(r"""["']?paths["']?\s*:\s*\[?""", text)
        values = _bracketed(text[held.end() :]) if held else []
    elif text.startswith("["):
        values = _bracketed(text[1:])
    else:
        values = _delimited(text, seps)
    return [v for x in values if (v := x.strip(WHITE))]


def split_packed(fields: DataFrame) -> DataFrame:
    """(src, record_id, version, fld, value) -> one row for each value, with ``pos`` from 1 and ``val``."""
    separators = separator_scores(fields).where("accepted").groupBy("src", "fld").agg(F.array_join(F.sort_array(F.collect_set("sep")), "").alias("seps"))
    # one row a source and field
    rows = fields.where(stripped(F.col("value")) != "").join(F.broadcast(separators), ["src", "fld"], "left").withColumn("seps", F.coalesce("seps", F.lit("")))
    plain = ~stripped(F.col("value")).rlike(r"""["'\x1e]|^[\[{]""")
    split = F.split(F.call_function("translate", F.col("value"), F.col("seps"), F.repeat(F.lit("\x1e"), F.length("seps"))), "\x1e")
    values = F.filter(F.transform(split, stripped), lambda x: x != "")
    key = ["src", "record_id", "version", "fld"]
    simple = rows.where(plain).select(*key, F.posexplode(values).alias("pos", "val")).select(*key, (F.col("pos") + 1).alias("pos"), "val")

    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, seps in batches:
            yield pd.Series([[{"pos": k, "val": x} for k, x in enumerate(parse_field(v, s), 1)] for v, s in zip(texts, seps)])

    quoted = rows.where(~plain).select(*key, F.explode(F.pandas_udf(parse, VALUES)("value", "seps")).alias("x")).select(*key, "x.pos", "x.val")
    return simple.unionByName(quoted)


def packed_fields(kb: DataFrame, code: DataFrame) -> DataFrame:
    """The packed fields of both tables, each key once."""
    tags = kb.select(F.lit("kb_documents").alias("src"), F.col("doc_id").alias("record_id"), "version", F.lit("tags").alias("fld"), F.col("tags").alias("value"))
    listed = code.select(
        F.lit("code_chunks").alias("src"), F.col("chunk_id").alias("record_id"), F.lit(0).alias("version"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("value")) for c in ("imports", "exports")])).alias("x"),
    ).select("src", "record_id", "version", "x.fld", "x.value")
    once = lambda df: df.where(stripped(F.col("value")) != "").groupBy("src", "record_id", "version", "fld").agg(F.min("value").alias("value"))
    return once(tags).unionByName(once(listed))
