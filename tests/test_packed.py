import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from knowmill.operators.packed import PLAIN, SMALL, parse_field, packed_fields, separator_scores, split_packed

SEPS = "".join(PLAIN) + "\uff0c\u3001\u00b7"
SCHEMA = "src string, record_id string, version int, fld string, value string"


@pytest.mark.parametrize(
    "text, values",
    [
        (None, []), ("", []), ("  ", []), ("[]", []), ("[ ]", []), ("||", []), (" | | ", []), ('""', []),
        ("|a|b c|", ["a", "b c"]), ("a, b ,a", ["a", "b", "a"]), ("a;b\tc\nd\r\ne", list("abcde")), ("a\uff0cb\u3001c \u00b7 d", list("abcd")),
        (",a,,b; ;c | | d", list("abcd")), ("o'clock-jobs|what's-new", ["o'clock-jobs", "what's-new"]),
        ('"a, b";c', ["a, b", "c"]), ('"the ""hot"" path, again"|x', ['the "hot" path, again', "x"]), ("'read|write';'x'", ["read|write", "x"]),
        ('["a, b", "c"]', ["a, b", "c"]), ('["a" , "b"', ["a", "b"]), ('["a", "b', ["a", "b"]), ("['x', \"what's-new\"]", ["x", "what's-new"]),
        ("['the \"hot\" path, again', 'y']", ['the "hot" path, again', "y"]),
        ('"[\\"gr\\\\u00f6\\\\u00dfe\\", \\"b\\"]"', ["gr\u00f6\u00dfe", "b"]), ("\"['a', 'b']\"", ["a", "b"]), ('"[\\"./\\\\\\"x\\\\\\".css\\"]"', ['./"x".css']),
        ('{"paths": ["a\\/b", "c::{d, E}"], "is_test": true}', ["a/b", "c::{d, E}"]), ('{"is_test": true, "paths": ["a"]}', ["a"]), ('{"paths": ["a", "b"', ["a", "b"]), ('{"is_test": true}', []),
        ('"open', ['"open']),
    ],
)
def test_notations(text, values):
    assert parse_field(text, SEPS) == values


WORDS = st.lists(st.text("abcXYZ019 _-./:&", min_size=1, max_size=9).map(str.strip).filter(bool), max_size=7)


@given(WORDS, st.sampled_from([",", ";", "|", "\t", "\n", " , ", "\uff0c"]))
def test_joined_values_come_back(values, sep):
    assert parse_field(sep.join(values), SEPS) == values


@given(st.lists(st.text("ab,;|\"'\\\u00e9 ", min_size=1, max_size=8).map(str.strip).filter(bool), max_size=6))
def test_json_comes_back(values):
    import json

    assert parse_field(json.dumps(values), SEPS) == values
    assert parse_field(json.dumps(json.dumps(values)), SEPS) == values


def scored(fields):
    return {r["sep"]: r for r in separator_scores(fields).collect()}


def test_unusual_separators_are_learned_and_others_not(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = [("s", f"r{i}", 0, "f", f"{rng.choice(words)} \u00b7 {rng.choice(words)}") for i in range(20)]
    rows += [("s", f"q{i}", 0, "f", f'["{rng.choice(words)}"]') for i in range(20)] + [("s", "z", 0, "f", "a@b")]
    fields = spark.createDataFrame(rows, SCHEMA)
    assert {s: (r["score"], r["accepted"]) for s, r in scored(fields).items()} == {"\u00b7": (1.0, True)}
    got = {(r["record_id"], r["pos"]): r["val"] for r in split_packed(fields).collect()}
    assert all(got[f"r{i}", 1] in words and got[f"r{i}", 2] in words for i in range(20)) and got["z", 1] == "a@b"


def test_a_plain_mark_inside_values_is_rejected_by_its_score(spark):
    rng = random.Random(2)
    names = [f"{a}, {b}" for a in ("Smith", "Roe", "Doe", "Poe") for b in ("John", "Jane", "Ann")]
    lists = [[rng.choice(names) for _ in range(rng.randrange(1, 5))] for _ in range(400)]
    rows = [("s", f"r{i}", 0, "f", "; ".join(v)) for i, v in enumerate(lists[:200])] + [("s", f"r{i}", 0, "f", str(v).replace("'", '"')) for i, v in enumerate(lists) if i >= 200]
    fields = spark.createDataFrame(rows, SCHEMA)
    marks = scored(fields)
    assert marks[";"]["accepted"] and not marks[","]["accepted"] and marks[","]["decided"] >= SMALL
    got = {}
    for r in split_packed(fields).orderBy("record_id", "pos").collect():
        got.setdefault(r["record_id"], []).append(r["val"])
    assert got == {f"r{i}": v for i, v in enumerate(lists)}
    # another source is judged by itself, and one too small to score trusts the plain marks
    other = spark.createDataFrame([("t", f"r{i}", 0, "f", f"a{i}, b{i}") for i in range(5)], SCHEMA)
    assert scored(fields.unionByName(other))[","]["accepted"] != marks[","]["accepted"] or scored(other)[","]["accepted"]
    assert sorted(r["val"] for r in split_packed(fields.unionByName(other)).where("src = 't'").collect()) == sorted(x for i in range(5) for x in (f"a{i}", f"b{i}"))


def test_uneven_piece_counts_lower_the_consistency(spark):
    even = spark.createDataFrame([("s", f"r{i}", 0, "f", "a|b|c") for i in range(40)], SCHEMA)
    uneven = spark.createDataFrame([("s", f"r{i}", 0, "f", "|".join("a" * (40 if i == 0 else 1)) + "|") for i in range(40)], SCHEMA)
    assert scored(even)["|"]["consistency"] == 1.0 and scored(uneven)["|"]["consistency"] < 0.1


def test_fields_split_in_sql_as_the_parser_would(spark):
    texts = [" a ;b\u00a0, \u3000c|", "o'k, x", "a]b;c", "x\\,y", "\ufeffa\u200b;b", "{a;b", ";;", "a\x1eb;c", "p[0], q[1]"]
    fields = spark.createDataFrame([("s", f"r{i}", 0, "f", t) for i, t in enumerate(texts)], SCHEMA)
    got = {}
    for r in split_packed(fields).orderBy("record_id", "pos").collect():
        got.setdefault(r["record_id"], []).append(r["val"])
    assert got == {f"r{i}": v for i, t in enumerate(texts) if (v := parse_field(t, ",;|"))}


def test_positions_against_plain_parsing(spark, sf):
    kb, code = spark.read.parquet(f"{sf}/kb_documents.parquet"), spark.read.parquet(f"{sf}/code_chunks.parquet")
    fields = packed_fields(kb, code)
    expected = sorted((r["src"], r["record_id"], r["version"], r["fld"], k, v) for r in fields.collect() for k, v in enumerate(parse_field(r["value"], SEPS), 1))
    assert sorted(map(tuple, split_packed(fields).collect())) == expected


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    kb = spark.createDataFrame([("d", 1, "a|b", "x", 5), ("d", 1, "a|b", "x", 5), ("e", 1, None, "x", 5), (None, 1, "c", "x", 5)], "doc_id string, version int, tags string, pos string, val int")
    code = spark.createDataFrame([], "chunk_id string, imports string, exports string")
    got = sorted(map(tuple, split_packed(packed_fields(kb, code)).collect()), key=str)
    assert got == sorted([("kb_documents", "d", 1, "tags", 1, "a"), ("kb_documents", "d", 1, "tags", 2, "b"), ("kb_documents", None, 1, "tags", 1, "c")], key=str)
    assert split_packed(packed_fields(kb.where("false"), code)).count() == 0


def test_a_very_long_field(spark):
    n = 50_000
    rows = spark.createDataFrame([("s", "r", 0, "f", "|".join(f"v{i}" for i in range(n)))], SCHEMA)
    got = split_packed(rows)
    assert got.count() == n and got.where("pos = 50000").first()["val"] == "v49999"
