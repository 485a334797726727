import random

import pytest

from knowmill.llm.splitting import items, split_items, split_oversized

SCHEMA = "src string, record_id string, version int, title string, text string, start int, content string"


def pieces(spark, texts, limit=100, overlap=20):
    rows = spark.createDataFrame([("s", f"r{i}", 1, "T", t, 7, "x") for i, t in enumerate(texts)], SCHEMA)
    out = {}
    for r in split_oversized(rows, limit, overlap).orderBy("record_id", "chunk_index").collect():
        out.setdefault(r["record_id"], []).append(r)
    return out


def whole(rows):
    return "".join(r["content"][r["overlap"] :] for r in rows)


def test_text_comes_back_within_the_limit(spark):
    rng = random.Random(3)
    alphabet = ["word ", "line\n", "\n\n", "# Head\n", "End. ", "éß", "\U0001f680", "日本。", "x" * 30, "\r\n", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(40)] + ["x" * 5000, "\n" * 500, " " * 300, "\U0001f680" * 101]
    got = pieces(spark, texts)
    for i, t in enumerate(texts):
        rows = got.get(f"r{i}", [])
        assert bool(rows) == (len(t) > 100)
        if rows:
            assert whole(rows) == t
            assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
            assert all(len(r["content"]) <= 100 and r["token_count"] == -(-len(r["content"]) // 4) for r in rows)
            for a, b in zip(rows, rows[1:]):
                assert 0 < b["overlap"] <= 20 and a["content"].endswith(b["content"][: b["overlap"]])
                assert t[b["start"] :].startswith(b["content"][b["overlap"] :])


def test_strongest_boundary_wins(spark):
    text = "a" * 40 + ". b\n\n" + "c" * 10 + "\n# Two\n" + "d" * 90
    rows = pieces(spark, [text])["r0"]
    assert rows[0]["content"].endswith("c\n") and rows[1]["content"][rows[1]["overlap"] :].startswith("# Two\n")
    assert [r["header"] for r in rows[:2]] == ["T", "Two"]
    lines = "\n".join("l" * 15 for _ in range(20))
    assert all(r["content"].endswith("\n") for r in pieces(spark, [lines])["r0"][:-1])
    sentences = "Some words here. " * 20
    assert all(r["content"].endswith(". ") for r in pieces(spark, [sentences])["r0"][:-1])


def test_headers_stand_until_the_next(spark):
    text = "# One\n" + "a b. " * 60 + "\n## Two\n" + "c d. " * 60
    rows = pieces(spark, [text])["r0"]
    place = text.index("## Two")
    assert {r["header"] for r in rows if r["start"] < place} == {"One"} and {r["header"] for r in rows if r["start"] >= place} == {"Two"}


def test_a_very_long_item(spark):
    text = "Some words of a line. " * 200_000
    rows = spark.createDataFrame([("s", "r", 1, "T", text, 7, "x")], SCHEMA)
    got = split_oversized(rows)
    sums = got.selectExpr("count(*) n", "sum(char_length(content) - overlap) whole", "max(start) last", "max(char_length(content)) longest").first()
    assert sums["whole"] == len(text) and sums["longest"] <= 2000 and sums["last"] < len(text) and sums["n"] < len(text) / 1500


def test_items_and_prefix(spark):
    kb = spark.createDataFrame([("d", 1, "t", "x" * 2001, "e"), ("d", 1, "t", "x" * 2001, "e"), ("e", 1, "t", "x" * 2000, "e"), ("f", 1, "t", None, "e"), ("g", 2, None, "\U0001f680" * 2001, "e")], "doc_id string, version int, title string, content string, record_id string")
    prefix = "Document: a | Section: b\n\n"
    chunks = spark.createDataFrame([("c1", 1, "h", prefix + "y" * 2000), ("c2", 1, "h", prefix + "y" * 2001), ("c3", 1, "", "y" * 2001), ("c4", 1, None, "")], "chunk_id string, version int, header string, content string")
    got = split_oversized(items(kb, chunks))
    assert sorted(map(tuple, split_items(got).collect())) == [("doc_chunks", "c2", 1), ("doc_chunks", "c3", 1), ("kb_documents", "d", 1), ("kb_documents", "g", 2)]
    assert got.where("record_id = 'c2'").first()["header"] == "h"
    assert split_oversized(items(kb.where("false"), chunks.where("false"))).count() == 0


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        pieces(spark, ["x"], 10, 10)
