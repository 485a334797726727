import hashlib
import random

from knowmill.llm.mojibake import Restorer, codecs, explanations, garbled_documents, learn_chains, twin_pairs, undo

CLEAN = ["café notebook is open", "naïve module runs here", "façade of the store", "über die Lösung prüfen wir", "la configuración falló después", "la dépendance vérifiée a été perdue", "decisão válida só até amanhã", "the price € 12 — as “agreed” by all", "日本語の文書 here"]


def garble(text, *chain):
    for codec in chain:
        table = {b: c for c, b in codecs()[codec].items()}
        text = "".join(chr(b) if b < 128 else table[b] for b in text.encode("utf-8"))
    return text


def corpus(rng, n=400):
    docs, truth = [], {}
    for i in range(n):
        parts = [rng.choice(CLEAN) + f" {rng.randrange(99)}" for _ in range(3)]
        text = ". ".join(parts)
        kind = i % 10
        if kind == 1:
            bad = garble(text, rng.choice(["cp1252", "mac_roman", "cp437", "cp1251", "cp1250"]))
        elif kind == 2:
            bad = garble(text, "cp1252", "cp1252")
        elif kind == 3:
            bad = ". ".join([garble(parts[0], "cp1252"), *parts[1:]])
        elif kind == 4:
            text = bad = text + " Readers saw `Ã©` and `√©` in it."
        elif kind == 5:
            text += " Readers saw `Ã©` in it."
            bad = garble(text, "cp1252")
        elif kind == 6 and i < 100:
            bad = text + " r�sum�"
        else:
            bad = text
        docs.append((i, bad))
        if bad != text:
            truth[i] = "" if "�" in bad else hashlib.sha256(text.encode()).hexdigest()
    return docs, truth


def test_restores_exactly(spark):
    docs, truth = corpus(random.Random(6))
    rows = spark.createDataFrame([(*d, "z") for d in docs + [(9000, None), (9001, ""), (9002, "ascii"), (9003, "DECISÃO: a função É ├── l’équipe вкл")]], "doc_id bigint, text string, restored string")
    assert {r["doc_id"]: r["restored_sha"] for r in garbled_documents(rows).collect()} == truth


def test_chains_are_learned_from_twins(spark):
    docs, _ = corpus(random.Random(7))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    chains = {r["chain"] for r in learn_chains(twin_pairs(rows)).collect()}
    assert {"cp1252", "cp1252>cp1252", "mac_roman", "cp437", "cp1251", "cp1250"} <= chains
    assert learn_chains(twin_pairs(rows.where("false"))).count() == 0
    assert garbled_documents(rows.where("false")).count() == 0


def test_undo_and_explain():
    assert undo("rÃ©sumÃ©", codecs()["cp1252"]) == ("résumé", 2)
    assert "cp1252>cp1252" in explanations(garble("é", "cp1252", "cp1252"), "é")
    assert explanations("éè", "é") == []


def test_memo_and_long_text():
    r = Restorer(["cp1252"], None)
    r.MEMO = 3
    text = " ".join(garble(c, "cp1252") for c in "éèêëüö") * 20_000
    assert r.restore(text) == " ".join("éèêëüö") * 20_000


def test_clean_texts_in_another_script_make_no_pairs(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("абвгдежзийклмноп") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert twin_pairs(rows).count() == 0 and garbled_documents(rows).count() == 0
