import random

import numpy as np
import pytest

from knowmill.llm import leakage
from knowmill.llm.leakage import MASKS, RUN, SPAN, leaked_passages, overlaps, seed_hashes, word_codes, words_of

WORDS = [f"w{i}" for i in range(300)]


def sentence(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(docs, tests):
    grams = lambda t: {tuple(w[i : i + RUN]) for w in [words_of(t)] for i in range(len(w) - RUN + 1)}
    items = {i: grams(t) for i, t in tests}
    return {(d, i) for d, t in docs for g in [grams(t)] for i, h in items.items() if g & h}


@pytest.fixture
def corpus():
    rng = random.Random(4)
    tests = [(i, " ".join(sentence(rng, rng.choice([5, 12, 40, 90])))) for i in range(30)] + [(99, None), (98, "")]
    docs = [(1000, None), (1001, ""), (1002, " \n")]
    for d in range(200):
        words = sentence(rng, rng.randrange(0, 120))
        if d % 3 == 0:
            item = words_of(tests[rng.randrange(30)][1])
            a = rng.randrange(len(item))
            part = item[a : a + rng.randrange(8, 40)]
            if d % 6 == 0 and len(part) > 4:
                part[rng.randrange(len(part))] = "other"
            words[5:5] = part
        docs.append((d, ", ".join(words).upper() if d % 2 else " ".join(words)))
    return docs, tests


def frames(spark, docs, tests):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame([(*t, "y") for t in tests], "item_id bigint, text string, doc_id string")


@pytest.mark.parametrize("held", [leakage.HELD, 10])
def test_against_brute_force(spark, corpus, held, monkeypatch):
    monkeypatch.setattr(leakage, "HELD", held)
    docs, tests = corpus
    got = leaked_passages(*frames(spark, docs, tests)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["run"] >= RUN} == brute(docs, tests)
    assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)


def test_masks_survive_substitutions():
    words = word_codes([f"t{i}" for i in range(SPAN)])
    same = seed_hashes(words)
    for p in range(SPAN):
        changed = words.copy()
        changed[p] += np.uint64(1)
        assert [bool(a == b) for a, b in zip(same[:, 0], seed_hashes(changed)[:, 0])] == [m[p] == "0" for m in MASKS]
    assert all(len(m) == SPAN <= RUN for m in MASKS)


def test_reworked_passages(spark):
    rng = random.Random(8)
    item = sentence(rng, 60)
    part = list(item[10:50])
    for i in (7, 18, 30):
        part[i] = "changed"
    r = leaked_passages(*frames(spark, [(1, " ".join(sentence(rng, 30) + part + sentence(rng, 9)))], [(5, " ".join(item))])).collect()[0]
    assert (r["run"], r["words"], r["agreeing"], r["doc_word"], r["item_word"]) == (11, 40, 37, 30, 10)


def test_the_longest_tolerant_overlap():
    # runs of 1, 4 and 10 words on one diagonal with gaps of 1 and 3: the last two make 17 words, 14 of them equal
    b = [f"t{i}" for i in range(19)]
    a = [w if i == 0 or 2 <= i < 6 or 9 <= i else "no" for i, w in enumerate(b)]
    assert overlaps(word_codes(a), word_codes(b)) == (10, 17, 14, 2, 2)


def longest(a, b):
    best = 0
    for d in range(-len(b) + 1, len(a)):
        same = [a[i] == b[i - d] for i in range(max(0, d), min(len(a), len(b) + d))]
        for i in range(len(same)):
            for j in range(i, len(same)):
                if same[i] and same[j] and sum(same[i : j + 1]) * 5 >= 4 * (j + 1 - i):
                    best = max(best, j + 1 - i)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_longest_against_brute_force(seed):
    rng = random.Random(seed)
    b = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))]
    a = [w if rng.random() < 0.8 else rng.choice("abxyz") for w in b[rng.randrange(len(b)) :] + b]
    assert overlaps(word_codes(a), word_codes(b))[1] == longest(a, b)


def test_overlaps_in_blocks(monkeypatch):
    a, b = word_codes(["x"] * 7 + [f"k{i}" for i in range(50)] + ["y"] * 7), word_codes([f"k{i}" for i in range(50)])
    monkeypatch.setattr(leakage, "BLOCK", 16)
    assert overlaps(a, b) == (50, 50, 50, 7, 0)
    assert overlaps(word_codes(["a"] * 3000), word_codes(["a"] * 40))[0] == 40
    assert overlaps(word_codes([]), b) == (0, 0, 0, 0, 0)


def test_empty_tables(spark, corpus):
    docs, tests = frames(spark, *corpus)
    assert leaked_passages(docs.where("false"), tests).count() == 0
    assert leaked_passages(docs, tests.where("false")).count() == 0


def test_one_item_in_a_third_of_all_documents(spark):
    rng = random.Random(11)
    item = " ".join(sentence(rng, 30))
    docs = [(d, item + " " + " ".join(sentence(rng, 20)) if d % 3 == 0 else " ".join(sentence(rng, 50))) for d in range(900)]
    got = leaked_passages(*frames(spark, docs, [(1, item)])).where("run >= 12")
    assert got.count() == 300
