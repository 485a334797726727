"""Evaluation texts leaking into training text, by spaced seeds over words.

Each mask picks some of ``SPAN`` consecutive words and ignores the others, so a passage still hits
where an ignored word was substituted; every window of the corpus and of the test items is hashed
under each mask and the hashes are joined. Hit pairs of document and item are verified on their
words: along each diagonal (same shift between both texts) the longest exact run, and the longest
overlap in which at least ``TOLERANCE`` of the words agree.

A mask spans no more words than the run that counts as a leak, so every such run hits.

Scale: the windows of the corpus are hashed where they are read. While the test hashes are few
(``HELD`` at most, counted first) they are broadcast as a sorted array, and only windows whose hash
is among them leave the scan; with more test text every window is shuffled to its hash.
A window repeated in a document is sent once. Only documents with a hit are shuffled with text.

Words are longest runs of Unicode letters and digits, in lower case. Defined results: null, empty
and short texts leak nothing; repeated rows of one id count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowmill.sources.tables import cut

#: Words in common, one after the other, that make a leak.
RUN = 12
#: The masks, of 12 words each; 1 counts, 0 is ignored.
MASKS = ("110110110110", "111010011101", "101101101011")
SPAN = len(MASKS[0])
TOLERANCE = 0.8
#: Test hashes that may be broadcast (8 bytes each).
HELD = 4_000_000
#: Parts to which the documents of a seed are dealt where hashes are shuffled.
SALTS = 16
WORD = r"[\p{L}\p{N}]+"


def words_of(text: str | None) -> list[str]:
    import regex

    return regex.findall(WORD, (text or "").lower())


def word_codes(words: list[str]) -> np.ndarray:
    """A 64-bit code for each word, the same in every process."""
    import xxhash

    held: dict[str, int] = {}
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        code = held.get(w)
        if code is None:
            code = held[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out[i] = code
    return out


def seed_hashes(codes: np.ndarray) -> np.ndarray:
    """One row a mask, one column a window: 64-bit hashes of the words that the mask counts."""
    n = len(codes) - SPAN + 1
    if n <= 0:
        return np.empty((len(MASKS), 0), np.uint64)
    out = np.empty((len(MASKS), n), np.uint64)
    with np.errstate(over="ignore"):
        for k, mask in enumerate(MASKS):
            h = np.full(n, 0x9E3779B97F4A7C15 + k, np.uint64)
            for i, c in enumerate(mask):
                if c == "1":
                    h = (h ^ codes[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(32)
            out[k] = h
    return out


def _seeds(rows: DataFrame, key: str, held=None) -> DataFrame:
    """(key, h): the distinct seed hashes of each text; with ``held`` (a broadcast sorted array) only those in it."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value if held is not None else None
        for batch in batches:
            # all texts of a batch at once; windows that cross from one text into the next don't count
            words = [words_of(t) for t in batch["text"]]
            text = np.repeat(np.arange(len(words)), [len(w) for w in words])
            hashes = seed_hashes(word_codes([w for ws in words for w in ws]))
            inside = np.flatnonzero(text[: hashes.shape[1]] == text[len(text) - hashes.shape[1] :])
            at, h = np.tile(text[inside], len(MASKS)), hashes[:, inside].ravel()
            if known is not None:
                place = np.searchsorted(known, h)
                place[place == len(known)] = 0
                hit = known[place] == h if len(known) else np.zeros(len(h), bool)
                at, h = at[hit], h[hit]
            if len(h):
                yield pd.DataFrame({key: batch[key].to_numpy()[at], "h": h.view(np.int64)}).drop_duplicates()

    return rows.select(key, "text").mapInPandas(scan, f"{key} bigint, h bigint")


#: Words of a document that are verified at once.
BLOCK = 20_000


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """(longest exact run, words of the best tolerant overlap, how many of them agree, where it begins in a, in b).

    A long document goes in blocks that share as many words as b has, so no overlap is cut.
    """
    run, best = 0, (0, 0, 0, 0)
    for at in range(0, max(1, len(a)), BLOCK):
        r, *found = _overlaps(a[at : at + BLOCK + len(b)], b)
        run = max(run, r)
        if found[0] > best[0]:
            best = (found[0], found[1], found[2] + at, found[3])
    return run, *best


def _overlaps(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """Only places where a word of b stands in a are looked at, diagonal by diagonal."""
    order = np.argsort(b, kind="stable")
    sb = b[order]
    lo, hi = np.searchsorted(sb, a, "left"), np.searchsorted(sb, a, "right")
    times = hi - lo
    ia = np.repeat(np.arange(len(a)), times)
    if not len(ia):
        return 0, 0, 0, 0, 0
    step = np.arange(len(ia)) - np.repeat(np.cumsum(times) - times, times)
    ib = order[np.repeat(lo, times) + step]
    sort = np.lexsort((ia, ia - ib))
    ia, ib = ia[sort], ib[sort]
    diagonal = ia - ib
    new = np.r_[True, (np.diff(diagonal) != 0) | (np.diff(ia) != 1)]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.r_[starts, len(ia)])
    d, s, n = diagonal[starts], ia[starts], lengths
    at = int(n.argmax())
    best = (int(n[at]), int(n[at]), int(s[at]), int(s[at] - d[at]))
    first = np.flatnonzero(np.r_[True, np.diff(d) != 0])
    for lo, hi in zip(first, np.r_[first[1:], len(d)]):
        if hi - lo > 1 and s[hi - 1] + n[hi - 1] - s[lo] > best[0]:
            best = max(best, _longest(s[lo:hi], n[lo:hi], int(d[lo])), key=lambda x: x[0])
    return int(lengths.max()), *best


def _longest(s: np.ndarray, n: np.ndarray, d: int) -> tuple[int, int, int, int]:
    """The longest overlap on one diagonal: from the beginning of a run to the end of the same or a later one, at least
    TOLERANCE of the words agreeing. s, n: where the runs begin and how long they are.

    Runs i to j will do if what j adds up to, ``up``, is at least what stands before i, ``low``; so for each j the
    first i whose running minimum of ``low`` is not above it.
    """
    held = np.r_[0, np.cumsum(n)]
    share = round(TOLERANCE * 1000)
    low, up = 1000 * held[:-1] - share * s, 1000 * held[1:] - share * (s + n)
    i = np.searchsorted(-np.minimum.accumulate(low), -up, "left")
    span = s + n - s[np.minimum(i, len(s) - 1)]
    j = int(span.argmax())
    return int(span[j]), int(held[j + 1] - held[i[j]]), int(s[i[j]]), int(s[i[j]] - d)


def _verified(texts: pd.DataFrame) -> pd.DataFrame:
    rows = []
    items: dict[int, np.ndarray] = {}
    codes, last = None, None
    for doc, item, text, item_text in zip(texts["doc_id"], texts["item_id"], texts["text"], texts["item_text"]):
        if doc != last:
            codes, last = word_codes(words_of(text)), doc
        if item not in items:
            items[item] = word_codes(words_of(item_text))
        rows.append((doc, item, *overlaps(codes, items[item])))
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "words", "agreeing", "doc_word", "item_word"])


def leaked_passages(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """(doc_id, text), (item_id, text) -> one row for each pair with a seed in common, verified:
    run (longest exact run of words), words and agreeing (of the longest tolerant overlap), and
    where that begins in the document and in the item, in words."""
    spark = docs.sparkSession
    items = tests.groupBy("item_id").agg(F.min("text").alias("text"))
    known = _seeds(items, "item_id")
    sample = known.select("h").distinct().limit(HELD + 1).toPandas()["h"].to_numpy()  # at most HELD + 1 numbers
    few = len(sample) <= HELD
    held = spark.sparkContext.broadcast(np.sort(sample.view(np.uint64))) if few else None
    corpus = docs.select("doc_id", "text")
    seeds = _seeds(corpus, "doc_id", held)
    if few:
        met = seeds.join(known, "h")
    else:  # a seed that stands in many documents is dealt to SALTS parts
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = seeds.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    # as a table its size is known, so the corpus is shuffled only if the hits are too many to broadcast
    hits = cut(met.select("doc_id", "item_id").distinct(), "leak-hits")
    # copies of a row with one id would otherwise be verified twice
    texts = corpus.join(hits, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "item_id", "text", "item_text")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _verified(batch)

    return texts.mapInPandas(verify, "doc_id bigint, item_id bigint, run int, words int, agreeing int, doc_word int, item_word int").dropDuplicates(["doc_id", "item_id"])
