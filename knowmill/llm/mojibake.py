"""Garbled text from wrong character encoding: learn the transformations from near-twins, undo them.

1. Twins. Every word with non-ASCII characters is keyed by what is left when they are stripped (their
   places kept), alone and with its stripped neighbours. Counts of (key, stripped runs) are
   pre-aggregated; of the runs under one key the shortest is the clean twin, longer ones are
   suspects. So pairs grow with the distinct variants of a key, not with its rows.
2. Alignment. Suspect and clean runs stand between the same ASCII characters. A transformation that
   turns the clean characters into the garbled ones is sought: UTF-8 bytes read as a single-byte
   codec, up to ``DEPTH`` times. A pair speaks for its best supported explanation only; chains of
   codecs with ``SUPPORT`` such pairs are learned.
3. Alphabet. Non-ASCII characters of the texts that show none of the learned garblings, found in two
   passes; undoing one must lead to these.
4. Application to all records: each run of non-ASCII characters is undone by the learned chain that
   explains it whole, the deepest first and the record's most frequent one among equals. Between
   back-ticks the deepest level is left, being an example of garbled text there.

A text with U+FFFD outside back-ticks has lost characters for good.
Broadcast are the chains (at most the codecs to the power of DEPTH, in fact a few) and the alphabet
(at most the code points of Unicode).

Defined results: null, empty and ASCII texts are no cases; a corpus without twins teaches nothing
and only lost texts are found; repeated rows and extra columns pass through unused.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knowmill.sources.tables import cut

DEPTH = 3
SUPPORT = 2
#: ASCII letters that a twin's key must hold.
LETTERS = 3
#: Texts in which a character must stand to belong to the alphabet.
SEEN = 2
RUN = re.compile(r"[^\x00-\x7f]+")
CODE = re.compile(r"`[^`\n]*`")
_NON_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=1)
def codecs() -> dict[str, dict[str, int]]:
    """Of each single-byte codec that keeps ASCII: the byte of each character from 0x80 on.
    Bytes that a codec leaves undefined stand for the control characters of the same number."""
    from encodings.aliases import aliases

    out: dict[str, dict[str, int]] = {}
    for name in sorted(set(aliases.values())):
        try:
            if bytes(range(128)).decode(name) != "".join(map(chr, range(128))):
                continue
            table = {}
            for b in range(128, 256):
                if len(c := bytes([b]).decode(name, "ignore")) == 1:
                    table[c] = b
        except (LookupError, UnicodeError, ValueError):
            continue
        if len(table) < 64 or any(ord(c) < 128 for c in table):
            continue
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
        if table not in out.values():
            out[name] = table
    return out


def undo(text: str, table: dict[str, int]) -> tuple[str, int]:
    """One level undone wherever characters make a UTF-8 sequence in the codec; how many places."""
    out, i, n, done = [], 0, len(text), 0
    while i < n:
        b = table.get(text[i], 0)
        size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if size and i + size <= n:
            try:
                out.append(bytes([b, *(table.get(c, 0) for c in text[i + 1 : i + size])]).decode("utf-8"))
                i += size
                done += 1
                continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return "".join(out), done


def explanations(garbled: str, clean: str, depth: int = DEPTH) -> list[str]:
    """The chains of codecs, outermost first, by which the clean characters became the garbled ones."""
    out = []
    for name, table in codecs().items():
        if any(c not in table for c in garbled):
            continue
        less, done = undo(garbled, table)
        if not done or len(less) >= len(garbled):
            continue
        if less == clean:
            out.append(name)
        elif depth > 1 and len(less) > len(clean):
            out += [f"{name}>{rest}" for rest in explanations(less, clean, depth - 1)]
    return out


def twin_pairs(docs: DataFrame) -> DataFrame:
    """(garbled, clean, n): aligned runs of words that are the same without their non-ASCII characters."""
    words = docs.where(F.col("text").rlike(_NON_ASCII)).select(F.split("text", r"[ \t\r\n]+").alias("w"))
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, _NON_ASCII + "+", "\x01"), "[0-9]+", "0")
    garbled = lambda x: x.rlike(_NON_ASCII) & ~x.contains("�") & ~x.contains("`")
    near = F.array_compact(F.transform("w", lambda x, i: F.when(garbled(x), F.struct(x.alias("x"), F.when(i > 0, F.get("w", i - 1)).alias("a"), F.get("w", i + 1).alias("b")))))
    rows = words.select(F.explode(near).alias("s")).select(strip(F.col("s.x")).alias("x"), strip(F.coalesce("s.a", F.lit(""))).alias("a"), strip(F.coalesce("s.b", F.lit(""))).alias("b"), F.regexp_extract_all("s.x", F.lit(f"({_NON_ASCII}+)")).alias("runs"))
    # without ASCII letters a key says nothing: all words of a text in another script would share it
    spoken = lambda c: F.when(c.rlike(f"(?:[A-Za-z][^A-Za-z]*){{{LETTERS}}}"), c)
    keyed = rows.select(F.explode(F.array(spoken(F.col("x")), spoken(F.concat_ws(" ", "a", "x", "b")))).alias("key"), "runs").where("key IS NOT NULL")
    variants = keyed.groupBy("key", "runs").agg(F.count("*").alias("n"))
    length = F.char_length(F.array_join("runs", ""))
    clean = variants.groupBy("key").agg(F.min_by("runs", F.struct(length, -F.col("n"))).alias("clean"), F.count("*").alias("k")).where("k > 1").drop("k")
    pairs = variants.join(clean, "key").where(length > F.char_length(F.array_join("clean", "")))
    return (
        pairs.select(F.explode(F.arrays_zip("runs", "clean")).alias("p"), "n")
        .select(F.col("p.runs").alias("garbled"), F.col("p.clean").alias("clean"), "n")
        .where(F.char_length("garbled") > F.char_length("clean"))
        .groupBy("garbled", "clean").agg(F.sum("n").alias("n"))
    )


def learn_chains(pairs: DataFrame) -> DataFrame:
    """(chain, pairs, n): the learned chains with the pairs, and their rows, that speak for them."""

    def explain(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for garbled, clean in batches:
            yield pd.Series([explanations(g, c) for g, c in zip(garbled, clean)])

    found = cut(pairs.select("garbled", "clean", "n", F.explode(F.pandas_udf(explain, "array<string>")("garbled", "clean")).alias("chain")), "garble-chains")
    support = found.groupBy("chain").agg(F.count("*").alias("all"))
    # codecs that explain the same pairs are all kept; the text decides
    best = W.partitionBy("garbled", "clean").orderBy(F.size(F.split("chain", ">")), F.desc("all"))
    own = found.join(support, "chain").withColumn("k", F.rank().over(best)).where("k = 1")
    return own.groupBy("chain").agg(F.count("*").alias("pairs"), F.sum("n").alias("n")).where(F.col("pairs") >= SUPPORT)


class Restorer:
    """Undoes the learned chains in one text; remembers runs."""

    MEMO = 100_000

    def __init__(self, chains: list[str], alphabet: frozenset[str] | None):
        pool = codecs()
        self.chains = [(c, [pool[x] for x in c.split(">")]) for c in chains]
        self.alphabet = alphabet
        self.memo: dict[str, list] = {}

    def ways(self, run: str) -> list[tuple[int, int, list[str]]]:
        """(depth, number of the chain, the run after each level) of each chain that explains the run; deepest first."""
        known = self.memo.get(run)
        if known is None:
            known = []
            for k, (_, tables) in enumerate(self.chains):
                levels, text = [], run
                for table in tables:
                    text, done = undo(text, table)
                    if not done:
                        break
                    levels.append(text)
                if len(levels) == len(tables) and (self.alphabet is None or all(c in self.alphabet for c in text if ord(c) > 127)):
                    known.append((len(levels), k, levels))
            known.sort(key=lambda w: (-w[0], len(w[2][-1]), w[1]))
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[run] = known
        return known

    def restore(self, text: str) -> str:
        if not RUN.search(text):
            return text
        votes: Counter[int] = Counter()
        spans = [m.span() for m in CODE.finditer(text)]
        inside = lambda at: any(a <= at < b for a, b in spans)
        for m in RUN.finditer(text):
            if (ways := self.ways(m[0])) and not inside(m.start()):
                votes.update(k for d, k, _ in ways if d == ways[0][0])
        if not votes:
            return text
        usual = len(self.chains[votes.most_common(1)[0][0]][1])

        def one(m: re.Match) -> str:
            ways = self.ways(m[0])
            if not ways:
                return m[0]
            depth, _, levels = min(ways, key=lambda w: (-w[0], len(w[2][-1]), -votes[w[1]], w[1]))
            if not inside(m.start()):
                return levels[-1]
            return levels[usual - 1] if depth > usual else m[0]

        return RUN.sub(one, text)

    def shows(self, text: str) -> bool:
        spans = CODE.sub("", text)
        return any(self.ways(m[0]) for m in RUN.finditer(spans))


def learned(docs: DataFrame) -> tuple[list[str], frozenset[str]]:
    """The chains, best supported first, and the alphabet."""
    pairs = cut(twin_pairs(docs), "garble-pairs")
    rows = learn_chains(pairs).orderBy(F.desc("pairs"), "chain").collect()  # bounded by the pool of codecs
    chains = [r["chain"] for r in rows]
    # what a chain was seen to restore; then what the texts hold that show none of that, and once more with those letters
    alphabet = {c for r in pairs.select(F.explode(F.split("clean", "")).alias("c")).groupBy("c").agg(F.count("*").alias("k")).where("k > 1").collect() for c in r["c"] if ord(c) > 127}
    alphabet |= _clean_letters(docs, chains, frozenset(alphabet))
    letters = _clean_letters(docs, chains, frozenset(alphabet))
    return chains, frozenset(letters | {d for c in letters for d in (c.upper(), c.lower()) if len(d) == 1 and ord(d) > 127})


def _clean_letters(docs: DataFrame, chains: list[str], alphabet: frozenset[str]) -> set[str]:
    """The non-ASCII characters of the texts in which no chain explains a run by the alphabet: bounded by Unicode."""

    def letters(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Restorer(chains, alphabet)
        for texts in batches:
            yield pd.Series([[] if "�" in t or r.shows(t) else sorted({c for run in RUN.findall(CODE.sub("", t)) for c in run}) for t in texts])

    rows = docs.where(F.col("text").rlike(_NON_ASCII)).select(F.explode(F.pandas_udf(letters, "array<string>")("text")).alias("c"))
    return {r["c"] for r in rows.groupBy("c").agg(F.count("*").alias("k")).where(F.col("k") >= SEEN).collect()}


def restore_garbled(docs: DataFrame) -> DataFrame:
    """(doc_id, restored, lost): every text with garbled sequences; restored is null where characters are lost."""
    chains, alphabet = learned(docs)
    held = docs.sparkSession.sparkContext.broadcast((chains, alphabet))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(*held.value)
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                if "�" in CODE.sub("", text):
                    rows.append((i, None, True))
                elif (now := r.restore(text)) != text:
                    rows.append((i, now, False))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "lost"])

    return docs.where(F.col("text").rlike(_NON_ASCII)).select("doc_id", "text").mapInPandas(restore, "doc_id bigint, restored string, lost boolean")


def garbled_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, restored_sha): SHA-256 of the text as it was, '' where characters are lost for good."""
    found = restore_garbled(docs)
    return found.select("doc_id", F.when(F.col("lost"), "").otherwise(F.sha2(F.encode("restored", "UTF-8"), 256)).alias("restored_sha"))
