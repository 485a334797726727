"""Encoding a corpus with a public byte-level BPE vocabulary, exactly and in linear time.

Texts are split by the vocabulary's pattern. The UTF-8 bytes of a split are mapped to Latin-1, so
that an Aho-Corasick automaton over the vocabulary finds at every byte the longest token that
begins there. From these the encoder backtracks: a token may follow another only if merging by
rank would leave the border between them standing (memoised for each pair); otherwise it tries the
next shorter token, and failing that gives up the token before and marks the place as a dead end,
so no place is left twice. Texts are Spark's rows; a worker holds the vocabulary and a bounded memo.

Defined results: null and empty texts give an empty list, blank ones their own ids; names of
special tokens in a text are ordinary text; repeated rows and extra columns pass through.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Splits and pairs remembered by one worker; a full memo begins anew.
MEMO = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letters by which the vocabulary file writes bytes, by the rule it follows:
    printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        latin = lambda s: "".join(chr(letters[c]) for c in s)
        self.ids = {latin(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: rank of a merge by its two tokens; a single byte was never merged and ranks below all
        self.rank, self.parts, self.made = {}, {}, {}
        for rank, (a, b) in enumerate(merges):
            a, b = latin(a), latin(b)
            pair, whole = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.rank[pair] = rank
            self.parts.setdefault(whole, pair)
            self.made.setdefault(whole, rank)
        self.length = {i: len(s) for s, i in self.ids.items()}
        self.shorter = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, (i, len(s)))
            self.shorter[i] = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), None)
        self.automaton.make_automaton()
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def stands(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between the two tokens standing."""
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[pair] = self._stands(left, right)
        return known

    def _stands(self, left: int, right: int) -> bool:
        # Undo merges from the latest on. The tokens facing each other at the border may merge at
        # rank r; that happens first if r comes before the merges by which either was taken up.
        until = len(self.rank)
        while True:
            if self.rank.get((left, right), until) < until:
                return False
            l, r = self.made.get(left, -1), self.made.get(right, -1)
            if l < 0 and r < 0:
                return True
            if l > r:
                until, left = l, self.parts[left][1]
            else:  # of equal merges the left one comes first, so a pair of the right one's rank would too
                until, right = r + 1, self.parts[right][0]

    def split(self, word: str) -> list[int]:
        """The ids of one split of the pattern."""
        text = word.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest: list[int] = [0] * n
        size = [0] * n
        for end, (token, length) in self.automaton.iter(text):
            start = end - length + 1
            if length > size[start]:
                longest[start], size[start] = token, length
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + self.length[token]
            if not dead[end] and (not out or self.stands(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else 0
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for word in self.find(text or ""):
            ids = memo.get(word)
            if ids is None:
                ids = self.split(word)
                if len(word) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(path)


def token_ids(text: Column, path: str = f"{FOLDER}/byte_bpe_50k.json") -> Column:
    """A text's ids as array<int>, never null."""

    def encode(texts: pa.Array) -> pa.Array:
        e = encoder(path)
        return pa.array([e.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(encode, "array<int>")(text)


def encode_corpus(docs: DataFrame, path: str = f"{FOLDER}/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, ids) of every row."""
    return docs.select("doc_id", token_ids(F.col("text"), path).alias("ids"))
