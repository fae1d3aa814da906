"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 6).

The merges are compiled into an automaton over tokens. Its states are tokens, and an arc a -> b exists exactly if b may
follow a in an encoding. All arcs exist at first; the gadget of a merge (u, v) takes away, for tokens a that end in u
and tokens b that begin with v, the arcs along which the merge would have come first: before u was merged into a, and
not after v was merged into b (of equal merges the left one comes first). Arcs are made when first asked for, as the
full table has 2.5 billion entries. The automaton is deterministic: of the tokens that end at a place of a word just
one has an arc from the token before it, so a word is encoded from left to right by table-driven transitions, and
decoded by emitting the bytes of its arcs.

A word falls into pieces where two bytes meet that are neighbours in no token. Pieces repeat all over a corpus, so each
worker keeps a bounded table of their encodings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-split of this vocabulary: contractions, letters, digits, other signs, blanks (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
_INF = 1 << 60
_CACHE_SIZE = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tokens, their merges, and the arcs between them."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = tokens
        self.bytes = {i: t for t, i in tokens.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (u, v) in enumerate(merges):
            a, b, t = tokens[u], tokens[v], tokens[u + v]
            self.rank[a, b] = r
            if t not in self.made:
                self.parts[t], self.made[t] = (a, b), r
        reach = {i: t for t, i in tokens.items() if len(t) == 1 or i in self.parts}
        self.longest = max(map(len, reach.values()))
        self.by_bytes = {t: i for i, t in reach.items()}
        inside = np.zeros((256, 256), bool)
        for t in reach.values():
            x = np.frombuffer(t, np.uint8)
            inside[x[:-1], x[1:]] = True
        self.joined = frozenset((int(a), int(b)) for a, b in zip(*np.nonzero(inside)))
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[str, list[int]] = {}
        import regex

        self.split = regex.compile(PATTERN).findall

    def _ends(self, t: int, side: int) -> list[tuple[int, int]]:
        """The tokens t begins (side 0) or ends (side 1) with, each with the rank of the merge that took it in."""
        out = [(t, _INF)]
        while t in self.parts:
            r = self.made[t]
            t = self.parts[t][side]
            out.append((t, r))
        return out

    def arc(self, a: int, b: int) -> bool:
        got = self.arcs.get((a, b))
        if got is None:
            got = True
            for u, gone_u in self._ends(a, 1):
                for v, gone_v in self._ends(b, 0):
                    r = self.rank.get((u, v))
                    if r is not None and r < gone_u and r <= gone_v:
                        got = False
            if len(self.arcs) > 4_000_000:
                self.arcs.clear()
            self.arcs[a, b] = got
        return got

    def run(self, w: bytes) -> list[int]:
        """Encode one piece: state[i] is the token that ends at i in the encoding of the first i bytes."""
        n = len(w)
        state, back = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                t = self.by_bytes.get(w[j:i])
                if t is not None and (j == 0 and self._alone(t) or j > 0 and state[j] >= 0 and self.arc(state[j], t)):
                    state[i], back[i] = t, j
                    break
        out, i = [], n
        while i:
            out.append(state[i])
            i = back[i]
        return out[::-1]

    def _alone(self, t: int) -> bool:
        """Whether a token's own bytes encode to it: always, as each was made by its merge from valid parts."""
        got = self.arcs.get((-1, t))
        if got is None:
            got = t not in self.parts or (self._alone(self.parts[t][0]) and self._alone(self.parts[t][1]) and self._whole(t))
            self.arcs[-1, t] = got
        return got

    def _whole(self, t: int) -> bool:
        """No other merge comes between the parts of t before the one that makes it."""
        a, b = self.parts[t]
        r0 = self.made[t]
        for u, gone_u in self._ends(a, 1):
            for v, gone_v in self._ends(b, 0):
                r = self.rank.get((u, v))
                if r is not None and r < r0 and r < gone_u and r <= gone_v:
                    return False
        return True

    def word(self, w: str) -> list[int]:
        """Encode a pre-split word: piece by piece, where no token spans the border of two characters."""
        out: list[int] = []
        begin = 0
        n = len(w)
        joined, pieces, borders = self.joined, self.pieces, _BORDERS
        while begin < n:
            end = begin + 1
            last = borders[w[begin]]
            while end < n:
                nxt = borders[w[end]]
                if (last[1], nxt[0]) not in joined:
                    break
                last = nxt
                end += 1
            p = w[begin:end]
            got = pieces.get(p)
            if got is None:
                got = self.run(p.encode("utf-8", "surrogatepass"))
                if len(pieces) >= _CACHE_SIZE:
                    pieces.clear()
                pieces[p] = got
            out += got
            begin = end
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self.words
        for w in self.split(text):
            got = words.get(w)
            if got is None:
                got = self.word(w)
                if len(w) < 16:
                    if len(words) >= _CACHE_SIZE:
                        words.clear()
                    words[w] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


class _Borders(dict):
    """First and last byte of a character."""

    def __missing__(self, c: str) -> tuple[int, int]:
        b = c.encode("utf-8", "surrogatepass")
        self[c] = b[0], b[-1]
        return self[c]


_BORDERS = _Borders()
_LOADED: dict[str, Automaton] = {}


def automaton(name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> Automaton:
    """The tokenizer's automaton, compiled once a process."""
    path = f"{folder}/{name}"
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t)
        tokens = {raw(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        _LOADED[path] = Automaton(tokens, merges)
    return _LOADED[path]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): token ids of every row's text, without special tokens.

    A null or an empty text has no ids: an empty list, never null. What looks like a special token is encoded as the
    text it is. Texts are encoded whole, whatever their length; repeated rows each get their row; other columns are
    left out, so their names don't matter. One pass over the input, no shuffle.
    """
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(name, folder)
        for b in batches:
            flat, ends = [], [0]
            parts = []
            n = 0
            for t in b.column("text").to_pylist():
                ids = a.encode(t)
                n += len(ids)
                ends.append(n)
                flat += ids
                if len(flat) > 1_000_000:
                    parts.append(np.array(flat, np.int32))
                    flat = []
            parts.append(np.array(flat, np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([b.column("key"), ids], ["key", "ids"])

    return src.mapInArrow(run, "key bigint, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokens bigint): the length of each row's encoding, 0 for null and empty texts."""
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(name, folder)
        for b in batches:
            n = pa.array([len(a.encode(t)) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key"), n], ["key", "tokens"])

    return src.mapInArrow(run, "key bigint, tokens bigint").withColumnRenamed("key", key)
