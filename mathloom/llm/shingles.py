"""Character trigrams of many texts at once, as hashed integers in flat arrays (numpy, no loop over characters)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (murmur3): spreads integers evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of each text: (packed codes, offsets); text i has codes[offsets[i]:offsets[i + 1]].

    Three code points of 21 bits fit one integer, so codes are exact; texts under three characters have none.
    """
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    k = np.maximum(n - 2, 0)
    starts = np.cumsum(n) - n
    at = np.repeat(starts - (np.cumsum(k) - k), k) + np.arange(k.sum())
    codes = (cp[at] << np.uint64(42)) | (cp[at + 1] << np.uint64(21)) | cp[at + 2] if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), k)
    order = np.argsort(codes)
    order = order[np.argsort(doc[order], kind="stable")]
    codes, doc = codes[order], doc[order]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(doc[keep], minlength=len(texts)), out=offsets[1:])
    return codes[keep], offsets


def trigram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``trigrams`` (codes of a text in another order), by one sort of one array: characters are numbered so
    that a text's number and three characters fit one integer. Where they don't, each half of the texts goes alone."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    used = np.flatnonzero(np.bincount(cp, minlength=1)).astype(np.uint64)
    bits = max(1, int(len(used) - 1).bit_length())
    if 3 * bits + len(texts).bit_length() > 64 and len(texts) > 1:
        a, oa = trigram_codes(texts[: len(texts) // 2])
        b, ob = trigram_codes(texts[len(texts) // 2 :])
        return np.concatenate([a, b]), np.concatenate([oa, ob[1:] + oa[-1]])
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.uint64)
    number[used.astype(np.int64)] = np.arange(len(used), dtype=np.uint64)
    c, one, two, three = number[cp], np.uint64(bits), np.uint64(2 * bits), np.uint64(3 * bits)
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    key = (doc[2:] << three) | (c[:-2] << two) | (c[1:-1] << one) | c[2:]
    key = np.sort(key[doc[2:] == doc[:-2]])
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount((key >> three).astype(np.int64), minlength=len(texts)), out=offsets[1:])
    low = (np.uint64(1) << one) - np.uint64(1)
    return (used[(key >> two) & low] << np.uint64(42)) | (used[(key >> one) & low] << np.uint64(21)) | used[key & low], offsets


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of each text as hashes: (hashes, offsets). Unlike trigrams have unlike hashes."""
    codes, offsets = trigram_codes(texts)
    return mix(codes), offsets


def segment_min(values: np.ndarray, offsets: np.ndarray, empty: int) -> np.ndarray:
    """Minimum of each segment; ``empty`` where there is none."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.minimum.reduceat(values, offsets[:-1][full])
    return out


def counted(batches: Iterator[np.ndarray], most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, count) of the codes of all batches, summed up while no more than ``most`` distinct ones are held.

    Nothing is left out: what a task can't hold is summed in the shuffle, so the sums don't depend on the partitions.
    """
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    size = 0
    for new in batches:
        held.append(new)
        size += len(new)
        if size > most:
            codes, counts = _summed(codes, counts, held)
            held, size = [], 0
            if len(codes) > most:
                yield codes, counts
                codes, counts = codes[:0], counts[:0]
    yield _summed(codes, counts, held)


def _summed(codes: np.ndarray, counts: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new = np.sort(np.concatenate(held)) if held else codes[:0]
    first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]]) if len(new) else np.zeros(0, np.int64)
    u, c = new[first], np.diff(np.r_[first, len(new)])
    if not len(codes):
        return u, c
    both, at = np.unique(np.concatenate([codes, u]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([counts, c]), len(both)).astype(np.int64)


def jaccard(left: list[str], right: list[str]) -> np.ndarray:
    """Exact Jaccard similarity of the trigram sets of each pair; two sets without trigrams are alike if the texts are."""
    held: dict[str, set[str]] = {}

    def grams(t: str) -> set[str]:
        got = held.get(t)
        if got is None:
            if len(held) >= 1000:
                held.clear()
            got = held[t] = {t[j : j + 3] for j in range(len(t) - 2)}
        return got

    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left, right)):
        a, b = grams(x), grams(y)
        both = len(a & b)
        union = len(a) + len(b) - both
        out[i] = both / union if union else float(x == y)
    return out
