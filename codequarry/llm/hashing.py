"""Words of many texts as 64-bit hashes, vectorized over the bytes of all of them."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from .decontaminate import _FOLD

#: Words longer than this are hashed one by one.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and ``bounds``: text k has words ``bounds[k]:bounds[k + 1]``.

    Words are as in ``split_words``; a hash depends on its word alone.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(parts).translate(_FOLD)
    data = np.frombuffer(joined, np.uint8)
    inside = np.concatenate(([False], data != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
    bounds = np.searchsorted(starts, begin)
    out = np.zeros(starts.size, np.uint64)
    size = ends - starts
    left = np.flatnonzero(size <= LONG)
    at, stop = starts[left], ends[left]
    while left.size:
        h = (out[left] ^ data[at]) * np.uint64(0x100000001B3)
        out[left] = h ^ (h >> np.uint64(29))
        at = at + 1
        more = at < stop
        at, left, stop = at[more], left[more], stop[more]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return mixed(out), bounds


def kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers; a text of fewer words, but not none, is one k-mer."""
    k = min(k, hashes.size)
    out = np.zeros(hashes.size - k + 1 if k else 0, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + out.size]
    return mixed(out)


def text_kmers(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``kmers`` of texts that follow each other in ``words``, and the bounds of each text's."""
    n = np.diff(bounds)
    grams = np.zeros(words.size, np.uint64)
    whole = kmers(words, k) if words.size >= k else grams[:0]
    grams[: whole.size] = whole
    left = np.repeat(bounds[1:], n) - np.arange(words.size)
    keep = left >= k
    for d in np.flatnonzero((n > 0) & (n < k)):
        grams[bounds[d]] = kmers(words[bounds[d] : bounds[d + 1]], k)[0]
        keep[bounds[d]] = True
    at = np.flatnonzero(keep)
    return grams[at], np.searchsorted(at, bounds)


def labelled(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """K-mers of texts that follow each other, with the number of their occurrence in the text mixed in."""
    own = np.repeat(np.arange(bounds.size - 1), np.diff(bounds)).astype(np.uint64)
    apart = mixed(grams + own * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(apart, kind="stable")
    s = apart[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))[: s.size]
    begin = np.maximum.accumulate(np.where(first, np.arange(s.size), 0))
    out = np.empty_like(grams)
    out[order] = (np.arange(s.size) - begin).astype(np.uint64)
    return mixed(grams + np.uint64(0x9E3779B97F4A7C15) * out)
