"""Word shingles of whole batches of texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (split at ASCII white space, A-Z lower-cased), and where each text's words begin."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)  # white space at an end gives an empty word
    offsets = np.concatenate([[0], np.cumsum(some)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    coded = flat.filter(pa.array(some)).dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)  # much faster than a Python list
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return distinct[codes] if len(codes) else np.zeros(0, np.uint64), offsets


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position; fewer words than ``k`` are one sequence as a whole."""
    n = len(h)
    if not n:
        return h
    with np.errstate(over="ignore"):
        size = min(k, n)
        total = np.full(n - size + 1, size, np.uint64) * _A
        for j in range(size):
            total = (total ^ h[j : n - size + 1 + j]) * (_A + np.uint64(2 * j))
            total ^= total >> np.uint64(29)
        return mix(total)


def spaced_hashes(h: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``places`` from each position; none where there are fewer words than they span."""
    n = max(0, len(h) - places[-1])
    with np.errstate(over="ignore"):
        total = np.full(n, len(places), np.uint64) * _B
        for j, p in enumerate(places):
            total = (total ^ h[p : n + p]) * (_A + np.uint64(2 * j))
            total ^= total >> np.uint64(29)
        return mix(total)


def run_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of the run of ``words`` words from each position, put together from runs whose lengths are powers of two."""
    if len(h) < words:
        return np.zeros(0, np.uint64)
    out, at, size, power = None, 0, 1, h
    with np.errstate(over="ignore"):
        while at < words:
            if words & size:
                part = power[at : at + len(h) - words + 1]
                out = mix(part * _A) if out is None else mix((out ^ part) * _A)
                at += size
            if at < words:
                power = mix(power[: len(power) - size] * _B + power[size:])
            size *= 2
    return out


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles."""
    h, at = word_hashes(texts)
    return [np.unique(ngram_hashes(h[a:b], k)) for a, b in zip(at, at[1:])]
