"""Word shingles of texts as 64-bit hashes (numpy over the bytes of many texts at once)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
CHUNK = 1 << 20  # bytes of text worked on at once; a longer text is a chunk of its own

_rnd = np.random.default_rng(20240229)
_BYTE = _rnd.integers(1, 1 << 63, size=256, dtype=np.uint64)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE[_c] = _BYTE[_c + 32]  # A-Z count as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rnd.integers(1, 1 << 63, size=WORDS, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes], table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order, and the number of words of each text; ``table`` has a number per byte."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    white = _WHITE[raw]
    begins = ~white
    begins[1:] &= white[:-1]
    start = np.flatnonzero(begins)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    if not len(start):
        return np.empty(0, np.uint64), counts
    which = np.cumsum(begins) - 1
    inside = np.arange(len(raw)) - start[np.maximum(which, 0)]
    part = np.where(white, np.uint64(0), table[raw])
    size = np.add.reduceat(~white, start, dtype=np.int64)
    part *= _powers(int(inside.max(initial=0)) + 1)[np.maximum(inside, 0)]
    return mix(np.add.reduceat(part, start) + size.astype(np.uint64) * _STEP), counts


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    place = _PLACE if words == WORDS else np.resize(_PLACE, words) + np.arange(words, dtype=np.uint64) * np.uint64(2)
    whole = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        whole += mix(hashes[k:k + len(whole)] + np.uint64(k)) * place[k]
    whole = mix(whole)
    at = 0
    for c in counts.tolist():
        if c >= words:
            yield np.unique(whole[at:at + c - words + 1])
        elif c:
            short = (mix(hashes[at:at + c] + np.arange(c, dtype=np.uint64)) * place[:c]).sum(dtype=np.uint64, keepdims=True)
            yield mix(short + np.array([c], np.uint64) * _STEP)
        else:
            yield np.empty(0, np.uint64)
        at += c


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``words`` make one shingle, none make none."""
    held, size = [], 0
    for t in texts:
        held.append(t.encode() if t else b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield from _sets(held, words)
            held, size = [], 0
    if held:
        yield from _sets(held, words)
