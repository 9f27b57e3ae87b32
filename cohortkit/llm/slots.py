"""Texts as sequences of hashed tokens: runs of letters, single symbols, numbers, line ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from cohortkit.llm.shingles import mix

CHUNK = 1 << 20       # bytes of text worked on at once; a longer text is a chunk of its own

_SPACE, _LETTER, _DIGIT, _LINE, _SYMBOL = range(5)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[0x80:] = _LETTER
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CLASS[_c] = _LETTER
for _c in b"0123456789":
    _CLASS[_c] = _DIGIT
for _c in b" \t\r\x0b\x0c":
    _CLASS[_c] = _SPACE
_CLASS[0x0A] = _LINE
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, size=256, dtype=np.uint64)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE[_c] = _BYTE[_c + 32]
for _c in b"0123456789":
    _BYTE[_c] = _BYTE[ord("0")]  # numbers differ by their length alone
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _CLASS[raw]
    begins = kind != _SPACE
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _LINE) | ((kind[1:] == _SYMBOL) & (raw[1:] != raw[:-1]))
    start = np.flatnonzero(begins)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    if not len(start):
        return np.empty(0, np.uint64), counts
    which = np.cumsum(begins, dtype=np.int32) - 1
    place = np.arange(len(raw), dtype=np.int32) - start.astype(np.int32)[np.maximum(which, 0)]
    part = np.where(kind == _SPACE, np.uint64(0), _BYTE[raw])
    powers = np.full(int(place.max(initial=0)) + 1, _STEP, np.uint64)
    powers[0] = 1
    part *= np.cumprod(powers, dtype=np.uint64)[np.maximum(place, 0)]
    return mix(np.add.reduceat(part, start)), counts


def token_hashes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of all tokens, number of tokens of each text) chunk by chunk, in order."""
    held, size = [], 0
    for t in texts:
        held.append(t.encode() if t else b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield _tokens(held)
            held, size = [], 0
    if held:
        yield _tokens(held)
