"""Word shingles of whole texts, hashed in arrays."""

from __future__ import annotations

import numpy as np

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BYTE = np.random.default_rng(20_240_601).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[4]
    h = (h ^ (h >> np.uint64(29))) * _MIX[5]
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(2 * n, _MIX[0], np.uint64)) * _MIX[3]
    return _POWERS[:n]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased, cut at ASCII white space), and how many words each text has."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    flat = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    inside = ~_WHITE[flat]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    # sum of byte * power within each word, made independent of the place by powers that count from the word's start
    at = np.arange(len(flat)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(flat)]])))
    value = np.where(inside, _BYTE[flat] * _powers(int(at.max()) + 1)[at], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    h = mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * _MIX[2])
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    stops = np.cumsum(sizes)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], stops]), side="right"))
    return h, counts


def shingle_sets(texts: list[str], size: int = 4) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted: runs of `size` words; of a shorter text, all its words as one."""
    h, counts = words(texts)
    n = len(h) - size + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        runs = (runs ^ (runs >> np.uint64(31))) * _MIX[1] + h[j : j + n] * _MIX[j % 4]
    runs = mix(runs)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(runs[at : at + c - size + 1]))
        elif c:
            one = np.full(1, c, np.uint64)
            for x in h[at : at + c]:
                one = (one ^ (one >> np.uint64(30))) * _MIX[3] + x
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
