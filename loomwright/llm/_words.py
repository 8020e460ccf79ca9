"""Word hashes of whole texts in numpy: lower-cased runs of letters, digits and non-ASCII bytes."""

from __future__ import annotations

import numpy as np

#: Bytes hashed together; longer texts go piece by piece, cut between words.
PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_POWER = np.ones(PIECE + 1, np.uint64)
_POWER[1:] = np.cumprod(np.full(PIECE, _BASE, np.uint64))
_BACK = np.ones(PIECE + 1, np.uint64)
_BACK[1:] = np.cumprod(np.full(PIECE, pow(_BASE, -1, 1 << 64), np.uint64))
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64)
_WORD = np.zeros(256, np.bool_)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of lower-cased UTF-8, and its first byte."""
    out, firsts, begin = [], [], 0
    while begin < len(raw):
        end = min(len(raw), begin + PIECE)
        if end < len(raw):  # back to the end of a word, if one ends here at all
            gaps = np.flatnonzero(~_WORD[raw[begin:end]])
            end = begin + int(gaps[-1]) + 1 if len(gaps) else end
        part = raw[begin:end]
        inside = np.zeros(len(part) + 2, np.bool_)
        inside[1:-1] = _WORD[part]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[: len(part)], out=sums[1:])
        out.append(mixed((sums[last] - sums[first]) * _BACK[first] + (last - first).astype(np.uint64)))
        firsts.append(first + begin)
        begin = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(firsts)


def _raw(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    return _hashed(np.frombuffer(_raw(text), np.uint8))[0]


def word_hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts end to end, and where each text's begin (one more at the end)."""
    raws = [_raw(t) for t in texts]
    words, firsts = _hashed(np.frombuffer(b"\n".join(raws), np.uint8))
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws], dtype=np.int64)])
    return words, np.searchsorted(firsts, begins)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    rolled = words[:n].copy()
    for k in range(1, size):
        rolled *= np.uint64(_BASE)
        rolled += words[k : k + n]
    return mixed(rolled)
