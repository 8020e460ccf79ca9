"""Hashed character n-grams and small convex models, in numpy.

Models are fitted on the driver over a bounded sample of labelled rows (the bound is a
parameter of each operator); the features of the sample come from the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

_MULT = np.uint32(0x9E3779B1)
_STEP = np.uint32(0x01000193)
#: Code points looked at together; a longer text is read in overlapping pieces.
PIECE = 1 << 18


def ngram_slots(text: str, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Slots (0 to 2**bits - 1) of every character n-gram of the whole text, piece by piece."""
    longest, shift = max(orders), np.uint32(32 - bits)
    text = f" {text.lower()} "
    for begin in range(0, max(1, len(text) - longest + 1), PIECE):
        piece = text[begin : begin + PIECE + longest - 1]
        more = begin + PIECE + longest - 1 < len(text)
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        rolled = np.zeros(len(points) + 1, np.uint32)
        for n in range(1, longest + 1):
            rolled = rolled[:-1] * _STEP
            rolled += points[n - 1 :]
            rolled += np.uint32(n)
            if n in orders and len(rolled):
                own = rolled[: PIECE] if more else rolled
                yield ((own * _MULT) >> shift).view(np.int32)


class Presence:
    """Distinct slots of a text, with one reused bitmap."""

    def __init__(self, orders: tuple[int, ...], bits: int):
        self.orders, self.bits, self.seen = orders, bits, np.zeros(1 << bits, np.bool_)

    def __call__(self, text: str | None) -> np.ndarray:
        for slots in ngram_slots(text or "", self.orders, self.bits):
            self.seen[slots] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)


class Rows:
    """Sparse 0/1 (or weighted) rows, laid end to end; products go block by block to save memory."""

    BLOCK = 1 << 19

    def __init__(self, rows: list[np.ndarray], width: int, values: list[np.ndarray] | None = None):
        self.width, self.n = width, len(rows)
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        self.index = np.concatenate(rows).astype(np.int32, copy=False) if rows else np.zeros(0, np.int32)
        self.values = np.concatenate(values).astype(np.float32, copy=False) if values else None
        marks = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, self.BLOCK), "right"))
        self.blocks = []  # (first row, last row, first cell, last cell)
        for first, last in zip(marks, [*marks[1:], self.n]):
            self.blocks.append((int(first), int(last), int(ends[first - 1]) if first else 0, int(ends[last - 1])))
        self.sizes = np.diff(ends, prepend=0)

    def _parts(self):
        for first, last, a, b in self.blocks:
            row = np.repeat(np.arange(last - first), self.sizes[first:last])
            yield first, last, self.index[a:b], row, None if self.values is None else self.values[a:b]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for first, last, index, row, values in self._parts():
            taken = w[index]
            out[first:last] = np.bincount(row, taken if values is None else taken * values, last - first)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for first, last, index, row, values in self._parts():
            taken = g[first:last][row]
            out += np.bincount(index, taken if values is None else taken * values, self.width)
        return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60) -> np.ndarray:
    """Limited-memory quasi-Newton descent for a smooth convex function; deterministic."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0) < 1e-6:
            break
        q, used = grad.copy(), []
        for s, y, r in reversed(past):
            a = r * s.dot(q)
            q -= a * y
            used.append(a)
        if past:
            s, y, r = past[-1]
            q *= s.dot(y) / y.dot(y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y, r), a in zip(past, reversed(used)):
            q += (a - r * y.dot(q)) * s
        slope, t = -grad.dot(q), 1.0
        if slope >= 0:
            past, q, slope = [], grad, -grad.dot(grad)
        while True:
            new = x - t * q
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * t * slope or t < 1e-9:
                break
            t *= 0.5
        s, y = new - x, new_grad - grad
        if s.dot(y) > 1e-12:
            past = [*past[-7:], (s, y, 1.0 / s.dot(y))]
        if abs(value - new_value) < 1e-9 * max(1.0, abs(value)):
            x = new
            break
        x, value, grad = new, new_value, new_grad
    return x
