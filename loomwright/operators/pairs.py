"""Frequent pairs of numbers that share a line, counted range by range.

Terms are numbers by falling frequency, so a line is a sorted array and a pair belongs to its rarer
term: the pairs of a term are what stands before it on its lines. The numbers are cut into ranges of
about equal pairs. A task counts one range; it is sent, of each line, the piece up to the line's last
term of the range, not the pairs. Ranges go in rounds, whose shuffle files are gone before the next
round begins, so the files do not grow with the number of pairs.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard, stored

#: Pairs of a range at most, unless they are all of one term; and at least, where there are few.
MOST_PAIRS, LEAST_PAIRS = 64_000_000, 1_000_000
#: Ranges at least, if they do not become too small; what a task makes of pairs at once.
RANGES, CHUNK = 48, 2_000_000
#: Pairs that are written out together.
STEP = 250_000
#: Occurrences of terms in a bucket, of which ranges are made.
BUCKET = 30_000
#: Cells of a range that is counted in an array of all its possible pairs.
CELLS = 4_000_000
#: Pairs of a round for each occurrence of a term in the text, or ranges of a round (a range gets an occurrence
#: once at most): what is sent stays a small multiple of the text. Fewer pairs than ``ONE_ROUND`` go at once.
ROUND, ONE_ROUND = 8, 200_000_000

_LINES = "lens binary, low binary, high binary"
_OUT = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("c_xy", pa.int64())])


def _packed(ids: np.ndarray, lens: np.ndarray) -> list:
    """Numbers as planes of 16 bits: the upper one is nearly all zeros and goes in compression."""
    planes = ids.astype("<u4").view("<u2").reshape(-1, 2)
    return [pa.array([x], pa.binary()) for x in (lens.astype("<i4").tobytes(), planes[:, 0].tobytes(), planes[:, 1].tobytes())]


def _unpacked(lens: bytes, low: bytes, high: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(low, "<u2").astype(np.int32) | (np.frombuffer(high, "<u2").astype(np.int32) << 16), np.frombuffer(lens, "<i4").astype(np.int64)


def _rows(batches, *names):
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def _places(lens: np.ndarray) -> np.ndarray:
    """The place of each element in its line."""
    return np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)


def encoded(sets: DataFrame, shared) -> DataFrame:
    """The lines' terms that ``shared`` (term, ...) lists, as their numbers there in ascending order; one row a batch."""

    def run(batches):
        known = pa.ipc.open_stream(shared.value).read_all().column("term").combine_chunks()
        for b in batches:
            lists = b.column(0)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            key = (np.repeat(np.arange(len(lens)), lens) << 32 | ids)[ids >= 0]
            key.sort()
            line, ids = key >> 32, key & 0xFFFFFFFF
            lens = np.bincount(line, minlength=len(lens))
            ids, lens = ids[lens[line] > 1], lens[lens > 1]
            if len(lens):
                yield pa.RecordBatch.from_arrays(_packed(ids, lens), ["lens", "low", "high"])

    return sets.select("terms").mapInArrow(run, _LINES)


def _weights(lines: DataFrame, bounds: np.ndarray) -> np.ndarray:
    """Pairs of each bucket of numbers."""
    shared = lines.sparkSession.sparkContext.broadcast(bounds)  # a number for each BUCKET occurrences

    def run(batches):
        bucket = np.repeat(np.arange(len(shared.value) - 1), np.diff(shared.value))
        total = np.zeros(len(shared.value) - 1)
        for row in _rows(batches, "lens", "low", "high"):
            ids, lens = _unpacked(*row)
            total += np.bincount(bucket[ids], weights=_places(lens), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].astype(np.int64))], ["bucket", "n"])

    found = np.zeros(len(bounds) - 1, np.int64)
    for r in lines.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        found[r.bucket] = r.n
    shared.unpersist()
    return found


def _buckets(lines: DataFrame, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of buckets and their pairs: none but those of one number has more than ``MOST_PAIRS``."""
    size = BUCKET
    while True:
        mark = np.cumsum(df) // size
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(mark)) + 1, [len(df)]])
        weights = _weights(lines, bounds)
        if size == 1 or not ((weights > MOST_PAIRS) & (np.diff(bounds) > 1)).any():
            return bounds, weights
        size = max(1, size // 16)


def _ranges(weights: np.ndarray) -> np.ndarray:
    """Bounds of ranges, in buckets."""
    most = min(MOST_PAIRS, max(LEAST_PAIRS, int(weights.sum()) // RANGES))
    cuts, held = [0], 0
    for k, w in enumerate(weights.tolist()):
        if held and held + w > most:
            cuts.append(k)
            held = 0
        held += w
    return np.array([*cuts, len(weights)])


def _pieces(lines: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(part, lens, low, high): of each line the piece up to its last number in a range; ``bounds`` are those of the round's ranges."""

    def run(batches):
        for row in _rows(batches, "lens", "low", "high"):
            ids, lens = _unpacked(*row)
            place = _places(lens)
            part = np.searchsorted(bounds, ids, "right") - 1
            last = np.ones(len(ids), bool)
            last[:-1] = (part[1:] != part[:-1]) | (place[1:] == 0)
            ends = np.flatnonzero(last & (part >= 0) & (part < len(bounds) - 1) & (place > 0))
            ends = ends[np.argsort(part[ends], kind="stable")]
            cut = np.searchsorted(part[ends], np.arange(len(bounds)))
            for p in range(len(bounds) - 1):
                some = ends[cut[p] : cut[p + 1]]
                if len(some):
                    size = place[some] + 1
                    at = np.repeat(some - np.cumsum(size) + 1, size) + np.arange(size.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *_packed(ids[at], size)], ["part", "lens", "low", "high"])

    return lines.mapInArrow(run, "part int, " + _LINES)


def _codes(ids: np.ndarray, at: np.ndarray, before: np.ndarray, low: int, high: int) -> np.ndarray:
    """(a - low) * high + b for the numbers a at ``at`` and the ``before`` numbers b in front of each."""
    kind = np.uint32 if (int(ids[at].max()) + 1 - low) * high < 2**32 else np.int64
    out, done = np.empty(int(before.sum()), kind), 0
    for s in _in_chunks(before, STEP):  # what it takes besides ``out`` stays small
        from_ = np.repeat(at[s] - np.cumsum(before[s]), before[s])
        from_ += np.arange(len(from_))
        part = out[done : done + len(from_)]
        part[:] = np.repeat(((ids[at[s]].astype(np.int64) - low) * high).astype(kind), before[s])
        part += ids[from_].astype(kind)
        done += len(from_)
    return out


def _in_chunks(before: np.ndarray, size: int):
    """Slices of about ``size`` pairs."""
    ends = np.cumsum(before)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, size)))
    yield from (slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(ends)]))


def _dense(ids, at, before, low: int, high: int, cells: np.ndarray, chunk: int) -> None:
    for s in _in_chunks(before, max(chunk, len(cells))):
        if before[s].any():
            cells += np.bincount(_codes(ids, at[s], before[s], low, high), minlength=len(cells))


def _found(code: np.ndarray, n: np.ndarray, low: int, high: int) -> pa.RecordBatch:
    code = code.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array((code // high + low).astype(np.int32)), pa.array((code % high).astype(np.int32)), pa.array(n.astype(np.int64))], schema=_OUT)


def _sorted(ids, at, before, low: int, high: int, threshold: int) -> pa.RecordBatch:
    code = _codes(ids, at, before, low, high)
    code.sort()
    t = max(1, threshold)
    many = code[: len(code) - t + 1] == code[t - 1 :] if len(code) >= t else np.zeros(0, bool)
    many[1:] &= code[1 : len(many)] != code[: max(0, len(many) - 1)]
    first = np.flatnonzero(many)
    return _found(code[first], np.searchsorted(code, code[first], "right") - first, low, high)


def _counted(batches, bounds: np.ndarray, inner: list, threshold: int, chunk: int, dense: int):
    """(a, b, c_xy) of the range in this partition; ``inner`` are the bounds of buckets in each range."""
    part, held, size = None, [], 0
    for p, *row in _rows(batches, "part", "lens", "low", "high"):
        if part is None:
            part, low, high = p, int(bounds[p]), int(bounds[p + 1])
            cells = np.zeros((high - low) * high, np.int64) if high - low == 1 or (high - low) * high <= dense else None
        if p != part:
            raise ValueError("two ranges in one partition")
        held.append(_unpacked(*row))
        size += len(held[-1][0])
        if cells is not None and size > chunk:
            _dense(*_own(held, low), low, high, cells, chunk)
            held, size = [], 0
    if part is None:
        return
    ids, at, before = _own(held, low)
    if cells is not None:
        _dense(ids, at, before, low, high, cells, chunk)
        code = np.flatnonzero(cells >= max(1, threshold))
        yield _found(code, cells[code], low, high)
        return
    del held
    order = np.argsort(ids[at], kind="stable")
    at, before = at[order], before[order]
    own, ends = ids[at], np.cumsum(before)
    cuts, k = np.searchsorted(own, inner[part]), 0
    while k < len(cuts) - 1:  # buckets together as far as the chunk goes, one at least
        start = ends[cuts[k] - 1] if cuts[k] else 0
        n = max(k + 1, int(np.searchsorted(ends[cuts[1:] - 1], start + chunk, "right")))
        s, below, above = slice(cuts[k], cuts[n]), int(inner[part][k]), int(inner[part][n])
        if before[s].sum() <= 4 * chunk:
            if cuts[n] > cuts[k]:
                yield _sorted(ids, at[s], before[s], below, above, threshold)
        else:
            for x in np.unique(own[s]).tolist():
                o = slice(*np.searchsorted(own, [x, x + 1]))
                if before[o].sum() <= 4 * chunk:
                    yield _sorted(ids, at[o], before[o], x, x + 1, threshold)
                else:
                    cells = np.zeros(x + 1, np.int64)
                    _dense(ids, at[o], before[o], x, x + 1, cells, chunk)
                    code = np.flatnonzero(cells >= max(1, threshold))
                    yield _found(code, cells[code], x, x + 1)
        k = n


def _own(held: list, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of pieces, the places of those from ``low`` on, and how many stand before each in its piece."""
    if not held:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, lens = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    at = np.flatnonzero(ids >= low)
    ends = np.cumsum(lens)
    before = at - (ends - lens)[np.searchsorted(ends, at, "right")]
    some = before > 0
    return ids, at[some], before[some]


def frequent_pairs(lines: DataFrame, df: np.ndarray, threshold: int) -> DataFrame:
    """(a, b, c_xy) with a > b and at least ``threshold`` common lines; ``df`` counts the lines of each number, falling."""
    bounds, weights = _buckets(lines, df)
    cuts = _ranges(weights)
    total = np.add.reduceat(weights, cuts[:-1])
    most = max(ROUND * int(df.sum()), ONE_ROUND)
    done, k = [], 0
    while k < len(total):
        n = min(len(total), max(k + ROUND, int(np.searchsorted(np.cumsum(total[k:]), most, "right")) + k))
        inner = [bounds[cuts[j] : cuts[j + 1] + 1] for j in range(k, n)]
        limits = bounds[cuts[k : n + 1]]
        count = partial(_counted, bounds=limits, inner=inner, threshold=threshold, chunk=CHUNK, dense=CELLS)
        dealt = _pieces(lines, limits).repartitionById(len(limits) - 1, "part")
        done.append(stored(dealt.mapInArrow(count, "a int, b int, c_xy bigint"), "pairs"))
        k = n
    discard(lines)
    return reduce(DataFrame.unionAll, done)


def named(pairs: DataFrame, shared) -> DataFrame:
    """(x, y, c_xy, c_x, c_y) with x < y, from numbers and ``shared`` (term, df)."""

    def run(batches):
        table = pa.ipc.open_stream(shared.value).read_all()
        terms, df = table.column("term").combine_chunks(), table.column("df").to_numpy()
        rank = np.empty(len(terms), np.int64)
        rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        for b in batches:
            a, y = b.column("a").to_numpy(), b.column("b").to_numpy()
            turned = rank[a] > rank[y]
            x, y = np.where(turned, y, a), np.where(turned, a, y)
            out = [terms.take(pa.array(x)), terms.take(pa.array(y)), b.column("c_xy"), pa.array(df[x]), pa.array(df[y])]
            yield pa.RecordBatch.from_arrays(out, ["x", "y", "c_xy", "c_x", "c_y"])

    return pairs.mapInArrow(run, "x string, y string, c_xy bigint, c_x bigint, c_y bigint")
