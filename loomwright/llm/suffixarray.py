"""Suffix-array deduplication: bytes covered by long strings that start elsewhere too are removed.

``suffix_order`` builds a suffix array by linear grouping: suffixes start grouped by their first
symbol; groups are processed in descending order, each member points to its previous smaller
group, and what is pointed at k times moves, inside its own group, behind what is pointed at
fewer times, so groups become those of equal Lyndon prefixes. A second sweep emits each group's
order from the smaller suffixes already placed. Nothing is renamed and there is no recursion.

Distribution. A string of ``Shape.length`` bytes has an anchor, its 32-byte gram of least hash, at the same
place wherever the string starts. (1) The anchors of all documents are counted with a hash of
their whole context (all strings around the anchor). An anchor matters if a context of it occurs
twice or two of its contexts differ. (2) One copy of each context that differs, two copies, from
two places, of each that occurs twice, are cut out of their documents and dealt by anchor.
(3) The contexts of a task, as blocks of 64 bytes counted from the anchor, go into suffix arrays;
a string is a candidate if the suffix at its first whole block shares all its whole blocks with a
neighbour in the order. Candidates meet by hash inside one anchor, and their bytes are compared.
(4) The covered bytes are joined to the documents and cut out.

An anchor with more than ``GROUP`` contexts is no single task: its contexts are sorted by their
suffixes from the anchor on (ties: by the bytes before it, read backwards), over ranges of that
order, and each is compared with the ``BEFORE`` contexts before it, byte by byte. A string that one
of them has as well is done. The others, the first of each run, meet by a second key, the bytes
that strings of one cell (``CELLS`` starts) share, in ever smaller cells, until the key is the
string. So both ways find the same strings at any size.

With ``Shape.words`` shorter passages are marked as well: anchors then are dense enough for every
string of that many words, and each context is compared with its neighbours in the order of the
suffixes that begin at the anchors; where as many whole words (runs of anything but ASCII white
space) are common to both, they are a passage. ``report`` then adds columns for what both kinds
cover. This marks no text without such a passage; one that is no neighbour's may be left out. The
bytes that are removed stay those of the first kind, which are complete.

Matches never cross documents. Nulls and empty texts have no bytes and lose none. A text of any
length is read in pieces of 32 KB. Rows are told apart by doc_id and text, so a row that repeats
counts as another document, as the definition says; among equal places (ties) every one is
covered. An empty table gives an empty result. Other columns, whatever their names, pass through
``cut`` unchanged: the row travels as one struct.
"""

from __future__ import annotations

import hashlib
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import NONSPACE, anchors, word_anchors
from ..functions.storage import discard, stored
from ._common import map_rows, partitions, settled
from ._words import _BACK, _BYTE, _POWER, mixed



class Shape(NamedTuple):
    """Bytes of a string, of its anchor's gram, of the blocks that the suffix array sees; words of the shorter strings."""

    length: int = 400
    gram: int = 32
    block: int = 64
    words: int | None = None

    @property
    def left(self) -> int:
        """Bytes before an anchor that a string around it can hold."""
        return self.length - self.gram

    @property
    def width(self) -> int:
        """Bytes of a context, laid out."""
        return self.left + self.length


SHAPE = Shape()
#: The query's: passages of 50 words are reported besides.
PASSAGES = Shape(block=128, words=50)
#: Contexts of one key that one suffix array may take.
GROUP = 512
#: Contexts taken together into one suffix array.
TOGETHER = 1024
#: Strings of a hot anchor meet in cells of so many starts.
CELLS = (46, 6, 1)
#: Contexts before a hot anchor's, in the order of suffixes, that it is compared with.
BEFORE = 4


def suffix_order(symbols: list[int]) -> list[int]:
    """Suffix array of non-negative integers, by linear grouping (a shorter suffix is less)."""
    text = [x + 1 for x in symbols] + [0]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, end = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for at, i in enumerate(order):
        place[i] = at
        if text[i] != text[order[start]]:
            start = at
        group[i] = start
        end[start] = at + 1
    smaller = [-1] * n
    top = n
    while top:
        low = group[order[top - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[low:top]) if top - low > 1 else order[low:top]:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            times: dict[int, list[int]] = {}
            for p, k in pointed.items():
                times.setdefault(k, []).append(p)
            for k in sorted(times, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in times[k]:
                    own = group[p]
                    last = end[own] - 1
                    end[own] = last
                    other, at = order[last], place[p]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                    moved.setdefault(own, []).append(p)
                for own, members in moved.items():
                    new = end[own]
                    end[new] = new + len(members)
                    for p in members:
                        group[p] = new
        top = low
    result, free = [-1] * n, group
    head = list(range(n))
    done = bytearray(n)
    result[0] = n - 1
    done[n - 1] = 1
    for at in range(n):
        s = result[at] - 1
        while s >= 0 and not done[s]:
            own = free[s]
            result[head[own]] = s
            head[own] += 1
            done[s] = 1
            s = smaller[s]
    return result[1:]


def neighbour_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix: symbols (at most ``most``) that it shares with the closer of its neighbours in the order.

    A symbol of 0 separates: it equals nothing.
    """
    n = len(symbols)
    padded = np.append(symbols, np.zeros(most, symbols.dtype))
    a, b = order[:-1], order[1:]
    same, shared = np.ones(max(0, n - 1), np.bool_), np.zeros(max(0, n - 1), np.int64)
    for k in range(most):
        same &= (padded[a + k] == padded[b + k]) & (padded[a + k] > 0)
        if not same.any():
            break
        shared += same
    best = np.zeros(n, np.int64)
    best[a] = shared
    best[b] = np.maximum(best[b], shared)
    return best


def block_symbols(group: np.ndarray, left: np.ndarray, raw: np.ndarray, sizes: np.ndarray, shape: Shape = SHAPE) -> np.ndarray:
    """Contexts x blocks: a number for each block of a group that occurs twice, 0 for the others.

    ``raw``: one context a row, its anchor at column ``left``; contexts of different groups share nothing.
    """
    size = shape.block
    n, before, after = len(raw), shape.left // size, shape.length // size
    blocks = before + after
    first = shape.left - before * size
    cells = raw[:, first : first + blocks * size].reshape(n, blocks, size)
    # blocks that lie in the context as a whole; the others equal nothing
    begin = (np.arange(blocks) - before) * size
    whole = (begin[None, :] >= -left[:, None]) & (begin[None, :] + size <= (sizes - left)[:, None])
    eights = np.ascontiguousarray(cells[whole]).view(np.uint64)  # 8 bytes at once
    hashed = mixed((mixed(eights) * _POWER[1 : size // 8 + 1]).sum(1, dtype=np.uint64) + np.repeat(group, whole.sum(1)))
    order = np.argsort(hashed)
    new = np.concatenate([[True], hashed[order[1:]] != hashed[order[:-1]]])[: len(order)]
    begins = np.flatnonzero(new)
    counts = np.diff(np.append(begins, len(order)))
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.repeat(np.where(counts > 1, np.arange(1, len(begins) + 1), 0), counts)
    symbols = np.zeros((n, blocks), np.int64)
    symbols[whole] = ranks
    return symbols


def runs_ahead(symbols: np.ndarray) -> np.ndarray:
    """How many symbols without a 0 stand from each place on."""
    run = np.zeros((len(symbols), symbols.shape[1] + 1), np.int64)
    for b in reversed(range(symbols.shape[1])):
        run[:, b] = (run[:, b + 1] + 1) * (symbols[:, b] > 0)
    return run[:, :-1]


def shared_blocks(symbols: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Contexts x blocks: how many symbols, from each place on, the suffix shares with its closer neighbour in the order.

    The suffix array is that of the runs of symbols in which some place is ``wanted``; what no two
    contexts have ends every match, and so does the end of a run.
    """
    flat = np.append(symbols, np.zeros((len(symbols), 1), np.int64), axis=1).ravel()
    known = flat > 0
    begins = np.flatnonzero(known & ~np.append(False, known[:-1]))
    found = np.zeros(flat.shape, np.int64)
    if len(begins):
        ends = np.flatnonzero(known & ~np.append(known[1:], False)) + 1
        marks = np.append(0, np.cumsum(np.append(wanted, np.zeros((len(wanted), 1), np.bool_), axis=1).ravel()))
        own = marks[ends] > marks[begins]
        begins, sizes = begins[own], (ends - begins)[own] + 1  # with a separator
        where = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        text = flat[where]
        if len(text):
            found[where] = neighbour_prefixes(text, np.array(suffix_order(text.tolist())), symbols.shape[1])
    return found.reshape(len(symbols), -1)[:, :-1]


def laid(contexts: list[bytes], left: np.ndarray, shape: Shape = SHAPE) -> np.ndarray:
    """Contexts as rows, anchors in one column; what is missing at an end is zero."""
    size, zero = shape.width, bytes(shape.width)
    rows = [zero[: shape.left - a] + c for c, a in zip(contexts, left.tolist())]
    return np.frombuffer(b"".join(r + zero[: size - len(r)] for r in rows), np.uint8).reshape(len(contexts), size)


def candidates(symbols: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, block, blocks shared): where strings begin whose whole blocks the suffix array finds in another place."""
    least = (shape.length - shape.block + 1) // shape.block  # whole blocks of any string
    places = shape.left // shape.block + 1
    wanted = np.zeros(symbols.shape, np.bool_)
    wanted[:, :places] = runs_ahead(symbols)[:, :places] >= least
    shared = shared_blocks(symbols, wanted)
    row, block = np.nonzero(shared[:, :places] >= least)
    return row, block, shared[row, block]


def strings_from(row: np.ndarray, block: np.ndarray, shared: np.ndarray, left: np.ndarray, right: np.ndarray, shape: Shape):
    """(context, bytes before the anchor, bytes from it) of the long strings whose first whole block is ``block``."""
    size = shape.block
    first = (shape.left // size - block) * size
    offset = first[:, None] + np.arange(size)
    fits = (offset <= np.minimum(left[row], shape.left)[:, None]) & (shape.length - offset <= right[row][:, None])
    fits &= (shape.length - offset + first[:, None]) // size <= shared[:, None]
    offset, row = offset[fits], np.repeat(row, size).reshape(-1, size)[fits]
    return row, offset, shape.length - offset


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(raw), raw.shape[1] + 1), np.uint64)
    np.cumsum(_BYTE[raw] * _POWER[: raw.shape[1]], axis=1, out=sums[:, 1:])
    return sums


def hashes_of(sums: np.ndarray, row: np.ndarray, before: np.ndarray, after: np.ndarray, shape: Shape) -> np.ndarray:
    """A 64-bit hash of the bytes from ``before`` the anchor to ``after``, each row."""
    return (sums[row, shape.left + after] - sums[row, shape.left - before]) * _BACK[shape.left - before]


def common(raw: np.ndarray, left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before the anchor, and from it, that contexts ``a`` and ``b`` share, each pair."""
    back, on = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(0, len(a), 1024):
        x, y = a[k : k + 1024], b[k : k + 1024]
        differ = np.ones((len(x), shape.width + 2), np.bool_)
        np.not_equal(raw[x], raw[y], out=differ[:, 1:-1])
        back[k : k + 1024] = np.argmax(differ[:, shape.left :: -1], axis=1)
        on[k : k + 1024] = np.argmax(differ[:, shape.left + 1 :], axis=1)
    return np.minimum(back, np.minimum(left[a], left[b])), np.minimum(on, np.minimum(right[a], right[b]))


def verified(raw: np.ndarray, left: np.ndarray, right: np.ndarray, row: np.ndarray, before: np.ndarray, after: np.ndarray, first: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether the bytes of each string are those of the string at the same place of context ``first``."""
    pair, at = np.unique(row.astype(np.int64) << 32 | first, return_inverse=True)
    back, on = common(raw, left, right, pair >> 32, pair & 0xFFFFFFFF, shape)
    return (before <= back[at]) & (after <= on[at])


def found_twice(raw: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, row: np.ndarray, before: np.ndarray, after: np.ndarray, shape: Shape):
    """The strings, of those given, that two contexts of a group have at the same place: met by hash, decided by their bytes."""
    new = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]  # strings of a context stand together
    met, row = row[new], np.cumsum(new) - 1
    raw, left, right = raw[met], left[met], right[met]
    key = mixed(hashes_of(prefix_sums(raw), row, before, after, shape) + group[met][row]) + mixed((before << 16 | after).astype(np.uint64))
    order = np.argsort(key)
    row, before, after, key = row[order], before[order], after[order], key[order]
    lead = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    begins = np.flatnonzero(lead)
    sizes = np.diff(np.append(begins, len(row)))
    lone = np.repeat(sizes == 1, sizes)
    first = np.repeat(np.minimum.reduceat(row, begins) if len(row) else row, sizes)  # the least: few pairs to compare
    other = row != first
    same = ~other
    same[other] = verified(raw, left, right, row[other], before[other], after[other], first[other], shape)
    twice = np.repeat(np.add.reduceat((same & other).astype(np.int64), begins) > 0, sizes) & same & ~lone if len(row) else same
    if not same.all():  # strings of equal hash and other bytes: told apart one by one
        odd, seen = np.flatnonzero(~same), {}
        for k in odd.tolist():
            seen.setdefault((int(key[k]), raw[row[k], shape.left - before[k] : shape.left + after[k]].tobytes()), []).append(k)
        for places in seen.values():
            twice[places] = len(places) > 1
    return met[row[twice]], before[twice], after[twice]


#: Contexts of one anchor that are compared pair by pair; of more, the strings are sorted by hash.
PAIRED = 6


def repeated(group: np.ndarray, left: np.ndarray, contexts: list[bytes], shape: Shape = SHAPE):
    """(context, from, to, of words): bytes relative to the anchor that strings found in two contexts of a group cover.

    Contexts of a group stand together.
    """
    sizes, raw = np.array([len(c) for c in contexts]), laid(contexts, left, shape)
    right = sizes - left
    row, block, shared = candidates(block_symbols(group, left, raw, sizes, shape), shape)
    own = row[np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]]
    begins = np.flatnonzero(np.concatenate([[True], group[own[1:]] != group[own[:-1]]])[: len(own)])
    count = np.repeat(np.diff(np.append(begins, len(own))), np.diff(np.append(begins, len(own))))
    few, out = own[count <= PAIRED], []
    for apart in range(1, PAIRED):
        a, b = few[:-apart], few[apart:]
        met = group[a] == group[b]
        a, b = a[met], b[met]
        back, on = common(raw, left, right, a, b, shape)
        long = back + on >= shape.length
        out += [(a[long], back[long], on[long]), (b[long], back[long], on[long])]
    many = ~np.isin(row, few)
    out.append(found_twice(raw, group, left, right, *strings_from(row[many], block[many], shared[many], left, right, shape), shape))
    out = [union_of(*(np.concatenate(x) for x in zip(*out)), shape)]
    if shape.words:
        order = np.array(sorted(range(len(contexts)), key=lambda k: (group[k], contexts[k][left[k] :])))
        out.append(union_of(*passages(raw, group, left, right, order, shape), shape))
    words = np.repeat(np.arange(len(out)) > 0, [len(x[0]) for x in out])
    return (*(np.concatenate(x) for x in zip(*out)), words)


def passages(raw: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, order: np.ndarray, shape: Shape):
    """(context, bytes before the anchor, bytes from it) of ``shape.words`` or more whole words that neighbours in ``order`` share."""
    a, b = order[:-1], order[1:]
    met = group[a] == group[b]
    a, b = a[met], b[met]
    back, on = common(raw, left, right, a, b, shape)
    long = back + on >= 2 * shape.words - 1
    a, b, back, on = a[long], b[long], back[long], on[long]
    out = []
    for k in range(0, len(a), 1024):
        x, y, low, high = a[k : k + 1024], b[k : k + 1024], (shape.left - back[k : k + 1024]).astype(np.int16), (shape.left + on[k : k + 1024]).astype(np.int16)
        column = np.arange(shape.width + 1, dtype=np.int16)
        # -1: not shared, 0: white space, 1: in a word
        kind = np.zeros((len(x), shape.width + 2), np.int8)
        shared = (column[None, :-1] >= low[:, None]) & (column[None, :-1] < high[:, None])
        kind[:, 1:-1] = np.where(shared, NONSPACE[raw[x]], np.int8(-1))
        # the texts' own ends are ends of words
        at = np.arange(len(x))
        begin, end = (shape.left - low == left[x]) & (left[x] == left[y]) & (left[x] < shape.left), (high - shape.left == right[x]) & (right[x] == right[y]) & (right[x] < shape.length)
        kind[:, 0] = kind[:, -1] = -1
        kind[at[begin], low[begin]] = kind[at[end], high[end] + 1] = 0
        starts, ends = (kind[:, 1:] == 1) & (kind[:, :-1] == 0), (kind[:, :-1] == 1) & (kind[:, 1:] == 0)
        first, last = np.argmax(starts, axis=1).astype(np.int16), (shape.width - np.argmax(ends[:, ::-1], axis=1)).astype(np.int16)
        between = (column >= first[:, None]) & (column <= last[:, None])
        enough = starts.any(1) & ends.any(1) & ((starts & between).sum(1) >= shape.words) & ((ends & between).sum(1) - (ends & (column <= first[:, None])).sum(1) >= shape.words)
        for own in (x, y):
            out.append((own[enough], shape.left - first[enough].astype(np.int64), last[enough].astype(np.int64) - shape.left))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def union_of(row: np.ndarray, before: np.ndarray, after: np.ndarray, shape: Shape):
    """Strings -> (context, from, to): what they cover, relative to the anchor; touching stretches are one."""
    size = 2 * shape.length
    begin, end = row * size + shape.left - before, row * size + shape.left + after
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])[: len(begin)])
    begin, end = begin[new], end[np.append(new[1:], len(end)) - 1] if len(new) else end
    return begin // size, begin % size - shape.left, end % size - shape.left


_STRETCHES = "array<struct<a:int,b:int,w:boolean>>"
_KEYED = "rid binary, pos bigint, h bigint, cx bigint"
_CONTEXT = pa.schema([("h", pa.int64()), ("cx", pa.int64()), ("copy", pa.int8()), ("left", pa.int16()), ("context", pa.binary())])
_CONTEXT_SQL = "h bigint, cx bigint, copy tinyint, left smallint, context binary"
_COVERED = f"h bigint, cx bigint, ab {_STRETCHES}"


def _raws(texts) -> list[np.ndarray]:
    return [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts]


def _anchor_rows(batches, shape: Shape):
    names = ["rid", "pos", "h", "cx"]
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            rids, raws = batch.column(0).slice(begin, 256), _raws(batch.column(1).slice(begin, 256).to_pylist())
            if shape.words:
                found = word_anchors(raws, shape.length, shape.gram, shape.words)
            else:
                found = ((np.full(len(at), k), at, h, cx) for k, raw in enumerate(raws) for at, h, cx in anchors(raw, shape.length, shape.gram))
            for of, at, h, cx, *_ in found:
                columns = [rids.take(pa.array(of)), pa.array(at), pa.array(h.view(np.int64)), pa.array(cx.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _joined(batches, rows: int = 1 << 15):
    """Small batches put together."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.concat_batches(held)
            held, count = [], 0
    if held:
        yield pa.concat_batches(held)


def _cut_out(batches, shape: Shape):
    """text, places of anchors (a list of structs) -> their contexts, some hundred at a time."""
    for batch in batches:
        texts, spots = batch.column(0), batch.column(1)
        begins, flat = spots.offsets.to_numpy(), spots.values
        pos = flat.field(0).to_numpy(zero_copy_only=False)
        rest = [flat.field(k) for k in range(1, 4)]
        for k in range(batch.num_rows):
            raw = (texts[k].as_py() or "").encode("utf-8", "surrogatepass")
            for low in range(int(begins[k]), int(begins[k + 1]), 1024):
                high = min(low + 1024, int(begins[k + 1]))
                at = pos[low:high]
                contexts = [raw[max(0, i - shape.left) : i + shape.length] for i in at.tolist()]
                columns = [*(r.slice(low, high - low) for r in rest), pa.array(np.minimum(at, shape.left).astype(np.int16)), pa.array(contexts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_CONTEXT)


def _gathered(batches, shape: Shape):
    """(h, cx, left, context) sorted by anchor -> what is repeated, some whole anchors at a time."""

    def solved(parts):
        batch = pa.concat_batches(parts)
        h, cx, left = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        row, a, b, w = repeated(h.view(np.uint64), left.astype(np.int64), batch.column(3).to_pylist(), shape)
        order = np.argsort(row, kind="stable")
        row, a, b, w = row[order], a[order], b[order], w[order]
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        own, ends = row[begins], np.append(begins, len(row)).astype(np.int32)
        stretches = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(w)], names=["a", "b", "w"])
        out = pa.RecordBatch.from_pydict({"h": pa.array(h[own]), "cx": pa.array(cx[own]), "ab": pa.ListArray.from_arrays(pa.array(ends), stretches)})
        # both copies of a context have the same answer
        return out.take(pa.array(np.unique(mixed(h[own].view(np.uint64)) + cx[own].view(np.uint64), return_index=True)[1]))

    held, count = [], 0
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(key)) + 1
        if held and len(key) and held[-1].column(0)[-1].as_py() != key[0]:
            edges = np.append(0, edges)
        last = 0
        for edge in edges.tolist():  # a key is never split
            if count + edge - last >= TOGETHER:
                part = batch.slice(last, edge - last)
                yield solved([*held, part] if part.num_rows else held)
                held, count, last = [], 0, edge
        if last < batch.num_rows:
            held.append(batch.slice(last))
            count += batch.num_rows - last
    if held:
        yield solved(held)


_ORDERED = _CONTEXT_SQL + f", ab {_STRETCHES}, shared binary"


def _neighbours(batches, shape: Shape):
    """Contexts of hot anchors in the order of suffixes -> what neighbours share.

    ``shared``: a bit for each number of bytes before the anchor, set where a string begins that one of
    the ``BEFORE`` contexts before has as well.
    """
    held, told = None, 0  # rows to compare with, and how many of them are told; the others wait for those after them
    span = np.arange(shape.left + 1)
    for batch in _with_end(batches):
        part = batch if held is None else held if batch is None else pa.concat_batches([held, batch])
        if part is None or (batch is not None and part.num_rows <= 2 * BEFORE):
            held = part
            continue
        h, left = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64), part.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        contexts, n = part.column(4).to_pylist(), part.num_rows
        right, raw = np.array([len(c) for c in contexts], np.int64) - left, laid(contexts, left, shape)
        shared, found = np.zeros((n, shape.left + 1), np.bool_), []
        for apart in range(1, min(BEFORE, n - 1) + 1):
            one, two = np.arange(n - apart), np.arange(apart, n)
            met = h[one] == h[two]
            one, two = one[met], two[met]
            back, on = common(raw, left, right, one, two, shape)
            long = back + on >= shape.length
            one, two, back, on = one[long], two[long], back[long], on[long]
            found += [(one, back, on), (two, back, on)]
            shared[two] |= (span >= shape.length - on[:, None]) & (span <= back[:, None])
        out = [union_of(*(np.concatenate(x) for x in zip(*found)), shape)] if found else [(np.zeros(0, np.int64),) * 3]
        if shape.words:
            out.append(union_of(*passages(raw, h, left, right, np.arange(n), shape), shape))
        words = np.repeat(np.arange(len(out)) > 0, [len(x[0]) for x in out])
        row, a, b = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
        stretches = pa.StructArray.from_arrays([pa.array(x[order].astype(t)) for x, t in ((a, np.int32), (b, np.int32), (words, np.bool_))], names=["a", "b", "w"])
        bits = pa.array([r.tobytes() for r in np.packbits(shared, axis=1)], pa.binary())
        done = part.append_column("ab", pa.ListArray.from_arrays(pa.array(ends), stretches)).append_column("shared", bits)
        upto = n if batch is None else n - BEFORE
        yield done.slice(told, upto - told)
        held, told = part.slice(max(0, n - 2 * BEFORE)), BEFORE


def _with_end(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            yield batch.slice(begin, 1024)
    yield None


def _cells(batches, shape: Shape, width: int, parent: int | None):
    """Contexts of hot anchors -> (key, h, cx, copy, cell): cells of ``width`` starts of the strings that the context before lacks.

    With ``parent`` only starts in the live cells of that width, which come as the last column.
    """
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            h, cx, copy, left = (part.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            shared = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(len(h), -1)
            contexts, left = part.column(4).to_pylist(), left.astype(np.int64)
            right = np.array([len(c) for c in contexts], np.int64) - left
            span = np.arange(shape.left + 1)
            open_ = (span <= left[:, None]) & (shape.length - span <= right[:, None])
            open_ &= np.unpackbits(shared, axis=1)[:, : shape.left + 1] == 0
            if parent:
                live = np.zeros((len(h), shape.left // parent + 1), np.bool_)
                cells = part.column(6)
                ends = cells.offsets.to_numpy()
                live[np.repeat(np.arange(len(h)), np.diff(ends)), cells.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]] = True
                open_ &= live[:, span // parent]
            places = np.arange(0, shape.left + 1, width)
            row, cell = np.nonzero(np.logical_or.reduceat(open_, places, axis=1))
            # all strings of a cell hold these bytes
            first, last = cell * width, np.minimum((cell + 1) * width - 1, shape.left)
            new = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
            sums = prefix_sums(laid([contexts[k] for k in row[new].tolist()], left[row[new]], shape))  # of contexts with a cell
            key = mixed(hashes_of(sums, np.cumsum(new) - 1, first, shape.length - last, shape) + h.view(np.uint64)[row]) + mixed(cell.astype(np.uint64))
            columns = [key.view(np.int64), h[row], cx[row], copy[row], cell.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "h", "cx", "copy", "cell"])


def _in_order(contexts: DataFrame) -> DataFrame:
    """Contexts in the order of suffixes from the anchor on (ties: of the bytes before it, read backwards), over ranges."""
    order = {"h": F.col("h"), "ahead": F.expr("substring(context, left + 1)"), "behind": F.expr("reverse(hex(substring(context, 1, left)))")}
    dealt = contexts.repartitionByRange(partitions(contexts), *order.values())
    # as columns: a sort makes what is an expression anew for each comparison
    return dealt.withColumns({c: order[c] for c in ("ahead", "behind")}).sortWithinPartitions(*order).select(*_CONTEXT.names)


def _hot(contexts: DataFrame, shape: Shape) -> DataFrame:
    """What is repeated (h, cx, ab) of contexts of hot anchors, none of which is one task."""
    spark, ordered = contexts.sparkSession, _in_order(contexts)
    ordered = stored(ordered.mapInArrow(partial(_neighbours, shape=shape), _ORDERED), "hot-order")
    settled(spark)
    own, parent, steps = ordered.select(*_CONTEXT.names, "shared"), None, []
    for width in CELLS:
        cells = own.mapInArrow(partial(_cells, shape=shape, width=width, parent=parent), "key bigint, h bigint, cx bigint, copy tinyint, cell int")
        cells = stored(cells, f"hot-cells-{width}")
        twice = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        live = stored(cells.join(twice, "key").groupBy("h", "cx", "copy").agg(F.collect_list("cell").alias("live")), f"hot-live-{width}", lookup=True)
        discard(cells)
        settled(spark)
        own, parent = ordered.join(live, ["h", "cx", "copy"]).select(*_CONTEXT.names, "shared", "live"), width
        steps.append(live)
    length = shape.length
    starts = map_rows(live.select("h", "cx", "live"), lambda: lambda h, cx, own: (h, cx, [(a, b, False) for a, b in _union([(-o, length - o) for o in own])]), _COVERED)
    found = ordered.select("h", "cx", "ab").filter("size(ab) > 0").unionByName(starts)
    found = stored(found.groupBy("h", "cx").agg(F.array_distinct(F.flatten(F.collect_list("ab"))).alias("ab")), "hot-repeats")
    discard(ordered, *steps)
    return found


def _rid(doc_id, text):
    """The same for rows of equal doc_id and text only."""
    lead = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(lead.cast("binary")))


def spans(docs: DataFrame, group: int = GROUP, shape: Shape = SHAPE) -> DataFrame:
    """(_rid, spots): for documents that lose bytes, the stretches (from, to, of words) that are covered around their anchors."""
    spark, width = docs.sparkSession, partitions(docs)
    keyed = docs.select(_rid(F.col("doc_id"), F.col("text")).alias("_rid"), "text")
    found = stored(keyed.mapInArrow(lambda x: _joined(_anchor_rows(x, shape)), _KEYED), "anchors")
    settled(spark)
    # anchors whose contexts differ; "m" counts their rows, which are no fewer than their contexts
    varied = found.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("cx").alias("least"), F.max("cx").alias("most"))
    varied = stored(varied.filter("least <> most").select("h", "m"), "varied")
    place = F.struct("rid", "pos")
    each = found.groupBy("h", "cx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"), F.max(place).alias("two"))
    each = stored(each.join(varied, "h", "left").filter("n > 1 or m > 1"), "contexts", lookup=True)
    discard(varied)
    settled(spark)
    hot = each.filter(f"m > {group}").groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    hot = stored(hot.filter(f"k > {group}").select("h"), "hot")

    def contexts(how: str) -> DataFrame:
        # what occurs twice comes from two places, so that the suffix array sees it twice
        copies = F.expr("if(n > 1, array(named_struct('at', one, 'copy', 0Y), named_struct('at', two, 'copy', 1Y)), array(named_struct('at', one, 'copy', 0Y)))")
        spots = each.join(hot, "h", how).select("h", "cx", F.explode(copies).alias("s"))
        spots = spots.select(F.col("s.at.rid").alias("_rid"), F.struct("s.at.pos", "h", "cx", "s.copy").alias("spot"))
        spots = spots.groupBy("_rid").agg(F.collect_list("spot").alias("spots"))
        return keyed.join(spots, "_rid").select("text", "spots").mapInArrow(partial(_cut_out, shape=shape), _CONTEXT_SQL)

    dealt = contexts("left_anti").select("h", "cx", "left", "context").repartition(width, "h").sortWithinPartitions("h")
    covered = stored(dealt.mapInArrow(partial(_gathered, shape=shape), _COVERED), "repeats")
    settled(spark)
    if hot.limit(1).count():
        covered = covered.unionByName(_hot(contexts("left_semi"), shape))
    discard(each, hot)
    place = F.transform("ab", lambda x: F.struct((F.col("pos") + x["a"]).alias("a"), (F.col("pos") + x["b"]).alias("b"), x["w"].alias("w")))
    met = found.join(covered, ["h", "cx"]).select(F.col("rid").alias("_rid"), place.alias("ab"))
    return met.groupBy("_rid").agg(F.flatten(F.collect_list("ab")).alias("spots"))


def _union(found) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def merged(spots: pa.ListArray, words: bool = False) -> list[list[tuple[int, int]]]:
    """Covered stretches of each text in order, touching ones joined; with ``words`` those of word strings as well."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(spots))]
    if not len(spots.values):
        return out
    begins, flat = spots.offsets.to_numpy(), spots.values
    a, b, w = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    row = np.repeat(np.arange(len(spots)), np.diff(begins))
    own = slice(int(begins[0]), int(begins[-1]))
    a, b, w = a[own].astype(np.int64), b[own].astype(np.int64), w[own].astype(np.bool_)
    if not words:
        row, a, b = row[~w], a[~w], b[~w]
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    size = int(b.max(initial=0)) + 2  # so that texts lie apart
    begin, end = row * size + a, np.maximum.accumulate(row * size + b)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])[: len(begin)])
    last = np.append(new[1:], len(end)) - 1 if len(new) else new
    for k, x, y in zip(row[new].tolist(), a[new].tolist(), (end[last] - row[last] * size).tolist()):
        out[k].append((x, y))
    return out


def kept(raw: bytes, stretches: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for ab in stretches for x in ab), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))


def report(docs: DataFrame, group: int = GROUP, shape: Shape = SHAPE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    With ``shape.words`` also passage_bytes and n_passages: bytes and maximal runs that strings of
    either kind cover.
    """
    more = shape.words is not None

    def reported(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                ids, texts, spots = batch.slice(low, 512).columns
                rows, every = [], merged(spots, True) if more else None
                for k, stretches in enumerate(merged(spots)):
                    raw = (texts[k].as_py() or "").encode("utf-8", "surrogatepass")
                    left = kept(raw, stretches)
                    row = len(raw), len(raw) - len(left), len(stretches), hashlib.sha256(left).hexdigest()
                    rows.append((*row, sum(b - a for a, b in every[k]), len(every[k])) if more else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                columns = [ids, *(pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_bytes", "n_passages"][: len(columns)])

    keyed = docs.select(_rid(F.col("doc_id"), F.col("text")).alias("_rid"), F.col("doc_id").cast("bigint"), "text")
    joined = keyed.join(spans(docs, group, shape), "_rid", "left").select("doc_id", "text", "spots")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.mapInArrow(reported, schema + ", passage_bytes bigint, n_passages bigint" * more)


def cut(docs: DataFrame, group: int = GROUP, shape: Shape = SHAPE) -> DataFrame:
    """``docs`` with the covered bytes cut out of ``text`` (``n_chars``, if there, follows); no row goes.

    A code point of which a byte is covered goes as a whole. Texts that lose nothing, nulls
    included, stay as they are.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.select("row", _rid(F.col("row.doc_id"), F.col("row.text")).alias("_rid"))
    joined = row.join(spans(docs, group, shape), "_rid", "left")

    @F.arrow_udf("string")
    def shorter(text: pa.Array, spots: pa.Array) -> pa.Array:
        both = zip(text, merged(spots))
        return pa.array([kept((t.as_py() or "").encode("utf-8", "surrogatepass"), s).decode("utf-8", "ignore") for t, s in both], pa.string())

    lost = F.col("spots").isNotNull()
    new = joined.select(joined["row"].alias("row"), lost.alias("lost"), F.when(lost, shorter(F.col("row.text"), F.col("spots"))).otherwise(F.col("row.text")).alias("new"))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("lost"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return new.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8(docs: DataFrame) -> DataFrame:
    """The contract's rows, and what passages of 50 words cover."""
    return report(docs, shape=PASSAGES)
