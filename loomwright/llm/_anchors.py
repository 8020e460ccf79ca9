"""Content-chosen anchors of byte strings, and hashes of what surrounds them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._words import _BACK, _BYTE, _POWER, mixed

#: Window starts looked at together.
PIECE = 1 << 15
_LOW = np.uint64((1 << 20) - 1)


def anchors(raw: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position, gram hash, context hash) of the anchor of every ``window``-byte string of ``raw``.

    The anchor of a window is its gram with the least hash (ties: the first), so equal windows
    have anchors at equal places. The context of an anchor is what lies in any window around its
    gram: ``window - gram`` bytes before it and ``window`` from its first byte, less at an end.
    """
    n, grams = len(raw), window - gram + 1
    last = -1
    for begin in range(0, n - window + 1, PIECE):
        starts = min(PIECE, n - window + 1 - begin)
        low, high = max(0, begin - grams), min(n, begin + starts + 2 * window)
        part = raw[low:high]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[: len(part)], out=sums[1:])
        a = begin - low
        count = starts + grams - 1
        value = (sums[a + gram : a + gram + count] - sums[a : a + count]) * _BACK[a : a + count]
        value = mixed(value)
        packed = (value & ~_LOW) | np.arange(count, dtype=np.uint64)
        blocks = -(-(count + grams) // grams)
        padded = np.full(blocks * grams, np.iinfo(np.uint64).max, np.uint64)
        padded[:count] = packed
        padded = padded.reshape(blocks, grams)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:starts], ahead[grams - 1 : grams - 1 + starts])
        at = (least[np.concatenate([[True], least[1:] != least[:-1]])] & _LOW).astype(np.int64)
        if begin + at[0] == last:
            at = at[1:]
        if len(at):
            last = begin + int(at[-1])
            left, right = np.minimum(begin + at, window - gram), np.minimum(n - begin - at, window)
            from_, to = a + at - left, a + at + right
            around = mixed((sums[to] - sums[from_]) * _BACK[from_] + (left * 4096 + right).astype(np.uint64))
            yield begin + at, value[at], around


#: Bytes of texts put together for one pass of ``word_anchors``; a longer text goes in overlapping pieces.
PACK = 1 << 15
#: A start is at a word's first byte, and at every byte this far into a run of one kind (word or white space).
FAR_IN = 32
NONSPACE = np.ones(256, np.bool_)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def _packs(raws: list[np.ndarray], length: int):
    """(bytes, text of each, first byte in its text, bytes from there, starts taken from, to): texts together, long ones in pieces."""
    held, size = [], 0
    for k, raw in enumerate(raws):
        if len(raw) > PACK:
            for begin in range(0, len(raw), PACK):
                low, high = max(0, begin - 2 * length), min(len(raw), begin + PACK + 3 * length)
                yield raw[low:high], [(k, low, high - low, high == len(raw))], begin - low, begin - low + PACK
            continue
        if size + len(raw) > PACK:
            yield np.concatenate([raws[i] for i, *_ in held]), held, 0, PACK
            held, size = [], 0
        if len(raw):
            held.append((k, 0, len(raw), True))
            size += len(raw)
    if held:
        yield np.concatenate([raws[i] for i, *_ in held]), held, 0, PACK


def word_anchors(raws: list[np.ndarray], length: int, gram: int, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, position, gram hash, context hash, bytes before, bytes from it) of the anchors of many texts.

    Every string of ``length`` bytes, and every string of ``words`` whole words of at most as many
    bytes, has an anchor: the gram of least hash (ties: the first) that begins at a start of its
    first window. A window goes from a start to the end of the ``words``-th word, or ``length - 64``
    bytes; it depends on the bytes in it only, so equal strings have anchors at equal places.
    """
    sizes = np.array([len(r) for r in raws], np.int64)
    done: dict[int, int] = {}  # of a text in pieces: its last anchor
    for raw, texts, low, high in _packs(raws, length):
        n = len(raw)
        begins = np.cumsum([0, *(t[2] for t in texts)])
        inside = NONSPACE[raw]
        change = np.ones(n + 1, np.bool_)
        change[1:-1] = inside[1:] != inside[:-1]
        change[begins] = True
        edge = np.flatnonzero(change)  # runs of one kind
        kind, run = inside[edge[:-1]], np.diff(edge)
        start = np.zeros(n, np.bool_)
        start[edge[:-1][kind]] = True
        for a, k in zip(edge[:-1][run > FAR_IN].tolist(), run[run > FAR_IN].tolist()):
            start[a + FAR_IN : a + k] = True
        starts, ends = np.flatnonzero(start), edge[1:][kind]
        of = np.searchsorted(begins, starts, "right") - 1
        whole = np.array([t[3] for t in texts])
        limit = np.where(whole, begins[1:], 1 << 40)[of]  # a piece that goes on has no end here
        last = np.searchsorted(ends, starts, "right") + words - 1
        until = np.minimum(np.where(last < len(ends), np.append(ends, 0)[np.minimum(last, len(ends))], 1 << 40), starts + length - 64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _POWER[:n], out=sums[1:])
        grams = starts[starts + gram <= n]
        value = mixed((sums[grams + gram] - sums[grams]) * _BACK[grams])
        packed = (value & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        fits = np.flatnonzero((until <= np.minimum(limit, n)) & (starts >= low) & (starts < high))
        if not len(fits):
            continue
        stop = np.searchsorted(grams, until[fits] - gram, "right")
        least, level, width = np.zeros(len(fits), np.uint64), packed, 1
        span = stop - fits
        while True:  # range minima by doubling: two stretches of a power of two cover a window
            own = (span >= width) & (span < 2 * width)
            a = fits[own]
            least[own] = np.minimum(level[a], level[stop[own] - width])
            if width * 2 > span.max():
                break
            level = np.minimum(level[: max(0, len(level) - width)], level[width:])
            width *= 2
        chosen = (least[np.concatenate([[True], least[1:] != least[:-1]])] & _LOW).astype(np.int64)
        at, of = grams[chosen], np.searchsorted(begins, grams[chosen], "right") - 1
        text, first = (np.array([t[k] for t in texts])[of] for k in (0, 1))
        place = at - begins[of] + first
        if len(texts) == 1:  # a piece may begin with the last anchor of the one before it
            fresh = place > done.get(texts[0][0], -1)
            at, text, place, chosen = at[fresh], text[fresh], place[fresh], chosen[fresh]
            if not len(at):
                continue
            done[texts[0][0]] = int(place[-1])
        left, right = np.minimum(place, length - gram), np.minimum(sizes[text] - place, length)
        around = mixed((sums[at + right] - sums[at - left]) * _BACK[at - left] + (left * 4096 + right).astype(np.uint64))
        yield text, place, value[chosen], around, left, right
