"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Words are lower-cased runs of letters and digits. For each length L of a benchmark item every
window of L words of a document that can still reach the threshold is fingerprinted (64-bit
SimHash over its words); a document of fewer than L words is one window as a whole.
Fingerprints are split into 5 blocks of 13 or 12 bits; two within ``RADIUS`` differ by at most
``RADIUS // 5`` bits in some block, so tables of the items by block value (all values within that
many bits) return every item within the radius. Candidates are then verified: the similarity of
window and item is the weighted Dice coefficient of their 5-word shingles, repeats counted, a
shingle's weight ln(1 + items / items that hold it); a match needs ``THRESHOLD`` or more.

Windows that cannot pass are skipped without loss: a match needs two thirds of the item's
weight in shingles that the benchmark knows. An item of 1 to 4 words is one shingle as a whole
and matches where its words stand in a row. Items without a word and null items are ignored;
documents that are null or empty match nothing. Items are taken in blocks of at most about
``ITEMS`` and ``ITEM_BYTES`` (one scan of the documents for each); a block is sent out, used and
dropped before the next, so neither driver nor executors hold the whole benchmark. Weights are
those of the whole benchmark in every block.

Very long texts are read whole. Of equally similar windows (ties) the first is reported; repeated
rows are judged each, repeated items of one id as one id. Empty tables on either side match
nothing. ``clean`` passes other columns on, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from ._words import shingles, word_hashes, word_hashes_of

SIZE, THRESHOLD = 5, 0.8
#: Bits of the blocks of a fingerprint; recall on changed passages is measured in the tests.
WIDTHS, RADIUS = (13, 13, 13, 13, 12), 19
#: Items, and bytes of their texts, in one pass over the documents.
ITEMS, ITEM_BYTES = 10_000, 1 << 26
#: Windows fingerprinted together.
TOGETHER = 4096


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Votes (+1, -1) of each 64-bit hash, one row each."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.int32) * 2 - 1


def _packed(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _blocks_of(prints: np.ndarray) -> list[np.ndarray]:
    """The value of each block of fingerprints."""
    out, at = [], 64
    for width in WIDTHS:
        at -= width
        out.append((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
    return out


#: Differences of a block that one within the radius has in some block.
_MASKS = {w: np.array([sum(1 << x for x in c) for k in range(RADIUS // len(WIDTHS) + 1) for c in combinations(range(w), k)]) for w in set(WIDTHS)}


class Length:
    """The items of one length, with their block tables."""

    def __init__(self, items: list):
        self.items = items
        self.prints = np.concatenate([_packed(_bits(i["words"]).sum(0, keepdims=True)) for i in items])
        self.least = min(i["weight"] for i in items)
        self.tables = []
        for width, values in zip(WIDTHS, _blocks_of(self.prints)):
            masks = _MASKS[width]
            table = np.zeros((1 << width, -(-len(items) // 8)), np.uint8)
            for at, value in enumerate(values.tolist()):
                table[masks ^ value, at >> 3] |= np.uint8(128 >> (at & 7))
            self.tables.append(table)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        met = np.zeros((len(prints), self.tables[0].shape[1]), np.uint8)
        for table, values in zip(self.tables, _blocks_of(prints)):
            met |= table[values]
        window, item = np.nonzero(np.unpackbits(met, axis=1)[:, : len(self.items)])
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]


class Index:
    """Benchmark items ready for matching.

    Where ``rows`` are a part of the benchmark, ``whole`` has the number of all its items and, for each
    shingle of the part (in order), of those that hold it.
    """

    def __init__(self, rows: list[tuple[int, str]], whole: tuple[int, np.ndarray] | None = None):
        items, self.short = [], {}
        for item_id, text in rows:
            words = word_hashes(text)
            if len(words) >= SIZE:
                items.append({"id": item_id, "words": words, "shingles": shingles(words, SIZE)})
            elif len(words):  # one shingle: its hash -> the ids
                self.short.setdefault(len(words), {}).setdefault(int(shingles(words, len(words))[0]), set()).add(item_id)
        self.short = {n: (np.array(sorted(x), np.uint64), x) for n, x in self.short.items()}
        each = [np.unique(i["shingles"]) for i in items]
        self.known, spread = np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_counts=True)
        total, spread = whole or (len(items), spread)
        self.weights, self.rare = np.log1p(total / spread), float(np.log1p(total))
        self.shift = np.uint64(64 - max(16, int(np.ceil(np.log2(16 * max(1, len(self.known)))))))
        self.seen = np.zeros(1 << int(64 - self.shift), np.bool_)
        self.seen[self.known >> self.shift] = True
        by: dict[int, list] = {}
        for i in items:
            i["own"], i["count"] = np.unique(i["shingles"], return_counts=True)
            i["weight"] = float(self.weigh(i["shingles"]).sum())
            by.setdefault(len(i["words"]), []).append(i)
        self.lengths = {n: Length(x) for n, x in sorted(by.items())}

    def weigh(self, some: np.ndarray) -> np.ndarray:
        """Weights of shingles; what no item holds weighs most."""
        if not len(self.known):
            return np.full(len(some), self.rare)
        at = np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)
        return np.where(self.known[at] == some, self.weights[at], self.rare)

    def matches(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """item id -> (similarity, first word, words) of its best window (ties: the first)."""
        return self.matches_of([text])[0]

    def matches_of(self, texts: list[str | None]) -> list[dict[int, tuple[float, int, int]]]:
        """``matches`` of each text; the texts' words are hashed together."""
        best: list[dict] = [{} for _ in texts]
        words, begins = word_hashes_of(texts)
        for n, (hashes, ids) in self.short.items():
            runs = shingles(words, n)
            for at in np.flatnonzero(np.isin(runs, hashes)).tolist():
                k = int(np.searchsorted(begins, at, "right")) - 1
                if at + n <= begins[k + 1]:  # of one text
                    for item in ids[int(runs[at])]:
                        best[k].setdefault(item, (1.0, at - int(begins[k]), n))
        own = shingles(words, SIZE)
        hits = np.flatnonzero(self.seen[own >> self.shift])
        if not len(hits) or not len(self.known):
            return best
        at = np.minimum(np.searchsorted(self.known, own[hits]), len(self.known) - 1)
        of = np.searchsorted(begins, hits, "right") - 1
        right = (self.known[at] == own[hits]) & (hits + SIZE <= begins[of + 1])  # of one text
        hits, gains, of = hits[right], self.weights[at[right]], of[right]
        # stretches of a text around hits; no window with a hit leaves its stretch
        longest = max(self.lengths)
        cuts = np.flatnonzero((np.diff(hits) >= longest) | (np.diff(of) > 0)) + 1
        for group, gain in zip(np.split(hits, cuts), np.split(gains, cuts)):
            if len(group):
                k = int(np.searchsorted(begins, group[0], "right")) - 1
                a, b = int(begins[k]), int(begins[k + 1])
                self._stretch(words[a:b], own[a : max(a, b - SIZE + 1)], group - a, gain, longest, best[k])
        return best

    def _stretch(self, words, own, hits, gain, longest, best) -> None:
        low, high = max(0, int(hits[0]) - longest), min(len(words), int(hits[-1]) + longest + SIZE)
        gained = np.zeros(high - low + 1)
        gained[hits - low + 1] = gain
        gained = np.cumsum(gained)
        local = own[low : min(high, len(own))]
        total = np.concatenate([[0.0], np.cumsum(self.weigh(local))])
        for n, length in self.lengths.items():
            size = min(n, len(words))  # a text shorter than the item is one window
            starts = np.arange(0, high - low - size + 1)
            span = size - SIZE + 1
            starts = starts[gained[starts + span] - gained[starts] >= THRESHOLD / (2 - THRESHOLD) * length.least - 1e-9]
            for begin in range(0, len(starts), TOGETHER):
                part = starts[begin : begin + TOGETHER]
                a, b = int(part[0]), int(part[-1]) + size
                votes = np.zeros((b - a + 1, 64), np.int32)
                np.cumsum(_bits(words[low + a : low + b]), axis=0, out=votes[1:])
                window, item = length.near(_packed(votes[part - a + size] - votes[part - a]))
                for i in np.unique(item).tolist():
                    self._verify(own, local, total, low, part[window[item == i]], size, length.items[i], best)

    def _verify(self, own, local, total, low, starts, n, item, best) -> None:
        """Exact similarity of candidate windows, those first that can be most similar."""
        span = n - SIZE + 1
        at = np.minimum(np.searchsorted(item["own"], local), len(item["own"]) - 1)
        shared = np.concatenate([[0.0], np.cumsum(np.where(item["own"][at] == local, np.diff(total), 0.0))])
        most = 2 * (shared[starts + span] - shared[starts]) / (total[starts + span] - total[starts] + item["weight"])
        for k in np.lexsort((starts, -most)).tolist():
            known = best.get(item["id"], (0.0,))[0]
            if most[k] < max(THRESHOLD, known) - 1e-9:
                break
            start = low + int(starts[k])
            sim = self.similarity(own[start : start + span], item)
            if sim >= THRESHOLD - 1e-12 and sim > known + 1e-12:
                best[item["id"]] = (sim, start, n)

    def similarity(self, window: np.ndarray, item: dict) -> float:
        """Weighted Dice coefficient of the shingles, repeats counted."""
        own, count = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(item["own"], own), len(item["own"]) - 1)
        both = np.where(item["own"][at] == own, np.minimum(count, item["count"][at]), 0)
        weight = self.weigh(own)
        return float(2 * (both * weight).sum() / ((count * weight).sum() + item["weight"]))


def _holders(rows: DataFrame, part) -> tuple[int, DataFrame]:
    """The number of items of ``SIZE`` words or more, and (part, shingle, n): of each part's shingles the items of all parts that hold them."""

    def own(batches):
        for batch in batches:
            for k, text in zip(*(c.to_pylist() for c in batch.columns)):
                each = np.unique(shingles(word_hashes(text), SIZE)).view(np.int64)
                first = np.arange(len(each)) == 0  # counts the item
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(each), k, np.int64)), "shingle": pa.array(each), "first": pa.array(first)})

    held = stored(rows.select(part.alias("part"), "text").mapInArrow(own, "part bigint, shingle bigint, first boolean"), "held")
    spread = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    return held.filter("first").count(), stored(held.select("part", "shingle").distinct().join(spread, "shingle"), "holders")


def _shares(benchmark: DataFrame, items: int):
    """Blocks of about ``items`` items and ``ITEM_BYTES`` at most, one after the other, with the whole benchmark's counts; an id is in one block."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text")
    total, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-total // items), -(-size // ITEM_BYTES))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    counted, holders = _holders(rows, part) if parts > 1 else (0, None)
    for k in range(parts):
        # a hash share may be a little over ``items``; it is bounded all the same
        own, whole = rows if parts == 1 else rows.filter(part == k), None
        if parts > 1:
            found = holders.filter(F.col("part") == k).select("shingle", "n").toArrow()
            known, n = (found.column(c).to_numpy() for c in ("shingle", "n"))
            whole = counted, n[np.argsort(known.view(np.uint64))].astype(np.int64).tobytes()
        yield k + 1 == parts, (sorted((r.item_id, r.text) for r in own.collect()), whole)


_LAST: list = [None, None]


def _index(block) -> Index:
    """The index of a broadcast block, built once in a worker process."""
    if _LAST[0] != block.value:
        rows, whole = block.value
        _LAST[:] = [block.value, Index(rows, whole and (whole[0], np.frombuffer(whole[1], np.int64)))]
    return _LAST[1]


def _each(index: Index, texts: pa.Array):
    """Matches of each text, a few texts of about ``TOGETHER`` * 16 characters at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py())
        size += len(some[-1] or "")
        if size >= 16 * TOGETHER:
            yield from index.matches_of(some)
            some, size = [], 0
    if some:
        yield from index.matches_of(some)


def matches(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of each pair that matches."""
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int32())])

    def search(rows):
        def run(batches):
            index = _index(rows)
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for k, met in enumerate(_each(index, batch.column(1))):
                    out += [(ids[k], i, *m) for i, m in met.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kind)], schema=kind)

        return run

    some, found, context = docs.select(F.col("doc_id").cast("bigint"), "text"), [], docs.sparkSession.sparkContext
    for last, block in _shares(benchmark, items):
        rows = context.broadcast(block)
        met = some.mapInArrow(search(rows), "doc_id bigint, item_id bigint, similarity double, start_word bigint, n_words int")
        if not last:  # its rows are written, so the block can go before the next comes
            met = stored(met, "matches")
            rows.destroy()
        found.append(met)
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """``docs`` without the rows that match an item; no row moves between executors."""
    for last, block in _shares(benchmark, items):
        rows = docs.sparkSession.sparkContext.broadcast(block)

        def make(rows=rows):
            @F.arrow_udf("boolean")
            def leaks(text: pa.Array) -> pa.Array:
                index = _index(rows)
                return pa.array([bool(met) for met in _each(index, text)], pa.bool_())

            return leaks

        docs = docs.filter(~make()(F.col("text")))
        if not last:
            docs = stored(docs, "cleaned")
            rows.destroy()
    return docs


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every pair of a document and an item of the whole benchmark that it leaks."""
    return matches(docs, benchmark)
