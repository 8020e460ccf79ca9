"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats; bit b is
set if bit b of XXH64(seed 42) is set in over half the shingles. The 64 bits are 8 blocks of 8.
Two fingerprints that differ in at most 2 bits differ in at most 2 blocks, so they share one of
the 28 keys that leave out 2 blocks. A key holds 2**16 different fingerprints at most, by
construction, however often their documents repeat; inside a key exact Hamming distances
decide, and each group of linked fingerprints leaves as a star, never as all its pairs.

Null and empty texts have fingerprint zero and are linked like any other. Very long texts are
read whole, a piece of shingles at a time. Equal texts, repeated rows among them, share a
fingerprint; a bit that is set in exactly half the shingles (a tie) is 0. A null doc_id is never
the least of a component unless all ids in it are null. An empty table has no rows. Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..functions.storage import stored
from ._common import map_rows

BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 2
#: Shingles hashed and counted together; memory does not follow a text's length beyond its words.
PIECE = 1 << 15
#: 16-bit differences of one or two bits.
_NEAR = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)])


def fingerprint(text: str | None) -> int:
    """64 bits as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    total, ones = len(words) - 2, np.zeros(64, np.int64)
    for begin in range(0, total, PIECE):
        part = words[begin : begin + PIECE + 2]
        shingles = map(b" ".join, zip(part, part[1:], part[2:]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(part) - 2)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row, over whole texts."""

    def make():
        def one(doc_id, text):
            fp = fingerprint(text)
            return doc_id, fp - (1 << 64) if fp >> 63 else fp

        return one

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), make, "doc_id bigint, fp bigint")


def stars(codes: np.ndarray) -> np.ndarray:
    """For fingerprints (uint64) that differ in 16 fixed bits at most: the index of each one's group's first.

    Groups are linked at ``RADIUS`` or fewer bits; time and memory are linear in the number.
    """
    n = len(codes)
    if n <= 64:
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= RADIUS
        label = np.arange(n)
        while True:
            new = np.where(near, label[None, :], n).min(1)
            if (new == label).all():
                return label
            label = new
    spread = np.bitwise_or.reduce(codes ^ codes[0])
    varying = [b for b in range(64) if int(spread) >> b & 1]
    short = np.zeros(n, np.int64)
    for to, b in enumerate(varying):
        short |= ((codes >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << to
    at = np.full(1 << 16, -1, np.int32)
    at[short] = np.arange(n)
    label = np.arange(n)
    while True:
        new = label.copy()
        for d in _NEAR:
            other = at[short ^ d]
            met = other >= 0
            np.minimum.at(new, np.flatnonzero(met), label[other[met]])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def links(prints: DataFrame) -> DataFrame:
    """(u, v) links between different fingerprints of ``prints`` (column fp, distinct rows).

    The components of the links are those of all pairs at distance ``RADIUS`` or less.
    """
    width = (1 << BLOCK_BITS) - 1
    masks = [~(width << BLOCK_BITS * i | width << BLOCK_BITS * j) & (1 << 64) - 1 for i, j in combinations(range(BLOCKS), 2)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for k, m in enumerate(masks)])
    groups = (
        prints.select("fp", F.explode(keys).alias("x")).groupBy("x.k", "x.key")
        .agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    )

    def linked(batches):
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            u, v = [], []
            for a, b in zip(ends, ends[1:]):
                own = np.sort(flat[a:b])
                root = stars(own.view(np.uint64))
                far = np.flatnonzero(root != np.arange(len(own)))
                u.append(own[far])
                v.append(own[root[far]])
            yield pa.RecordBatch.from_pydict(
                {"u": np.concatenate(u) if u else np.zeros(0, np.int64), "v": np.concatenate(v) if v else np.zeros(0, np.int64)}
            )

    return groups.mapInArrow(linked, "u bigint, v bigint")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (least doc_id that links reach) of every row of ``docs``."""
    prints = stored(fingerprints(docs), "simhash")
    each = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-each")
    roots = components(links(each.select("fp")))
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("first").alias("component_id"))
    rooted = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(rooted, "fp").select("doc_id", "fp", "component_id")


def op9(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint (16 hex digits), component_id."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least doc_id; all columns stay.

    Rows without a doc_id cannot stand for a class and are kept. Of several rows with the kept
    doc_id one stays.
    """
    found = stored(classes(docs).select("doc_id", "component_id"), "simhash-classes")
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeated:
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
    return kept
