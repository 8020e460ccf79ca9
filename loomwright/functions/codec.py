"""Posting lists as bytes: document gaps and term counts in Hadoop's public variable-length format."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POSTINGS = "array<struct<docid:bigint,tf:int>>"


def vint(value: int) -> bytes:
    """One byte for -112 to 127; else a header byte (sign, length) and the magnitude, big end first."""
    if -112 <= value <= 127:
        return bytes([value & 0xFF])
    header, magnitude = (-112, value) if value >= 0 else (-120, ~value)
    size = (magnitude.bit_length() + 7) // 8
    return bytes([(header - size) & 0xFF]) + magnitude.to_bytes(size, "big")


def read_vint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position)"""
    first = data[at] - 256 if data[at] > 127 else data[at]
    if first >= -112:
        return first, at + 1
    negative = first < -120
    size = -120 - first if negative else -112 - first
    magnitude = int.from_bytes(data[at + 1 : at + 1 + size], "big")
    return (~magnitude if negative else magnitude), at + 1 + size


def encode(postings) -> bytes:
    """[(docid, tf)] in ascending docid order -> bytes: gap, tf, gap, tf, ..."""
    out, last = bytearray(), 0
    for docid, tf in postings:
        out += vint(docid - last) + vint(tf)
        last = docid
    return bytes(out)


def decode(data: bytes) -> list[tuple[int, int]]:
    out, at, docid = [], 0, 0
    while at < len(data):
        gap, at = read_vint(data, at)
        tf, at = read_vint(data, at)
        docid += gap
        out.append((docid, tf))
    return out


def vints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values one after the other (uint8), and where each begins (one more at the end)."""
    values = values.astype(np.int64)
    short, negative = (values >= -112) & (values <= 127), values < 0
    magnitude = np.where(negative, ~values, values).view(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 8):
        size += magnitude >= np.uint64(1 << 8 * k)
    begins = np.concatenate([[0], np.cumsum(np.where(short, 1, 1 + size))])
    out = np.zeros(int(begins[-1]), np.uint8)
    out[begins[:-1]] = np.where(short, values, np.where(negative, -120, -112) - size).astype(np.uint8)
    for k in range(8):  # the k-th byte from the end
        own = np.flatnonzero(~short & (size > k))
        out[begins[own + 1] - 1 - k] = (magnitude[own] >> np.uint64(8 * k)).astype(np.uint8)
    return out, begins


def read_vints(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of byte strings laid end to end, and how many of them come before each of ``begins``."""
    first = data.view(np.int8).astype(np.int64)
    length = np.where(first >= -112, 1, np.where(first < -120, -119 - first, -111 - first))
    n = len(data)
    jump, reached = np.minimum(np.arange(n) + length, n), np.zeros(n + 1, np.bool_)
    reached[begins[begins < n]] = True
    jump = np.append(jump, n)
    for _ in range(max(1, n.bit_length())):  # heads reached in 1, 2, 4, ... values
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    at = np.flatnonzero(reached[:n])
    head, size = first[at], length[at] - 1
    magnitude = np.zeros(len(at), np.uint64)
    for k in range(8):
        own = size > k
        magnitude[own] = magnitude[own] << np.uint64(8) | data[at[own] + 1 + k].astype(np.uint64)
    values = np.where(size == 0, head, np.where(head < -120, ~magnitude.view(np.int64), magnitude.view(np.int64)))
    return values, np.searchsorted(at, begins)


def encoded(postings: str | Column) -> Column:
    """Arrow function: sorted postings -> bytes; a batch is encoded as one array."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        flat, ends = rows.flatten(), rows.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        docid, tf = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        gap = np.diff(docid, prepend=0)
        first = ends[:-1][np.diff(ends) > 0]
        gap[first] = docid[first]
        data, begins = vints(np.stack([gap, tf], axis=1).ravel())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(begins[2 * ends]), pa.py_buffer(data)]).cast(pa.binary())

    return run(postings)


def decoded(data: str | Column) -> Column:
    """Arrow function: bytes -> postings; a batch is decoded as one array."""

    @F.arrow_udf(POSTINGS)
    def run(rows: pa.Array) -> pa.Array:
        rows = rows.cast(pa.large_binary())
        ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        raw = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        values, before = read_vints(raw, ends - ends[0])
        gap, tf, begins = values[::2], values[1::2], before // 2
        total = np.cumsum(gap)
        start = np.repeat(np.where(begins[:-1] > 0, total[np.maximum(begins[:-1] - 1, 0)] if len(total) else 0, 0), np.diff(begins))
        posts = pa.StructArray.from_arrays([pa.array(total - start), pa.array(tf.astype(np.int32))], names=["docid", "tf"])
        return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), posts)

    return run(data)


def vint_length(value: Column) -> Column:
    """Bytes that ``vint`` needs for a non-negative value, as an expression."""
    size = F.when(value <= 127, 1)
    for count, limit in enumerate((8, 16, 24, 32, 40, 48, 56), 2):
        size = size.when(value < (1 << limit), count)
    return size.otherwise(9)
