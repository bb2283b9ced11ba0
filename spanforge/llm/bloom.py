"""A Bloom filter of a bounded size, built by the executors. What it lets through beside its keys is only extra work."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64

SEGMENTS = 16


def places(keys: np.ndarray, log_bits: int) -> list[np.ndarray]:
    """Three bit numbers for each uint64 key."""
    return [(mix64(keys, s) >> np.uint64(64 - log_bits)).astype(np.int64) for s in (101, 102, 103)]


def _partial(log_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << log_bits, bool)
        for b in batches:
            for p in places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), log_bits):
                bits[p] = True
        rows = [(i, zlib.compress(np.packbits(x).tobytes(), 1)) for i, x in enumerate(np.split(bits, SEGMENTS)) if x.any()]
        if rows:
            s, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(x, pa.binary())], ["segment", "bits"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    out = None
    for x in table["bits"].to_pylist():
        x = np.frombuffer(zlib.decompress(x), np.uint8)
        out = x if out is None else out | x
    return pa.table({"segment": pa.array([table["segment"][0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})


def bloom(keys: DataFrame, log_bits: int = 24) -> bytes:
    """The filter of a long column: 2**log_bits bits, packed and compressed; its size doesn't grow with the keys."""
    rows = keys.mapInArrow(_partial(log_bits), "segment long, bits binary").groupBy("segment").applyInArrow(_merge, "segment long, bits binary").collect()
    out = np.zeros((SEGMENTS, (1 << log_bits) // 8 // SEGMENTS), np.uint8)
    for r in rows:
        out[r["segment"]] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return zlib.compress(out.tobytes(), 1)


class Bloom:
    def __init__(self, packed: bytes):
        self.bits = np.frombuffer(zlib.decompress(packed), np.uint8)
        self.log_bits = (len(self.bits) * 8).bit_length() - 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in places(keys, self.log_bits):
            out &= (self.bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return out
