"""A Bloom filter of what occurs at least twice, built in one pass over 64-bit hashes.

Two bit planes stand for counters that saturate at two: a slot of the first is set by one row, a slot of
the second once a further row meets it.  Every task fills sparse planes for its own rows; the planes of one
segment of slots then meet in one task, in any order, and only the second plane is kept.  A hash that occurs
twice has all of its slots in that plane, so the filter never misses one; a hash that occurs once is let
through with a small chance only.

The filter's size follows the number of rows up to ``MAX_BITS``.  That bounds what is broadcast.  Beyond
about MAX_BITS / BITS_PER_ROW rows it grows fuller and names more rows than need be, never fewer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.runtime import shuffle_partitions

BITS_PER_ROW = 16
SEGMENT = 1 << 16
MAX_BITS = 1 << 29  # 64 MB
SCHEMA = "segment int, once binary, twice binary"


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    mask = np.uint64(bits - 1)
    return u & mask, (u >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask


def filter_bits(rows: int) -> int:
    """A power of two, MAX_BITS at most."""
    return min(MAX_BITS, max(SEGMENT, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length()))


def repeated_filter(hashes: DataFrame, column: str, bits: int) -> dict[int, bytes]:
    """The second plane over the longs in ``column``: segments of packed bits, those with any bit set."""

    def fill(batches):
        parts, held = [], 0
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            parts.append(h)
            held += len(h)
            if held >= 2_000_000:
                yield from emit(np.concatenate(parts))
                parts, held = [], 0
        if held:
            yield from emit(np.concatenate(parts))

    def emit(h):
        slots, counts = np.unique(np.concatenate(_slots(h, bits)), return_counts=True)
        segments = (slots // np.uint64(SEGMENT)).astype(np.int32)
        inner = (slots % np.uint64(SEGMENT)).astype(np.uint16)
        starts = np.flatnonzero(np.diff(segments, prepend=-1))
        ends = np.append(starts[1:], len(slots))
        once = [inner[a:z].tobytes() for a, z in zip(starts, ends)]
        twice = [inner[a:z][counts[a:z] > 1].tobytes() for a, z in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(segments[starts]), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])

    def merge(batches):
        now, one, two = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(two, bitorder="little").tobytes()], pa.binary())], ["segment", "plane"])

        for b in batches:
            for segment, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                if segment != now:
                    if now is not None and two.any():
                        yield done()
                    now, one, two = segment, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
                own = np.frombuffer(once, np.uint16)
                two[np.frombuffer(twice, np.uint16)] = True
                two[own[one[own]]] = True
                one[own] = True
        if now is not None and two.any():
            yield done()

    planes = hashes.select(column).mapInArrow(fill, SCHEMA)
    planes = planes.repartition(shuffle_partitions(hashes.sparkSession), "segment").sortWithinPartitions("segment")
    return {r.segment: bytes(r.plane) for r in planes.mapInArrow(merge, "segment int, plane binary").collect()}


class RepeatedFilter:
    """The filter as executors use it."""

    def __init__(self, planes: dict[int, bytes], bits: int):
        self.bits = bits
        self.plane = np.zeros(bits // 8, np.uint8)
        for segment, plane in planes.items():
            at = segment * SEGMENT // 8
            self.plane[at : at + SEGMENT // 8] = np.frombuffer(plane, np.uint8)

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """True where a hash possibly occurs twice."""
        a, b = (self.plane[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1 for s in _slots(h, self.bits))
        return (a & b).astype(bool)
