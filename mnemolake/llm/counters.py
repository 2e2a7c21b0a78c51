"""Counting by slot: numpy count arrays made by each task and summed as a tree, and minimal perfect hashes that give the slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of one row of a count array, and the branches that a chunk's arrays are first summed in.
CHUNK, BRANCHES = 1 << 16, 16


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit keys for each seed."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, with the keys stored by slot so that other keys are told apart.

    Keys are thrown at a bit table of GAMMA bits a key; those that lie alone get their bit, the others go on to the next
    table. A key's slot is the number of set bits before its own. What is left after LEVELS tables is kept as a sorted list.
    """

    GAMMA, LEVELS = 1.6, 32

    def __init__(self, keys: np.ndarray):
        rest, base = np.ascontiguousarray(keys).view(np.uint64), 0
        self.size, self.tables, self.keys = len(rest), [], np.zeros(len(rest), np.uint64)
        for level in range(self.LEVELS):
            if not len(rest):
                break
            m = 64 * int(np.ceil(self.GAMMA * len(rest) / 64))
            at = (mixed(rest, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            before = base + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]])
            self.tables.append((m, bits, before))
            won = alone[at]
            self.keys[self._rank(bits, before, at[won])] = rest[won]
            base, rest = base + int(won.sum()), rest[~won]
        self.last = base
        self.keys[base:] = np.sort(rest)

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(bits[word] & below)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that are none of ours."""
        keys = np.ascontiguousarray(keys).view(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, bits, before) in enumerate(self.tables):
            if not len(todo):
                return out
            at = (mixed(keys[todo], level) % np.uint64(m)).astype(np.int64)
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            slot, here = self._rank(bits, before, at[hit]), todo[hit]
            same = self.keys[slot] == keys[here]
            out[here[same]] = slot[same]
            todo = todo[~hit]  # a key whose bit is set in a table would have stopped there, so it is none of ours
        if len(todo) and self.last < self.size:
            tail = self.keys[self.last :]
            at = np.minimum(np.searchsorted(tail, keys[todo]), len(tail) - 1)
            same = tail[at] == keys[todo]
            out[todo[same]] = self.last + at[same]
        return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the arrays of each chunk; rows (chunk, salt, counts) come sorted by chunk."""
    at, total = None, None

    def row():
        return pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    for b in batches:
        for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
            if chunk != at:
                if at is not None:
                    yield row()
                at, total = chunk, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(blob, f"u{len(blob) // CHUNK}").astype(np.int64)
    if at is not None:
        yield row()


def counted_slots(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], size: int) -> DataFrame:
    """(chunk, counts): how often each of `size` slots comes up. make() gives a task's function from a batch to an array of slots.

    Each task adds its batches up in one array and sends its chunks in the narrowest type that holds them; chunks are
    summed in BRANCHES branches first, then over these.
    """
    fields = "chunk int, salt int, counts binary"

    def run(batches):
        fn, total = make(), np.zeros(-(-max(size, 1) // CHUNK) * CHUNK, np.int64)
        for b in batches:
            slots = fn(b)
            if len(slots):
                part = np.bincount(slots)
                total[: len(part)] += part
        for chunk in range(len(total) // CHUNK):
            part = total[chunk * CHUNK : (chunk + 1) * CHUNK]
            if part.any():
                blob = part.astype(np.min_scalar_type(int(part.max()))).tobytes()
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([blob], pa.binary())})

    part = df.mapInArrow(run, fields).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(BRANCHES)))
    part = part.repartition("chunk", "salt").sortWithinPartitions("chunk").mapInArrow(_added, fields)
    return part.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_added, fields).select("chunk", "counts")


def slot_rows(counts: DataFrame) -> DataFrame:
    """(slot, n) of the slots that came up."""

    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(blob, np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"slot": pa.array(at + chunk * CHUNK), "n": pa.array(n[at])})

    return counts.mapInArrow(run, "slot long, n long")


def slot_array(counts: DataFrame, size: int) -> np.ndarray:
    """The counts as one array on the driver; `size` is the caller's bound."""
    out = np.zeros(-(-max(size, 1) // CHUNK) * CHUNK, np.int64)
    for r in counts.toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return out[:size]
