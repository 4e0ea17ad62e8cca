"""Operator 2: best-fit packing of documents into sequences of a fixed capacity.

A bin packing depends only on how many pieces there are of each length, and lengths run
from 1 to the capacity. So the packing is solved on that histogram (at most ``capacity``
numbers, however large the corpus), with runs of equal placements instead of single ones:

* large items (above one third of the capacity) share a bin at most two at a time; from the
  longest down, each is matched with the longest partner that still fits;
* smaller items, from the longest down, go into the smallest gap that holds them, else into
  a new bin.

Every placement is a run "pieces of this length with ranks [a, a+n) go to bins [b, b+n) at
this offset". A piece finds its run by its rank among the pieces of its length: its rank
within its task plus the count of that length in earlier tasks. So a length that a third of
all rows share is still ranked in parallel, and no group is gathered anywhere. The token
pass is written once, since the ranks must not change between the passes.

Longer documents are cut into pieces of exactly the capacity; the first piece takes the rest.

Edge cases: a null or empty text is the end id alone; repeated rows (and repeated or null
ids) are packed each on their own; an empty table gives an empty result; other columns are
dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise
from .tokens import byte_tokens

Run = tuple[int, int, int, int, int]  # length, first rank, count, first bin, offset


class _Gaps:
    """Open bins by free space, as ranges of bins."""

    def __init__(self):
        self.free: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.ranges:
                insort(self.free, gap)
                self.ranges[gap] = []
            self.ranges[gap].append((first, count))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """A range of bins with the smallest gap that holds ``size``."""
        i = bisect_left(self.free, size)
        if i == len(self.free):
            return None
        gap = self.free[i]
        first, count = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap], self.free[i]
        return gap, first, count


def solve(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place every piece, and the number of bins."""
    left = {n: c for n, c in histogram.items() if c}
    rank = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps, bins = _Gaps(), 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], count, first, offset))
        rank[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            i = bisect_left(large, min(length, capacity - length) + 1) - 1
            while i >= 0 and left[large[i]] < 1 + (large[i] == length):
                i -= 1
            if i < 0:
                count, fill = left[length], length
                place(length, count, bins, 0)
            else:
                other = large[i]
                count = left[length] // 2 if other == length else min(left[length], left[other])
                fill = length + other
                place(length, count, bins, 0)
                place(other, count, bins, length)
            gaps.add(capacity - fill, bins, count)
            bins += count
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            found = gaps.take(length)
            if found is None:
                found = capacity, bins, -(-left[length] // (capacity // length))
                bins += found[2]
            gap, first, count = found
            each = min(gap // length, left[length])
            full = min(count, left[length] // each)
            for k in range(each):
                place(length, full, first, capacity - gap + k * length)
            gaps.add(gap - each * length, first, full)
            gaps.add(gap, first + full, count - full)
    return runs, bins


def pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int, key: str, text_col: str,
           end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece, with its task and its rank among the task's pieces of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = byte_tokens(json_path, ranks_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    data = ids[start:end].tobytes()
                    row = (i, piece, start, end - start, zlib.crc32(data), int(seen[end - start]), task, data if keep_ids else None)
                    seen[end - start] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64()))]
                + [pa.array(c, t) for c, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["key", "piece", "start", "length", "ids_crc32", "rank", "task", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids_crc32 long, rank long, task int, ids binary")


def pack(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = 2048, key: str = "doc_id",
         text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``keep_ids`` adds each piece's
    ids (little-endian unsigned 32-bit)."""
    cut = materialise(pieces(docs, json_path, ranks_path, capacity, key, text_col, end_id, keep_ids), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    runs, _ = solve(histogram, capacity)
    plan = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    lengths, first_rank = plan[:, 0], plan[:, 1]
    # one sorted key per run: start of its length's block + first rank
    starts = {n: lengths.searchsorted(n, "left") for n in histogram}

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            at = np.empty(len(n), dtype=np.int64)
            for length in np.unique(n):
                mine = n == length
                lo = starts[int(length)]
                hi = lengths.searchsorted(length, "right")
                at[mine] = lo + first_rank[lo:hi].searchsorted(rank[mine], "right") - 1
            cols = [batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(plan[at, 3] + rank - first_rank[at]), pa.array(plan[at, 4]), batch.column("ids")],
                names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    placed = cut.join(counts.select("task", "length", "base"), ["task", "length"])
    kind = docs.schema[key].dataType.simpleString()
    out = placed.mapInArrow(locate, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
    out = out.withColumnRenamed("key", key)
    return out if keep_ids else out.drop("ids")
