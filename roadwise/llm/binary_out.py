"""Operator 3: packed token-id matrices.

Each task reads its documents in blocks of a bounded number of tokens and packs every block
by itself, best fit in decreasing length: a segment tree over the free space 0..seq_len
counts the open rows, and a descent finds the smallest space that holds the next piece.
Documents longer than a row are cut without loss (full rows, then the rest). One output row
is one matrix row; nothing is shuffled, so the job is one pass and any partition can be
redone alone. A block leaves at most a few rows partly empty.

Columns: ``row_id`` (partition and running number), ``n_tokens``, ``input_ids`` (seq_len
little-endian unsigned ids of ``id_bytes`` bytes, padded with ``pad_id``), ``position_ids``
(the same shape, unsigned 16- or 32-bit: restarts at 0 with each segment), ``cu_seqlens``
(cumulative segment lengths from 0), and per segment ``doc_ids``, ``doc_starts`` (first
token within its document). ``write_matrices`` stores them as Parquet.

Edge cases: a null or empty text is the end id alone; null and repeated ids are kept; an
empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tokens import byte_tokens


class CapacityTree:
    """Counts of open rows by free space, in a segment tree; ``fit`` finds the smallest free
    space >= size that has a row."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        i = free + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def fit(self, size: int) -> tuple[int, int] | None:
        i = size + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i + (not self.count[2 * i])
        free = i - self.leaves
        self._change(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Row number of each piece (all at most ``capacity`` long), and the number of rows."""
    tree, where, rows = CapacityTree(capacity), np.empty(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.fit(size)
        if found is None:
            free, row, rows = capacity, rows, rows + 1
        else:
            free, row = found
        where[i] = row
        if free > size:
            tree.add(free - size, row)
    return where, rows


def matrices(docs: DataFrame, json_path: str, ranks_path: str, seq_len: int = 2048, key: str = "doc_id",
             text_col: str = "text", end_id: int = 50256, pad_id: int = 50256, id_bytes: int = 2,
             block_tokens: int = 4_000_000) -> DataFrame:
    """The packed rows of all documents, as described above."""
    kind, pos_kind = f"<u{id_bytes}", "<u2" if seq_len <= 65536 else "<u4"

    def block(held: list[tuple[object, np.ndarray]], number: int, task: int) -> Iterator[list]:
        cuts = [(k, ids, s, min(len(ids), s + seq_len)) for k, ids in held for s in range(0, len(ids), seq_len)]
        where, n_rows = best_fit_decreasing(np.array([e - s for *_, s, e in cuts]), seq_len)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(n_rows + 1))
        for r in range(n_rows):
            mine = [cuts[j] for j in order[bounds[r]:bounds[r + 1]]]
            sizes = [e - s for *_, s, e in mine]
            total = sum(sizes)
            ids = np.full(seq_len, pad_id, dtype=kind)
            pos = np.zeros(seq_len, dtype=pos_kind)
            ids[:total] = np.concatenate([d[s:e] for _, d, s, e in mine])
            pos[:total] = np.concatenate([np.arange(n) for n in sizes])
            yield [(task << 36) + number + r, total, ids.tobytes(), pos.tobytes(), [0, *np.cumsum(sizes).tolist()],
                   [k for k, *_ in mine], [s for *_, s, _ in mine]]

    key_type = docs.schema[key].dataType.simpleString()
    names = ["row_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, number = byte_tokens(json_path, ranks_path), TaskContext.get().partitionId(), 0
        held: list[tuple[object, np.ndarray]] = []
        tokens = 0
        key_arrow = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, tokens
            rows: list[list] = []
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(key_arrow), pa.list_(pa.int64())]
            for row in block(held, number, task):
                rows.append(row)
                number += 1
                if len(rows) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            held, tokens = [], 0

        for batch in batches:
            key_arrow = batch.schema.field(0).type
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype(kind)
                held.append((k, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()

    src = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "row_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
                               f"doc_ids array<{key_type}>, doc_starts array<long>")


def write_matrices(packed: DataFrame, path: str) -> None:
    packed.write.mode("overwrite").parquet(path)


def read_row(input_ids: bytes, cu_seqlens: list[int], id_bytes: int = 2) -> list[np.ndarray]:
    """The segments of one matrix row."""
    ids = np.frombuffer(input_ids, dtype=f"<u{id_bytes}")
    return [ids[a:b] for a, b in zip(cu_seqlens, cu_seqlens[1:])]
