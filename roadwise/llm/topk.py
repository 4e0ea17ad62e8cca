"""Operator 6: exact top-k inner product search with vector-approximation files.

Vectors become integers floor(256 * x). They are written once, in blocks: next to a block's integers
stand one byte per component, the number of one of 256 equal cells between the block's extremes of
that component. A search scans the cells alone, which give a lower and an upper bound of every inner
product; exact vectors are then read in order of the bounds, best first, until the k-th score found
exceeds every bound left. So each block's answer is exact, and the k best over all blocks are the
exact result.

Rows go to blocks by a hash of their id and queries to chunks likewise, so sizes are even whatever
the vectors are; the number of blocks grows with the table. Each chunk of queries meets each block in
one task (a co-group on block and chunk) and k rows per query and block are merged by a window over
the query. Where sums could pass 2**53 or 2**62, they are taken in 64-bit or in unbounded integers.

Edge cases: vectors that are null or empty or hold a null or non-finite component (also after the
scaling, beyond 7e305) take no part, nor do rows without id; vectors of another length than the query
are no candidates of it; ties go to the smaller id; a query with fewer than k candidates gets them
all; a repeated id is a row of its own, and no row of the query's own id is a candidate; scores
beyond the range of a long are ranked exactly and shown as its largest or smallest value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise

CELLS = 256
LONG = np.iinfo(np.int64)
_FILE = "block int, dims int, ids binary, low binary, width binary, cells binary, exact binary"


def usable(vectors: DataFrame, key: str, vec_col: str) -> DataFrame:
    """(vec_id, x array<double>): the vectors that take part, scaled to whole numbers (in doubles)."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double") * 256.0)
    ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ok)


def matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.floor(lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def approximate(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, cells): cell c of a component holds the values from low + c * width on."""
    low = rows.min(axis=0)
    width = np.maximum(1.0, np.ceil((rows.max(axis=0) - low + 1) / CELLS))
    return low, width, np.minimum((rows - low) // width, CELLS - 1).astype(np.uint8)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, in the narrowest arithmetic that holds every sum."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if most < 2.0 ** 53:
        return (rows @ query).astype(np.int64)
    if most < 2.0 ** 62 and max(np.abs(rows).max(), np.abs(query).max()) < 2.0 ** 62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    whole = lambda m: np.array([int(v) for v in m.ravel()], dtype=object).reshape(m.shape)
    return whole(rows) @ whole(query)


def block_search(queries: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray,
                 exact: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """The k best rows of one block for each query: (query ids, row ids, scores, exact rows read)."""
    # Inner products are bounded from the middle of each cell and its half width; the last term is
    # the most that rounding can add.
    with np.errstate(over="ignore", invalid="ignore"):
        middle = low + cells * width + (width - 1) / 2
        centre = queries @ middle.T
        slack = np.abs(queries) @ (width / 2)
        slack = (slack + (np.abs(queries) @ np.abs(middle).max(axis=0) + slack) * (len(low) + 8) * 2.0 ** -50)[:, None]
        upper, lower = centre + slack, centre - slack
        upper[np.isnan(upper)], lower[np.isnan(lower)] = np.inf, -np.inf
    out_q, out_i, out_s, reads = [], [], [], 0
    for q in range(len(queries)):
        cand = np.flatnonzero(ids != q_ids[q])
        if len(cand) > k:  # no row below the k-th lower bound can be among the best
            floor = np.partition(lower[q, cand], len(cand) - k)[len(cand) - k]
            cand = cand[upper[q, cand] >= floor]
        cand = cand[np.argsort(-upper[q, cand], kind="stable")]
        best: list[tuple[int, int]] = []  # (-score, id)
        at, step = 0, 4 * k
        while at < len(cand) and (len(best) < k or float(upper[q, cand[at]]) >= -best[k - 1][0]):
            take = cand[at:at + step]
            at, reads, step = at + len(take), reads + len(take), 2 * step
            best = sorted(best + list(zip((-exact_scores(exact[take], queries[q])).tolist(), ids[take].tolist())))[:k]
        out_q += [int(q_ids[q])] * len(best)
        out_i += [i for _, i in best]
        out_s += [-s for s, _ in best]
    return out_q, out_i, out_s, reads


def write_blocks(vectors: DataFrame, block_rows: int) -> DataFrame:
    """The vector-approximation file of (vec_id, x): one row per block and vector length, written."""
    total = vectors.agg(F.count("*")).first()[0]
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, -(-total // block_rows)))).cast("int")

    def build(group: pa.Table) -> pa.Table:
        dims = group.column("dims")[0].as_py()
        rows, ids = matrix(group.column("x"), dims), group.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], ids[order]
        raw = [pa.array([a.tobytes()], pa.binary()) for a in (ids, *approximate(rows), rows)]
        return pa.table([group.column("block")[:1], group.column("dims")[:1], *raw], names=["block", "dims", "ids", "low", "width", "cells", "exact"])

    rows = vectors.select(block.alias("block"), F.size("x").alias("dims"), "vec_id", "x")
    return materialise(rows.groupBy("block", "dims").applyInArrow(build, _FILE), "vector-file")


def top_k(vectors: DataFrame, k: int = 5, query_mod: int = 50, key: str = "vec_id", vec_col: str = "embedding",
          block_rows: int = 4096, chunk_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose id is divisible by ``query_mod``."""
    v = usable(vectors, key, vec_col)
    blocks = write_blocks(v, block_rows)
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    asked = v.where(F.col("vec_id") % query_mod == 0)
    n_chunks = max(1, -(-asked.count() // chunk_rows))
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_chunks)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(chunk.alias("chunk"), F.size("x").alias("dims"), "vec_id", "x").withColumn("block", upto(n_blocks))

    def search(file: pa.Table, asked: pa.Table) -> pa.Table:
        found_q, found_i, found_s = [], [], []
        if file.num_rows and asked.num_rows:  # one row: a block is one
            dims = file.column("dims")[0].as_py()
            ids, low, width, cells, exact = (np.frombuffer(file.column(c)[0].as_py(), t) for c, t in (
                ("ids", np.int64), ("low", float), ("width", float), ("cells", np.uint8), ("exact", float)))
            found_q, found_i, found_s, _ = block_search(matrix(asked.column("x"), dims), asked.column("vec_id").to_numpy(), ids, low, width,
                                                        cells.reshape(-1, dims), exact.reshape(-1, dims), k)
        # beyond a long: ranked by all digits here and across blocks, so as decimal text of equal width
        wide = [f"{s + 10 ** 700:0701d}" if not LONG.min <= s <= LONG.max else None for s in found_s]
        return pa.table({"query_id": pa.array(found_q, pa.int64()), "vec_id": pa.array(found_i, pa.int64()),
                         "score": pa.array([min(max(s, LONG.min), LONG.max) for s in found_s], pa.int64()), "digits": pa.array(wide, pa.string())})

    pairs = blocks.withColumn("chunk", upto(n_chunks)).groupBy("block", "chunk", "dims").cogroup(asked.groupBy("block", "chunk", "dims"))
    found = pairs.applyInArrow(search, "query_id long, vec_id long, score long, digits string")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("digits").desc_nulls_last(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
