"""Operator 13: ranked lexical search over posting lists with range-maximum tables.

The index is a written table. Documents go, in the order read, to shards of a bounded number of
terms; a shard has one row with its documents (longest first) and one row per term with the
places and counts of that term. Statistics (documents, terms, documents per term) are
aggregates of that table.

A search takes queries in blocks of bounded size. In each shard, the posting lists of the block's
terms get one sparse table whose cells name the best posting of a power-of-two range. A query
starts with the interval of all documents; the sum of its terms' range maxima bounds every score
inside. The intervals of highest bound come first: each is split at the document of its
greatest single impact, which is scored exactly, and both sides get new bounds, until no bound
reaches the k-th score found. So every shard's answer is exact, and so are the k best of all
shards. Scores found in a few shards are a floor for the others: a lower bound of the k-th best.

Edge cases: null or empty texts, and texts without a term, are no documents; queries without a
known term have no rows; a repeated row is a document of its own, a repeated query is answered
each time; a document without an id can be found, its id is null and comes last among equal
scores; only scores above 0 count; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, small_batches

SHARD_TERMS = 1_500_000
BLOCK_QUERIES, BLOCK_TERMS = 1000, 100_000
FLOOR_SHARDS = 6
MOST_INTERVALS = 256  # split at once
NO_ID = np.iinfo(np.int64).max
_SHARDS = "shard long, term string, df int, places array<int>, counts array<int>, doc_ids array<long>, lengths array<int>"


def _classes() -> bytes:
    """Byte -> itself for digits, a-z and everything beyond ASCII, A-Z lowered, else a space."""
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    return bytes(b if b in keep else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


_CLASSES = _classes()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CLASSES).split() if text else []


# ------------------------------------------------------------------ index


class Shard:
    """Documents of one task, until they hold enough terms to be written."""

    def __init__(self):
        self.code: defaultdict[bytes, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.codes.append(np.fromiter(map(self.code.__getitem__, terms), dtype=np.int64, count=len(terms)))
        self.total += len(terms)

    def rows(self, number: int) -> pa.RecordBatch:
        lengths = np.array([len(c) for c in self.codes])
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        keys, counts = np.unique(np.concatenate(self.codes) * len(order) + np.repeat(place, lengths), return_counts=True)
        code, at = np.divmod(keys, len(order))
        df = np.bincount(code, minlength=len(self.code))
        n = len(self.code)
        # the first row is the documents', the others the terms'
        offsets = pa.array(np.concatenate(([0, 0], np.cumsum(df))).astype(np.int32))
        own = pa.array(np.concatenate(([0], np.full(n + 1, len(order)))).astype(np.int32))
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + 1, number)), pa.array([None, *self.code], pa.string()), pa.array(np.concatenate(([0], df)).astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
            pa.ListArray.from_arrays(own, pa.array([self.ids[i] for i in order], pa.int64())), pa.ListArray.from_arrays(own, pa.array(lengths[order].astype(np.int32)))],
            names=["shard", "term", "df", "places", "counts", "doc_ids", "lengths"])


def build_index(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The written index of all documents and all terms."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if terms := terms_of(text.as_py()):
                    shard.add(doc_id.as_py(), terms)
                    if shard.total >= shard_terms:
                        yield shard.rows(number)
                        number, shard = number + 1, Shard()
        if shard.total:
            yield shard.rows(number)

    return materialise(docs.select(F.col(key).cast("long"), F.col(text_col)).mapInArrow(run, _SHARDS), "lexical-index")


# ------------------------------------------------------------------ search in a shard


class Postings:
    """The posting lists of some terms in one shard, end to end, with one range-maximum table."""

    def __init__(self, places: list[np.ndarray], impacts: list[np.ndarray], documents: int):
        sizes = np.array([len(p) for p in places])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.place, self.impact = np.concatenate(places).astype(np.int64), np.concatenate(impacts)
        self.documents = documents
        self.key = np.repeat(np.arange(len(sizes)), sizes) * documents + self.place
        # best[j][i]: the posting of greatest impact among the 2**j from i on
        self.best = [np.arange(len(self.place), dtype=np.int32)]
        for j in range(int(sizes.max()).bit_length() - 1):
            low = self.best[-1]
            a, b = low[:len(low) - (1 << j)], low[1 << j:]
            self.best.append(np.where(self.impact[b] > self.impact[a], b, a))
        self.flat = np.concatenate(self.best)
        self.level = np.concatenate(([0], np.cumsum([len(b) for b in self.best])[:-1]))

    def best_in(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posting, impact) of the greatest impact in [low, high); impact 0 where that is empty."""
        size = high - low
        empty = size <= 0
        j = np.frexp(np.where(empty, 1, size))[1] - 1
        low = np.where(empty, 0, low)
        first = self.level[j]
        a, b = self.flat[first + low], self.flat[first + np.where(empty, 0, high - (1 << j))]
        ia, ib = self.impact[a], self.impact[b]
        return np.where(ib > ia, b, a), np.where(empty, 0, np.maximum(ia, ib))

    def find(self, lists: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where each (list, place) is, or would be."""
        return np.searchsorted(self.key, lists * self.documents + places)


def search_shard(postings: Postings, lists: np.ndarray, weight: np.ndarray, ids: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, documents scored) of the k best documents for one query, whose terms are
    ``lists`` with ``weight``; scores below ``floor`` or not above 0 may be left out."""
    low, high = postings.starts[lists][None, :], postings.ends[lists][None, :]
    posting, impact = postings.best_in(low, high)
    impact = impact * weight
    bound = impact.sum(axis=1)
    best_s, best_i = np.empty(0, np.int64), np.empty(0, np.int64)
    at_once, scored, need = 1, 0, max(1, floor)
    while True:
        keep = bound >= need
        if not keep.all():
            low, high, posting, impact, bound = low[keep], high[keep], posting[keep], impact[keep], bound[keep]
        if not len(bound):
            return best_i, best_s, scored
        if len(bound) > at_once:
            take = np.argpartition(-bound, at_once)[:at_once]
            rest = np.ones(len(bound), dtype=bool)
            rest[take] = False
        else:
            take, rest = np.arange(len(bound)), np.zeros(len(bound), dtype=bool)
        at_once = min(MOST_INTERVALS, 2 * at_once)
        l, h, p, g = low[take], high[take], posting[take], impact[take]
        # split each at the document of its greatest impact, and score that one
        top = p[np.arange(len(take)), g.argmax(axis=1)]
        place = postings.place[top]
        at = postings.find(lists[None, :], place[:, None])
        inside = at < h
        hit = inside & (postings.place[np.where(inside, at, 0)] == place[:, None])
        score = np.where(hit, postings.impact[np.where(inside, at, 0)] * weight, 0).sum(axis=1)
        scored += len(score)
        best_s, best_i = np.concatenate([best_s, score]), np.concatenate([best_i, ids[place]])
        if len(best_s) > k:
            order = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[order], best_i[order]
        if len(best_s) == k:
            need = max(need, int(best_s.min()))
        l2, h2 = np.concatenate([l, at + hit]), np.concatenate([at, h])
        p2, g2 = postings.best_in(l2, h2)
        g2 = g2 * weight
        b2 = g2.sum(axis=1)
        live = b2 >= need
        low, high = np.concatenate([low[rest], l2[live]]), np.concatenate([high[rest], h2[live]])
        posting, impact = np.concatenate([posting[rest], p2[live]]), np.concatenate([impact[rest], g2[live]])
        bound = np.concatenate([bound[rest], b2[live]])


# ------------------------------------------------------------------ queries


class Block:
    """Some queries with the weights of their terms, as tasks need them."""

    def __init__(self, queries: list[tuple[object, Counter]]):
        self.queries = queries
        self.terms = sorted(set().union(*(c for _, c in queries)))
        self.floor = [0] * len(queries)

    def weigh(self, df: dict[bytes, int], documents: int, total: int) -> "Block":
        self.documents, self.total = documents, total
        self.weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
        return self

    def search(self, shard: pa.Table, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, ids, scores) of one shard."""
        term = [None if t is None else t.encode() for t in shard.column("term").to_pylist()]
        own = term.index(None)
        doc_ids = shard.column("doc_ids").combine_chunks()[own].values
        ids = doc_ids.fill_null(NO_ID).to_numpy()
        n = shard.column("lengths").combine_chunks()[own].values.to_numpy().astype(np.int64)
        norm = 12 * (75 + 25 * n * self.documents // self.total)
        places, impacts, number = [], [], {}
        for i, (t, p, c) in enumerate(zip(term, shard.column("places").combine_chunks(), shard.column("counts").combine_chunks())):
            if t is not None and self.weight.get(t, 0) > 0:
                number[t] = len(places)
                places.append(p.values.to_numpy())
                tf = c.values.to_numpy().astype(np.int64)
                impacts.append(1_000_000_000 * tf // (1000 * tf + norm[places[-1]]))
        if not places:
            return
        postings = Postings(places, impacts, len(ids))
        for q, (_, counts) in enumerate(self.queries):
            known = [t for t in counts if t in number]
            if known:
                weight = np.array([counts[t] * self.weight[t] for t in known], dtype=np.int64)
                found, scores, _ = search_shard(postings, np.array([number[t] for t in known]), weight, ids, k, self.floor[q])
                yield q, found, scores


def blocks_of(queries: DataFrame, key: str, text_col: str) -> Iterator[Block]:
    """Queries in blocks of bounded size, streamed through the driver; one without terms is left out."""
    held, size = [], 0
    for item, text in queries.select(key, text_col).toLocalIterator():
        if counts := Counter(terms_of(text)):
            if held and (len(held) >= BLOCK_QUERIES or size + len(counts) > BLOCK_TERMS):
                yield Block(held)
                held, size = [], 0
            held.append((item, counts))
            size += len(counts)
    if held:
        yield Block(held)


def search_block(index: DataFrame, block: Block, k: int) -> DataFrame:
    """(number of the query, doc_id, score): the k best of every shard, or those above the floors."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(block)  # BLOCK_TERMS bounds it

    def run(shard: pa.Table) -> pa.Table:
        found = list(shared.value.search(shard, k))
        cat = lambda x: np.concatenate([np.empty(0, np.int64), *x])
        ids = cat([i for _, i, _ in found])
        return pa.table({"query": pa.array(cat([np.full(len(i), q) for q, i, _ in found]).astype(np.int32)), "doc_id": pa.array(ids, mask=ids == NO_ID),
                         "score": pa.array(cat([s for _, _, s in found]))})

    words = spark.createDataFrame([(t.decode("utf-8", "surrogatepass"),) for t in block.terms], "word string")
    lists = index.join(F.broadcast(words), F.col("term") == F.col("word"), "left_semi")  # BLOCK_TERMS rows at most
    return (lists.unionByName(index.where(F.col("term").isNull()))
            .groupBy("shard").applyInArrow(run, "query int, doc_id long, score long"))


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 20, key: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, rank, doc_id, score): the k best documents of every query."""
    spark = index.sparkSession
    shards = index.where(F.col("term").isNull())
    n, documents, total = shards.agg(F.count("*"), F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    kind = queries.schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"{key} {kind}, rank int, doc_id long, score long")
    for block in blocks_of(queries, key, text_col) if documents else ():
        words = spark.createDataFrame([(t.decode("utf-8", "surrogatepass"),) for t in block.terms], "term string")
        df = index.select("term", "df").join(F.broadcast(words), "term").groupBy("term").agg(F.sum("df").alias("df"))
        block.weigh({r["term"].encode("utf-8", "surrogatepass"): r["df"] for r in df.collect()}, documents, total)  # BLOCK_TERMS rows at most
        if n > 4 * FLOOR_SHARDS:
            first = [r["shard"] for r in shards.select("shard").orderBy(F.xxhash64("shard"), "shard").limit(FLOOR_SHARDS).collect()]
            seen = best(search_block(index.where(F.col("shard").isin(first)), block, k), k)
            for r in seen.where(F.col("rank") == k).collect():  # one row per query
                block.floor[r["query"]] = r["score"]
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block.queries)], f"query int, {key} {kind}")
        found = best(search_block(index, block, k), k).join(F.broadcast(names), "query")  # BLOCK_QUERIES rows
        out = out.unionByName(found.select(key, "rank", "doc_id", "score"))
    return out
