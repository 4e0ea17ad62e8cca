"""Operator 11: spelling variants, by Bloom-guided edit neighbourhoods.

Words are counted over all texts; those long and frequent enough are the vocabulary. Two words
are near if one inserted, deleted or replaced code point makes one of the other.

* The vocabulary's hashes go to blocked Bloom filters, one per word length (a length with many
  words is cut into slices by hash, so a filter never holds more than FILTER_WORDS of them); a key
  sets its bits in one 64-bit block.
* Every word generates its one-deletion neighbours, which meet the filters of the length below,
  and its one-replacement neighbours, which meet those of its own length (each pair once: the
  replaced code point grows). Insertions are the deletions of the other word. Hashes are sums
  over (code point, position), so a neighbour's hash is the word's, changed in one place.
* Only neighbours that a filter lets through become rows; an equality join with the vocabulary
  drops the false positives.

The filters are broadcast in rounds of at most ROUND_BYTES, whatever the vocabulary's size.
Forms are followed to their roots by doubling: a form is at least RATIO times as frequent as its
word, which bounds the number of steps by the largest count.

Edge cases: null and empty texts and an empty table give no words; rows without an id spell
their words with an empty id; repeated rows count again; words of equal count: the first in code
point order is the form; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import _BYTE, _position_keys, materialise, mix64, small_batches

MIN_LENGTH, MIN_COUNT, RATIO, SLIP = 6, 5, 5, 199
LONGEST_CLASS = 64  # longer words share their filters
FILTER_WORDS, BITS_PER_WORD, PROBES = 1 << 18, 24, 5
ROUND_BYTES = 64 << 20
FLUSH_WORDS = 300_000
CELLS = 1 << 21  # neighbours hashed at once

_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
_U = np.uint64
_LENGTH = 0x9E3779B97F4A7C15

# ------------------------------------------------------------------ counting


def spelled(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text: maximal runs of letters, A-Z lowered, with the rare slip
    (a dropped code point) that the row's id and the run decide."""
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    seed = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), seed)
        if h % SLIP == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1:]
            if len(run) < MIN_LENGTH:
                continue
        yield run, n


def word_counts(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, for words of at least MIN_LENGTH code points."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if text := text.as_py():
                    for word, n in spelled(doc_id.as_py() or "", text):
                        held[word] += n
                    if len(held) >= FLUSH_WORDS:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    src = docs.select(F.col(key).cast("string"), F.col(text_col))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ filters


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code point matrix) of the words of each length; code points are below 256."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(len(w), []).append(i)
    for n, at in places.items():
        points = np.frombuffer("".join([words[i] for i in at]).encode("latin-1"), dtype=np.uint8)
        yield np.array(at), points.reshape(len(at), n)


def place_sums(points: np.ndarray) -> np.ndarray:
    """The part that each (code point, position) adds to a word's hash."""
    return _BYTE[points] * _position_keys(points.shape[1])[:points.shape[1]]


def finish(total: np.ndarray, length: int) -> np.ndarray:
    return mix64(total + _U(length * _LENGTH % (1 << 64)))


def block_and_bits(h: np.ndarray, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.zeros(h.shape, dtype=_U)
    for i in range(PROBES):
        bits |= _U(1) << ((h >> _U(6 * i)) & _U(63))
    return ((h >> _U(32)) * np.asarray(blocks, dtype=_U)) >> _U(32), bits


def length_class(c: Column | int):
    return min(c, LONGEST_CLASS) if isinstance(c, int) else F.least(c, F.lit(LONGEST_CLASS))


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (mix64(h) % _U(slices)).astype(np.int32)


class Filters:
    """The filters of one round, one after the other in one array, found by (class, slice)."""

    def __init__(self, rows: list, slices: dict[int, int]):
        self.words = np.concatenate([np.frombuffer(r["bits"], dtype=_U) for r in rows])
        sizes = [len(r["bits"]) // 8 for r in rows]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r, start, size in zip(rows, starts, sizes):
            # a slice of another round has no block, and lets nothing through
            first, blocks = self.at.setdefault(r["cls"], (np.zeros(slices[r["cls"]], _U), np.zeros(slices[r["cls"]], _U)))
            first[r["slice"]], blocks[r["slice"]] = start, size

    def hits(self, h: np.ndarray, length: int) -> np.ndarray:
        """Places of the hashes (flat) that the filters of a length let through."""
        first, blocks = self.at[length_class(length)]
        if len(first) == 1:
            block, bits = block_and_bits(h, blocks[0])
            return np.flatnonzero((self.words[first[0] + block] & bits) == bits)
        which = slice_of(h, len(first))
        here = np.flatnonzero(blocks[which])
        h, which = h[here], which[here]
        block, bits = block_and_bits(h, blocks[which])
        return here[(self.words[first[which] + block] & bits) == bits]

    def __contains__(self, length: int) -> bool:
        return length_class(length) in self.at


def build_filters(vocabulary: DataFrame, slices: dict[int, int]) -> DataFrame:
    """(cls, slice, bits): one row per filter, built where its hashes meet."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points in by_length(batch.column(0).to_pylist()):
                cls = length_class(points.shape[1])
                h = finish(place_sums(points).sum(axis=1, dtype=_U), points.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), cls, np.int32)), pa.array(slice_of(h, slices[cls])), pa.array(h.view(np.int64))],
                                                 names=["cls", "slice", "h"])

    def build(group: pa.Table) -> pa.Table:
        h = group.column("h").to_numpy().view(_U)
        words = np.zeros(max(1, len(h) * BITS_PER_WORD // 64), dtype=_U)
        block, bits = block_and_bits(h, len(words))
        np.bitwise_or.at(words, block.astype(np.int64), bits)
        return pa.table([group.column("cls")[:1], group.column("slice")[:1], pa.array([words.tobytes()], pa.binary())], names=["cls", "slice", "bits"])

    return (vocabulary.select("word").mapInArrow(hashes, "cls int, slice int, h long")
            .groupBy("cls", "slice").applyInArrow(build, "cls int, slice int, bits binary"))


# ------------------------------------------------------------------ neighbourhoods


def neighbours(points: np.ndarray, filters: Filters, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code point matrix) of the deletions and replacements that the filters let through."""
    n = points.shape[1]
    keys = _position_keys(n)
    for start in range(0, len(points), max(1, CELLS // n // 8)):
        part = points[start:start + max(1, CELLS // n // 8)]
        adds = place_sums(part)
        if n - 1 >= MIN_LENGTH and n - 1 in filters:
            # before a deleted place positions stay, after it they move down by one
            before = np.cumsum(adds, axis=1, dtype=_U) - adds
            moved = _BYTE[part[:, 1:]] * keys[:n - 1]
            after = np.zeros_like(before)
            after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=_U)[:, ::-1]
            hit = filters.hits(finish(before + after, n - 1).ravel(), n - 1)
            row, at = np.divmod(hit, n)
            own = (at == 0) | (part[row, at] != part[row, at - 1])  # of equal neighbours, the first
            row, at = row[own], at[own]
            keep = np.arange(n - 1) + (np.arange(n - 1) >= at[:, None])
            yield start + row, np.take_along_axis(part[row], keep, axis=1)
        if n in filters:
            total = adds.sum(axis=1, dtype=_U)
            new = _BYTE[alphabet]
            rows, width = max(1, CELLS // n // len(alphabet)), max(1, CELLS // len(alphabet))
            for a in range(0, len(part), rows):
                for b in range(0, n, width):
                    old = part[a:a + rows, b:b + width]
                    row, at, to = np.nonzero(alphabet > old[:, :, None])
                    h = total[a + row] + (new[to] - _BYTE[old[row, at]]) * keys[b + at]
                    hit = filters.hits(finish(h, n), n)
                    row, at, to = row[hit], at[hit], to[hit]
                    out = part[a + row]
                    out[np.arange(len(row)), b + at] = alphabet[to]
                    yield start + a + row, out


def rounds_of(sizes: list) -> Iterator[list]:
    """Filters in rounds of at most ROUND_BYTES (one filter never has more)."""
    held, total = [], 0
    for r in sizes:
        if held and total + r["size"] > ROUND_BYTES:
            yield held
            held, total = [], 0
        held.append(r)
        total += r["size"]
    if held:
        yield held


def candidates(vocabulary: DataFrame, table: DataFrame, chosen: list, slices: dict[int, int], alphabet: np.ndarray) -> DataFrame:
    """(word, n, near): neighbours that the filters of one round let through."""
    here = table.where(F.struct("cls", "slice").isin([F.struct(F.lit(r["cls"]), F.lit(r["slice"])) for r in chosen]))
    shared = vocabulary.sparkSession.sparkContext.broadcast(Filters(here.collect(), slices))  # ROUND_BYTES at most

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for places, points in by_length(words):
                for rows, found in neighbours(points, shared.value, alphabet):
                    if len(rows):
                        near = [x.decode("latin-1") for x in np.ascontiguousarray(found).view(f"V{found.shape[1]}").ravel().astype(object)]
                        from_rows = pa.array(places[rows])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(from_rows), batch.column(1).take(from_rows), pa.array(near, pa.string())],
                                                         names=["word", "n", "near"])

    classes = {r["cls"] for r in chosen}
    touched = classes | {c + 1 for c in classes if c + 1 <= LONGEST_CLASS}
    return vocabulary.where(length_class(F.length("word")).isin(sorted(touched))).mapInArrow(probe, "word string, n long, near string")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n), each near pair of the vocabulary (word, n) once."""
    cls = length_class(F.length("word"))
    counts = vocabulary.groupBy(cls.alias("cls")).agg(F.count("*").alias("n")).collect()  # one row per class, 59 at most
    slices = {r["cls"]: -(-r["n"] // FILTER_WORDS) for r in counts}
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where(F.length("c") > 0).distinct().collect()  # 90 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), dtype=np.uint8)
    table = materialise(build_filters(vocabulary, slices), "filters")
    sizes = table.select("cls", "slice", F.length("bits").alias("size")).orderBy("cls", "slice").collect()  # one row per FILTER_WORDS words
    found = [candidates(vocabulary, table, chosen, slices, alphabet) for chosen in rounds_of(sizes)]
    if not found:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.join(known, "near").select("word", "n", "near", "near_n")


# ------------------------------------------------------------------ forms


def roots(links: DataFrame, largest: int) -> DataFrame:
    """(word, root) of every word with a form, from (word, form). Counts grow RATIO-fold from a
    word to its form, so no path is longer than log(largest / MIN_COUNT), and every round doubles
    what was followed."""
    steps = math.log(max(largest, MIN_COUNT) / MIN_COUNT, RATIO) + 1
    out = links.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        out = materialise(out, "roots")
        on = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = out.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return out


def variants(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the vocabulary."""
    vocabulary = materialise(word_counts(docs, key, text_col).where(F.col("n") >= MIN_COUNT), "words")
    pairs = near_pairs(vocabulary)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.minus") >= RATIO * F.col("n")
    near = materialise(near.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "near")
    largest = vocabulary.agg(F.max("n")).first()[0] or 0
    out = vocabulary.join(near, "word", "left").join(roots(near.where(F.col("form").isNotNull()), largest), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
