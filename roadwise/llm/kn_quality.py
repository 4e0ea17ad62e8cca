"""Operator 9: quality classifier from an interpolated modified Kneser-Ney model of words.

The model is over words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered, hashed to 64 bits: no fixed
vocabulary) in 3-grams, with two marks before a text and one after it. It is learned from the
trusted documents (label 1), but for one in ``HELD_OUT``, and stays in tables:

* a 3-gram belongs to the shard of its middle word (``Layout``); a common middle word is dealt over
  several by the word before. Tasks send the 3-grams of their texts to the shards as compressed
  columns, one row for a task and shard, and each shard adds up its counts;
* lower orders take continuation counts (how many words precede an n-gram). Those of pairs are
  in the shard of their first word, those of single words come from an exchange between the
  shards by word (``ends``, ``answered``); pairs of a common word are added up over its shards. The
  three discounts of an order come from its counts of counts;
* the log probability of a text is a sum of weights, one for each of its n-grams (``Weights``; an
  n-gram not seen weighs nothing). A document's 3-grams meet the counts in their shard, which looks
  up the weights of all orders and returns sums per document. This is done one slice of the shards after
  the other, so that the 3-grams of a slice alone are on disk.

Only the counts of counts, and common words of a sample, reach the driver.

A document is kept when its perplexity is at most ``slack`` times the ``quantile`` of the
perplexities of the held-out trusted documents in its language (languages without any use all
of them; without any held out, the trusted ones stand in). Perplexity is per word, with
``PRIOR_WORDS`` words at the rate of those documents added, so that a text of a few words is
not judged by chance.

Edge cases: a null or empty text (or one of white space alone) has a null perplexity and is
rejected; a null language is a language of its own; without trusted documents nothing can be
judged and every document with text is kept; labels count once per id; repeated rows are
judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_mod, materialise, mix64, release, small_batches, utf8, word_hashes

QUANTILE, SLACK = 0.99, 1.25
PRIOR_WORDS = 8
HELD_OUT = 10
SHARD_CHARS, MIN_SHARDS, SLICES = 16_000_000, 12, 4
SLICE_ROWS, SLICE_TEXTS = 400_000, 3_000  # in a slice of a small table, at least: words, trusted texts
UNIT = 1 << 24  # of a bit
CHUNK = 2_000_000  # words dealt together by a task
HOT_SAMPLE, HOT_LEAST = 64, 1000  # one text in so many is looked at; words in a sample too small to tell
HOT_SHARE = 0.25  # of a shard: a middle word with more is dealt over several
KNOWN = 1 << 16
BITMAP, BITMAPS = 1 << 15, 1 << 11  # bits of a bitmap, and how many at most (8 MB)

_U = np.uint64
START, END = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)
COUNTS, PAIRS, ASKED, ENDS, PAIR_ENDS, SUMS = range(6)  # kinds of blocks
BLOCK = "shard int, kind int, data binary"
_NAMES = ["shard", "kind", "data"]


# --------------------------------------------------------------------------- blocks

def sequence(text: str | None) -> np.ndarray | None:
    """Hashes of the words of a text with its marks; None without words."""
    if not text or text.isspace():
        return None
    words = word_hashes(utf8(text))
    return np.concatenate([[START, START], words, [END]]) if len(words) else None


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def block(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes: bytes of one place stand together, as most are alike."""
    out = [np.array([len(columns)], np.int64).tobytes()]
    for c in columns:
        out += [np.array([len(c), ord(c.dtype.char)], np.int64).tobytes(), np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def columns_of(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 8
    for _ in range(np.frombuffer(raw, np.int64, 1)[0]):
        n, kind = map(int, np.frombuffer(raw, np.int64, 2, at))
        kind = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 16).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 16 + n * kind.itemsize
    return out


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.uint32), prepend=np.uint32(0))


class Words(NamedTuple):
    """Sorted hashes; those known to all tasks are sent as their places in ``Layout.known``."""
    hashes: np.ndarray
    at: np.ndarray
    known: np.ndarray


def gram_block(words: Words, u: np.ndarray, v: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """3-grams sorted by v and w, as numbers of ``words``, of which only the used are kept."""
    used = np.zeros(len(words.hashes), bool)
    for x in (u, v, w):
        used[x] = True
    number = np.cumsum(used, dtype=np.uint32) - np.uint32(1)
    other = words.hashes[used & ~words.known]
    return block(steps(words.at[used & words.known]), np.diff(other, prepend=_U(0)), number[u], steps(number[v]), steps(number[w]), *more)


def grams_of(data: bytes, known: np.ndarray) -> list[np.ndarray]:
    at, other, u, v, w, *more = columns_of(data)
    words = np.sort(np.concatenate([known[np.cumsum(at, dtype=np.uint32)], np.cumsum(other, dtype=_U)]))
    return [words, u.astype(np.int64), *(np.cumsum(x, dtype=np.uint32).astype(np.int64) for x in (v, w)), *more]


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def sorted_by(u: np.ndarray, v: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """Order by v, w, u (numbers below ``size``)."""
    bits = max(int(size - 1).bit_length(), 1) if size else 1
    if 3 * bits > 63:
        return np.lexsort((u, w, v))
    return np.argsort(v << 2 * bits | w << bits | u)


def found_at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked key in sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


# --------------------------------------------------------------------------- shards

class Layout(NamedTuple):
    """A 3-gram is in the shard of its middle word; a common one is dealt over ``spread`` shards by the word before."""
    shards: int
    slices: int
    common: np.ndarray  # sorted hashes
    spread: np.ndarray
    known: np.ndarray  # sorted hashes of usual words, for short blocks

    def words(self, hashes: np.ndarray) -> Words:
        return Words(hashes, *found_at(self.known, hashes))

    def place(self, hashes: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        home = mix64(hashes)
        i, hot = found_at(self.common, hashes)
        at = home[v]
        if hot.any():
            few = np.flatnonzero(hot[v])
            at[few] += mix64(hashes[u[few]] + START) % self.spread[i[v[few]]]
        return (at % _U(self.shards)).astype(np.int32)

    def places(self, i: int) -> list[int]:
        """All shards of a common word, each once."""
        first = int(mix64(self.common[i:i + 1])[0])
        return sorted({(first + k) % 2 ** 64 % self.shards for k in range(int(self.spread[i]))})

    def buckets(self, words: np.ndarray) -> np.ndarray:
        return (mix64(words + START) % _U(self.shards)).astype(np.int32)


def as_many(rows: int, each: int, most: int) -> int:
    return min(max(rows // each, 1), most)


def common_grams(rows: DataFrame) -> list[tuple[int | None, int]]:
    """(hash, times) of the ``KNOWN`` most common words in a sample of the texts, with the number of all words
    under no hash. They are only written and dealt otherwise, so the result does not depend on the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for t in batch.column(0).to_pylist() if (s := sequence(t)) is not None]
            if found:
                words, n = np.unique(np.concatenate([s[1:] for s in found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([signed(words), pa.nulls(1, pa.int64())]), pa.array(np.append(n, n.sum()))], names=["word", "n"])

    some = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(HOT_SAMPLE)) == 0).select("text")
    found = some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in found.orderBy(F.desc("n"), "word").limit(KNOWN + 1).collect()]


def layout(rows: DataFrame, texts: int) -> Layout:
    """Shards by the characters of all texts."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(MIN_SHARDS, -(-chars // SHARD_CHARS))
    found = {r: n for r, n in common_grams(rows)}
    total = found.pop(None, 0)
    known = {w % 2 ** 64: n for w, n in found.items() if n > 1}
    least = min(HOT_LEAST, total / 100)
    hot = sorted((w, min(int(np.ceil(n / total * shards / HOT_SHARE)), shards)) for w, n in known.items() if n >= max(least, total * HOT_SHARE / shards))
    hot = [(w, k) for w, k in hot if k > 1 and w != int(END)]
    return Layout(shards, as_many(texts, SLICE_TEXTS, as_many(chars // 6, SLICE_ROWS, SLICES)), *(np.array(x, dtype=_U) for x in ([w for w, _ in hot], [k for _, k in hot], sorted(known))))


class Piece(NamedTuple):
    rids: np.ndarray
    hashes: np.ndarray  # sorted
    ids: np.ndarray  # of each word its place in hashes
    doc: np.ndarray  # and in rids


def pieces(texts: Iterator[tuple[int, str | None]]) -> Iterator[Piece]:
    """About ``CHUNK`` words together; a long text is cut into pieces that share two words, so that each
    3-gram is in one."""
    found: list[tuple[int, np.ndarray]] = []
    size = 0

    def joined() -> Piece:
        hashes, ids = np.unique(np.concatenate([s for _, s in found]), return_inverse=True)
        return Piece(np.array([r for r, _ in found], dtype=np.int64), hashes, ids.astype(np.int32), np.repeat(np.arange(len(found), dtype=np.int32), [len(s) for _, s in found]))

    for rid, text in texts:
        s = sequence(text)
        for a in range(0, len(s) - 2 if s is not None else 0, CHUNK):
            found.append((rid, s[a:a + CHUNK + 2]))
            size += len(found[-1][1])
            if size >= CHUNK:
                yield joined()
                found, size = [], 0
    if found:
        yield joined()


def dealt(lay: Layout, piece: Piece, part: int | None = None) -> Iterator[tuple[int, Words, tuple[np.ndarray, ...]]]:
    """(shard, words, (u, v, w, doc, n)): the 3-grams of each text, for the shards of one slice or all. Those
    alike that stand together are one row."""
    words, ids, doc = lay.words(piece.hashes), piece.ids, piece.doc
    at = np.flatnonzero(doc[2:] == doc[:-2])
    to = lay.place(piece.hashes, ids[at], ids[at + 1])
    if part is not None:
        mine = np.flatnonzero(to % lay.slices == part)
        at, to = at[mine], to[mine]
    if not len(at):
        return
    u, v, w, d = (x.astype(np.int64) for x in (ids[at], ids[at + 1], ids[at + 2], doc[at]))
    order = sorted_by(u, v, w, len(piece.hashes))
    u, v, w, d, to = (x[order] for x in (u, v, w, d, to))
    first = starts(u, v, w, d)
    n = np.diff(first, append=len(u))
    to = to[first]
    order = np.argsort(to, kind="stable")
    first, n, to = first[order], n[order], to[order]
    edge = [*starts(to), len(to)]
    for a, b in zip(edge, edge[1:]):
        i = first[a:b]
        yield int(to[a]), words, (u[i], v[i], w[i], d[i], n[a:b])


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=_NAMES)


def merged(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Gram blocks with counts as one: words, u, v, w, n, by v, w and u."""
    words = np.unique(np.concatenate([f[0] for f in found]))
    number = [np.searchsorted(words, f[0]) for f in found]
    u, v, w = (np.concatenate([m[f[k]] for m, f in zip(number, found)]) for k in (1, 2, 3))
    n = np.concatenate([f[4] for f in found]).astype(np.int64)
    order = sorted_by(u, v, w, len(words))
    u, v, w, n = (x[order] for x in (u, v, w, n))
    first = starts(u, v, w)
    return [words, u[first], v[first], w[first], np.add.reduceat(n, first)]


def count_grams(texts: DataFrame, text_col: str, lay: Layout) -> DataFrame:
    """3-gram counts over all rows: a block for each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces((0, t) for batch in batches for t in batch.column(0).to_pylist()):
            out = []
            for shard, words, (u, v, w, _, n) in dealt(lay, piece):
                first = starts(u, v, w)
                out.append((shard, COUNTS, gram_block(words, u[first], v[first], w[first], np.add.reduceat(n, first).astype(np.uint32))))
            yield batch_of(out)

    def summed(table: pa.Table) -> pa.Table:
        words, u, v, w, n = merged([grams_of(x, lay.known) for x in table["data"].to_pylist()])
        return pa.Table.from_batches([batch_of([(table["shard"][0].as_py(), COUNTS, gram_block(lay.words(words), u, v, w, n.astype(np.uint32)))])])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(run, BLOCK).groupBy("shard").applyInArrow(summed, BLOCK)


# --------------------------------------------------------------------------- model

def discounts(r: Mapping[str, int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    n = [float(r[f"n{i}"]) for i in range(1, 5)]
    if not (n[0] and n[1]):
        return [0.5, 0.75, 0.9]  # too few n-grams for an estimate
    y = n[0] / (n[0] + 2 * n[1])
    d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2 for i in (1, 2, 3)]
    return [min(max(x, 0.1), float(i)) for i, x in zip((1, 2, 3), d)]


class Model(NamedTuple):
    blocks: DataFrame  # (shard, kind, data): counts of the 3-grams, facts of their words, pairs of common words
    hot: DataFrame  # (word) dealt over several shards
    layout: Layout
    d1: list[float]
    d2: list[float]
    d3: list[float]
    all: int  # distinct pairs
    unseen: float  # log2 probability of a word not seen
    end: float  # of the end of the text, less that
    slices: int


def pairs_of(data: bytes, lay: Layout) -> tuple[np.ndarray, ...]:
    """words, v, w, c, n: pairs of a block with the words before them, whether their word is common, 3-grams."""
    words, _, v, w, n = grams_of(data, lay.known)
    first = starts(v, w)
    v, w = v[first], w[first]
    return words, v, w, np.diff(first, append=len(n)), found_at(lay.common, words)[1][v], n


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == i)) for i in range(1, 5)]


def ends(blocks: DataFrame, lay: Layout) -> DataFrame:
    """(bucket, shard, kind, data): of the words of each shard those of a bucket, with the pairs that each
    ends; those of common words are told with one shard of theirs. SUMS: of 3-grams and of pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                out = []
                if kind == COUNTS:
                    words, v, w, c, hot, n = pairs_of(data, lay)
                    times = np.bincount(w[~hot], minlength=len(words))
                    out.append((shard, shard, SUMS, block(np.array([len(n), *counts_of_counts(n), *counts_of_counts(c[~hot])]))))
                    kind = ENDS
                else:
                    v, w, c, told = columns_of(data)
                    words = np.unique(np.concatenate([v, w]))
                    times = np.bincount(np.searchsorted(words, w[told == 1]), minlength=len(words))
                    out.append((shard, shard, SUMS, block(np.array([0] * 5 + counts_of_counts(c[told == 1])))))
                    kind = PAIR_ENDS
                bucket = lay.buckets(words)
                order = np.argsort(bucket, kind="stable")
                edge = [*starts(bucket[order]), len(order)]
                known = lay.words(words)
                for a, b in zip(edge, edge[1:]):
                    i = order[a:b]
                    usual = known.known[i]
                    out.append((int(bucket[i[0]]), shard, kind, block(steps(known.at[i[usual]]), np.diff(words[i[~usual]], prepend=_U(0)), times[i].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", *_NAMES])

    return blocks.mapInArrow(run, "bucket int, " + BLOCK)


def answered(asked: DataFrame, lay: Layout) -> DataFrame:
    """(shard, kind, data): for each block of ``ends`` its bucket and the sums over all shards. SUMS: those of a
    bucket, with distinct pairs, words and counts of counts, and the pairs that the end of a text ends."""
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("bucket", *_NAMES))))
        out, found = [], []
        for bucket, shard, kind, data in rows:
            if kind == SUMS:
                out.append((shard, SUMS, block(np.concatenate([columns_of(data)[0], np.zeros(7, np.int64)]))))
            else:
                at, other, times = columns_of(data)
                found.append((shard, kind, np.sort(np.concatenate([lay.known[np.cumsum(at, dtype=np.uint32)], np.cumsum(other, dtype=_U)])), times))
        if found:
            words = np.unique(np.concatenate([x[2] for x in found]))
            total = np.zeros(len(words), np.int64)
            places = [np.searchsorted(words, x[2]) for x in found]
            for at, (_, _, _, times) in zip(places, found):
                total[at] += times
            out += [(shard, kind, block(np.array([rows[0][0]]), total[at].astype(np.uint32))) for at, (shard, kind, _, _) in zip(places, found)]
            own = total[words == END].sum()
            out.append((rows[0][0], SUMS, block(np.array([0] * 9 + [total.sum(), np.count_nonzero(total), *counts_of_counts(total), own]))))
        return pa.Table.from_batches([batch_of(out)])

    return asked.groupBy("bucket").applyInArrow(run, BLOCK)


def common_pairs(counts: DataFrame, lay: Layout) -> DataFrame:
    """(v, w, c): pairs that a common word begins, over all its shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                words, v, w, c, hot, _ = pairs_of(data, lay)
                v, w = words[v], words[w]
                yield pa.RecordBatch.from_arrays([signed(v[hot]), signed(w[hot]), pa.array(c[hot])], names=["v", "w", "c"])

    return counts.select("data").mapInArrow(run, "v long, w long, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, lay: Layout) -> Model | None:
    """Counts of counts, and of each word of a shard the pairs that it ends."""
    spark = counts.sparkSession
    places = {int(w): lay.places(i) for i, w in enumerate(lay.common)}

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not found:
            return
        v, w, c = map(np.concatenate, zip(*found))
        v, w = v.view(_U), w.view(_U)
        for word in np.unique(v):
            i = np.flatnonzero(v == word)
            yield batch_of([(shard, PAIRS, block(v[i], w[i], c[i], np.full(len(i), k == 0).astype(np.int32))) for k, shard in enumerate(places[int(word)])])

    def joined(table: pa.Table) -> pa.Table:
        data = block(*map(np.concatenate, zip(*(columns_of(x) for x in table["data"].to_pylist()))))
        return pa.Table.from_batches([batch_of([(table["shard"][0].as_py(), PAIRS, data)])])

    known = common_pairs(counts, lay).mapInArrow(copied, BLOCK)
    blocks = counts.unionByName(materialise(known.groupBy("shard").applyInArrow(joined, BLOCK), "kn-pairs"))
    answers = materialise(answered(ends(blocks, lay), lay), "kn-ends")
    release(spark)
    # one short row for each shard
    sums = [columns_of(bytes(r["data"]))[0] for r in answers.where(F.col("kind") == SUMS).select("data").collect()]
    total = [int(x) for x in np.sum(sums, axis=0)] if sums else [0]
    if not total[0]:
        return None
    of = lambda x: {f"n{i}": n for i, n in enumerate(x, 1)}
    pairs, kinds, last = total[9], total[10], total[15]
    d1, d2, d3 = discounts(of(total[11:15])), discounts(of(total[5:9])), discounts(of(total[1:5]))
    many = kinds - sum(total[11:13])
    # the vocabulary and one unknown word share the discounts
    unseen = (d1[0] * total[11] + d1[1] * total[12] + d1[2] * many) / pairs / (kinds + 1)
    end = (last - float(discounted(np.array([last]), d1)[0])) / pairs + unseen
    blocks = blocks.unionByName(answers.where(F.col("kind") != SUMS))
    return Model(blocks, spark.createDataFrame([(int(w),) for w in lay.common.view(np.int64)], "word long"), lay, d1, d2, d3, pairs, float(np.log2(unseen)), float(np.log2(end / unseen)), lay.slices)


def discounted(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


class Weights:
    """The weights of the n-grams of one shard.

    With G(c) the log2 of a context's back-off weight, log2 p(w | u v) is the log2 of the
    probability of an unseen word, plus that of w less that (the weight of w as the last word)
    and the weights of
      (v):      G(v), and its weight as the last word;
      (. v w):  log2 p(w | v) - G(v) - log2 p(w);
      (u v .):  G(u v);
      (u v w):  log2 p(w | u v) - G(u v) - log2 p(w | v)
    summed over a text: each v but the mark before it was the last word once."""

    def __init__(self, blocks: list[tuple[int, bytes]], m: dict):
        lay, (d1, d2, d3), pairs, unseen = m["layout"], m["d"], m["all"], m["unseen"]
        none = np.zeros(0, np.int64)
        kinds = dict(blocks)
        own, u, v, w, n = grams_of(kinds[COUNTS], lay.known) if COUNTS in kinds else [none.view(_U), none, none, none, none]
        hv, hw, hc, _ = columns_of(kinds[PAIRS]) if PAIRS in kinds else [none.view(_U), none.view(_U), none, none]
        common = np.unique(np.concatenate([hv, hw]))
        self.words = np.unique(np.concatenate([own, common]))
        self.size = size = len(self.words)
        p1 = np.zeros(size)
        for words, kind in ((own, ENDS), (common, PAIR_ENDS)):
            answers = sorted((int(b[0]), x) for k, data in blocks if k == kind for b, x in [columns_of(data)])
            order = np.argsort(lay.buckets(words), kind="stable")
            times = np.concatenate([none, *(x for _, x in answers)])
            p1[np.searchsorted(self.words, words[order])] = np.where(times > 0, (times - discounted(times, d1)) / pairs + 2.0 ** unseen, 0.0)
        if len(own):
            u, v, w = (np.searchsorted(self.words, own)[x] for x in (u, v, w))
        # pairs: counted here, or over all shards of a common word
        first = starts(v, w)
        a, b, c = v[first], w[first], np.diff(first, append=len(v))
        here = ~found_at(lay.common, self.words)[1][a]
        a, b, c = (np.concatenate([x[here], y]) for x, y in ((a, np.searchsorted(self.words, hv)), (b, np.searchsorted(self.words, hw)), (c, hc)))
        self.pairs = a * size + b
        order = np.argsort(self.pairs)
        self.pairs, a, b, c = self.pairs[order], a[order], b[order], c[order]
        total, off = np.bincount(a, c, size), np.bincount(a, discounted(c, d2), size)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, off / total, 1.0)
            self.single = np.where(p1 > 0, np.log2(p1) - unseen, 0.0) + np.log2(back)
        under = back[a] * p1[b]
        p2 = (c - discounted(c, d2)) / total[a] + under
        self.pair = np.log2(p2 / under)
        self.contexts, at = np.unique(v * size + u, return_inverse=True)
        given = np.bincount(at, discounted(n, d3), len(self.contexts))
        self.context = np.log2(given / np.bincount(at, n, len(self.contexts)))
        i = np.searchsorted(self.pairs, v * size + w)
        self.grams = i * size + u  # in order, as 3-grams are by v, w and u
        self.gram = np.log2(1 + (n - discounted(n, d3)) / given[at] / p2[i]) if len(n) else np.zeros(0)
        for x in ("single", "pair", "context", "gram"):  # whole units: their sum does not depend on the order
            setattr(self, x, np.round(getattr(self, x) * UNIT))

    def of(self, words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Units of each 3-gram with its shorter ones; an n-gram not seen weighs nothing."""
        at, known = found_at(self.words, words)
        number = np.where(known, at, -1)
        u, v, w = number[u], number[v], number[w]
        out = np.zeros(len(v))
        if not self.size:
            return out
        out += np.where(v >= 0, self.single[v], 0.0)
        ask = np.flatnonzero((v >= 0) & (u >= 0))
        at, known = found_at(self.contexts, v[ask] * self.size + u[ask])
        out[ask[known]] += self.context[at[known]]
        ask = np.flatnonzero((v >= 0) & (w >= 0))
        at, known = found_at(self.pairs, v[ask] * self.size + w[ask])
        ask, at = ask[known], at[known]
        out[ask] += self.pair[at]
        seen = u[ask] >= 0
        ask, at = ask[seen], at[seen]
        i, known = found_at(self.grams, at * self.size + u[ask])
        out[ask[known]] += self.gram[i[known]]
        return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text") -> Model | None:
    """Counts of the trusted documents."""
    spark = docs.sparkSession
    small_batches(spark, 250)
    ids = trusted(labels, key)
    ids = ids.where(~held_out("__k"))
    all_texts = docs.select(F.col(key).alias("__k"), F.col(text_col).alias("text"))
    n = ids.count()
    lay = layout(all_texts, n)
    # labels grow with the corpus, so they are never broadcast: one plan at every size
    texts = maybe(all_texts, ids, n).join(ids.hint("merge"), "__k")  # a semi join would be moved below the bitmaps
    counts = materialise(count_grams(texts, "text", lay), "kn-counts")
    release(spark)
    return fit(counts, lay)


def maybe(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose ``__k`` may be among the ids: bitmaps of bounded size let through about an eighth of
    the others (more of them where ids are very many), so that most texts are not shuffled to be dropped."""
    bitmaps = min(max(8 * n // BITMAP, 1), BITMAPS)
    h = F.xxhash64(F.col("__k").cast("string"), F.lit(11))
    group, bit = F.pmod(h, F.lit(bitmaps)), F.pmod(F.shiftright(h, 24), F.lit(BITMAP))
    marks = ids.select(group.alias("__g"), bit.alias("__b")).groupBy("__g").agg(F.bitmap_construct_agg("__b").alias("__m"))
    byte = F.conv(F.hex(F.substring("__m", (F.col("__b") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    rows = rows.withColumn("__g", group).withColumn("__b", bit).join(F.broadcast(marks), "__g")
    return rows.where(F.floor(byte / F.pow(F.lit(2.0), F.col("__b") % 8)) % 2 == 1).select("__k", "text")


def trusted(labels: DataFrame, key: str) -> DataFrame:
    return labels.where(F.col("quality") == 1).select(F.col(key).alias("__k")).distinct()


def held_out(key: str) -> Column:
    return crc_mod(key, HELD_OUT) == 0


def weight_sums(rows: DataFrame, model: Model) -> DataFrame:
    """(rid, bits): the weights of all n-grams of the rows of each ``rid``, summed."""
    spark, lay = rows.sparkSession, model.layout
    numbers = {"layout": lay, "d": (model.d1, model.d2, model.d3), "all": model.all, "unseen": model.unseen}

    def asked(part: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for piece in pieces(texts):
                for shard, words, (u, v, w, d, n) in dealt(lay, piece, part):
                    names, d = np.unique(d, return_inverse=True)
                    yield batch_of([(shard, ASKED, gram_block(words, u, v, w, n.astype(np.uint32), d.astype(np.uint32), piece.rids[names]))])

        return rows.select("rid", "text").mapInArrow(run, BLOCK)

    def summed(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        weights = Weights([(int(kinds[i]), table["data"][int(i)].as_py()) for i in np.flatnonzero(kinds != ASKED)], numbers)
        rid, units = [], []
        for i in np.flatnonzero(kinds == ASKED):
            words, u, v, w, n, d, rids = grams_of(table["data"][int(i)].as_py(), lay.known)
            rid.append(rids)
            units.append(np.bincount(d, n * weights.of(words, u, v, w), len(rids)))
        rid = np.concatenate([np.zeros(0, np.int64), *rid])
        return pa.table({"rid": rid, "units": np.concatenate([np.zeros(0), *units]).astype(np.int64)})

    sums = None
    for part in range(lay.slices):
        blocks = model.blocks.where(F.pmod("shard", F.lit(lay.slices)) == part)
        found = asked(part).unionByName(blocks).groupBy("shard").applyInArrow(summed, "rid long, units long").groupBy("rid").agg(F.sum("units").alias("units"))
        found = materialise(found, f"kn-sums{part}")
        release(spark)
        sums = found if sums is None else sums.unionByName(found)
    return sums.groupBy("rid").agg((F.sum("units") / UNIT).alias("bits"))


HAS_WORD = r"[^\x20\x09-\x0D]"


def row_id(key: str, text_col: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text_col))


def perplexity(docs: DataFrame, model: Model, key: str, text_col: str, lang_col: str) -> DataFrame:
    """(rid, key, lang, n, words, bits) of every row: bits is the negative log2 probability of
    ``words`` words (the end of the text is one); null without text."""
    small_batches(docs.sparkSession, 250)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [(len(t), len(t.encode("utf-8", "surrogatepass").split()) + 1) if t and not t.isspace() else (0, 0) for t in batch.column(3).to_pylist()]
            n, words = (pa.array([s[i] for s in seqs], pa.int64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), n, words], names=["rid", "key", "lang", "n", "words"])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(row_id(key, text_col).alias("rid"), F.col(key).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = materialise(src.mapInArrow(run, f"rid long, key {kind}, lang string, n long, words long"), "kn-rows")
    sums = weight_sums(src.select("rid", "text"), model)
    # rows of one id and text were summed together
    each = rows.groupBy("rid").agg(F.count("*").alias("copies")).join(sums.hint("merge"), "rid", "left")
    each = each.select("rid", (F.coalesce("bits", F.lit(0.0)) / F.col("copies")).alias("sum"))
    return rows.join(each.hint("merge"), "rid").select(
        "rid", "key", "lang", "n", "words", F.when(F.col("words") > 0, -(F.col("words") * F.lit(model.unseen) + model.end + F.col("sum"))).alias("bits"))


def judged(docs: DataFrame, labels: DataFrame, key: str, text_col: str, lang_col: str, quantile: float, slack: float) -> DataFrame | None:
    """(rid, key, lang, n, perplexity, threshold, kept) of every row; None without trusted text."""
    model = train(docs, labels, key, text_col)
    if model is None:
        return None
    scored = materialise(perplexity(docs, model, key, text_col, lang_col), "kn-bits")
    known = scored.where(F.col("bits").isNotNull()).join(trusted(labels, key).withColumnRenamed("__k", "key").hint("merge"), "key", "left_semi")
    known = materialise(known.withColumn("out", held_out("key")), "kn-trusted")
    if not known.where("out").isEmpty():
        known = known.where("out")
    rate = known.agg(F.sum("bits") / F.sum("words")).first()[0]
    ppl = F.pow(F.lit(2.0), (F.col("bits") + PRIOR_WORDS * rate) / (F.col("words") + PRIOR_WORDS))
    limit = (F.percentile_approx(ppl, quantile, 10_000) * slack).alias("__t")
    # written, so that the planner knows how small it is when it picks the join
    by_lang = materialise(known.groupBy(F.col("lang").alias("__l")).agg(limit), "limits")
    overall = known.agg(limit).first()[0]
    out = scored.withColumn("perplexity", ppl).join(by_lang, F.col("lang").eqNullSafe(F.col("__l")), "left").withColumn("threshold", F.coalesce("__t", F.lit(overall)))
    return out.select("rid", "key", "lang", "n", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(key, lang, n, perplexity, threshold, kept) of every document."""
    out = judged(docs, labels, key, text_col, lang_col, quantile, slack)
    if out is None:
        return docs.select(F.col(key), F.col(lang_col).cast("string").alias("lang"), F.length(text_col).cast("long").alias("n"),
                           F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"),
                           F.coalesce(F.col(text_col).rlike(HAS_WORD), F.lit(False)).alias("kept"))
    return out.select(F.col("key").alias(key), "lang", "n", "perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps."""
    out = judged(docs, labels, key, text_col, lang_col, quantile, slack)
    if out is None:
        return docs.where(F.col(text_col).rlike(HAS_WORD))
    # rows of one id and text in two languages may differ in their verdict
    good = out.where("kept").select(F.col("rid").alias("__r"), F.col("lang").alias("__l")).distinct()
    same = (row_id(key, text_col) == F.col("__r")) & F.col(lang_col).cast("string").eqNullSafe(F.col("__l"))
    return docs.join(good.hint("merge"), same, "left_semi")
