"""Operator 5: toxicity scores from subword-bag embeddings.

A text is the bag of the character 3- to 5-grams of its lower-cased words (word edges
included), hashed to ``BUCKETS``. Each bucket has a vector; the vectors of the bag are
averaged and a linear softmax over (clean, toxic) reads the average. Vectors and softmax are
trained jointly in numpy, by AdaGrad on the cross entropy, with both classes weighted alike; the bias is then moved by
the log odds of the two classes among all labelled training rows, so the score is a
probability at their true rate.
A misspelling never seen still shares most of its n-grams, hence vectors.

Training takes at most ``max_docs`` labelled rows of each class, those of smallest id hash
(a documented bound), so the driver holds a bounded table. Since the softmax is linear, a
bucket contributes one number to a text's log odds; scoring sums these numbers over the
whole text in one pass, without any shuffle.

Edge cases: a null or empty text, or one without words, has the score of an empty bag (the
bias alone); without labels of both classes every score is 0.5's lower neighbour, 0 (nothing
is predicted toxic); repeated rows score alike; repeated labels of an id count as toxic if
any of them is; an empty table gives no rows; other columns are dropped unless kept by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix64, sample_by_hash, slices, small_batches

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
DIM = 8
GAIN = 100.0  # scale of the averages: toxic words are about one in a hundred
_KEYS = mix64(np.arange(1, 1 + max(SIZES), dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower-cased letter of each code point; 0 for everything that ends a word."""
    lut = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha() or c.isdigit():
            lut[cp] = ord(c.lower()[0])
    return lut


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every subword of every text."""
    data = [t or "" for t in texts]
    sizes = np.array([len(t) + 1 for t in data], dtype=np.int64)
    pad = max(SIZES)
    code = _lower()[np.frombuffer(("\0" + "\0".join(data) + "\0" * pad).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    owner = np.repeat(np.arange(len(data), dtype=np.int32), sizes)  # of the window that begins before each character
    n = len(owner)
    wide = code.astype(np.uint64)
    sums = wide[:n] * _KEYS[0] + wide[1:n + 1] * _KEYS[1]
    inner = code[1:n + 1] != 0
    out, who = [], []
    for k in SIZES:
        if k > 3:
            inner = inner & (code[k - 2:n + k - 2] != 0)
        sums = sums + wide[k - 1:n + k - 1] * _KEYS[k - 1]
        at = np.flatnonzero(inner)
        out.append((mix64(sums[at] + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32))
        who.append(owner[at])
    return np.concatenate(out), np.concatenate(who)


class Trainer:
    """Joint training of subword vectors and softmax on bags as (ids, shares, starts)."""

    def __init__(self, n_features: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (n_features, DIM)).astype(np.float32)
        self.weights = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.seen = [np.full_like(p, 1e-6) for p in (self.vectors, self.weights, self.bias)]

    def _step(self, i: int, grad: np.ndarray, rate: float) -> None:
        p = (self.vectors, self.weights, self.bias)[i]
        self.seen[i] += grad * grad
        p -= rate * grad / np.sqrt(self.seen[i])

    def batch(self, ids: np.ndarray, share: np.ndarray, owner: np.ndarray, y: np.ndarray, importance: np.ndarray, rate: float) -> float:
        n = len(y)
        v = self.vectors[ids] * share[:, None]
        hidden = np.stack([np.bincount(owner, v[:, d], n) for d in range(DIM)], axis=1).astype(np.float32)
        z = hidden @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        loss = float((-np.log(np.maximum(p[np.arange(n), y], 1e-9)) * importance).mean())
        p[np.arange(n), y] -= 1
        p *= importance[:, None] / n
        back = (p @ self.weights.T)[owner] * share[:, None]
        grad = np.stack([np.bincount(ids, back[:, d], len(self.vectors)) for d in range(DIM)], axis=1).astype(np.float32)
        self._step(1, hidden.T @ p, rate)
        self._step(2, p.sum(axis=0), rate)
        self._step(0, grad, rate)
        return loss


def fit(bag_ids: list[np.ndarray], bag_counts: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.3,
        seed: int = 7, least_docs: int = 1) -> tuple[np.ndarray, float]:
    """(contribution of each bucket to the log odds, bias). Buckets of fewer than
    ``least_docs`` training texts say nothing (the zero vector): they could only be learned by
    heart."""
    n_docs = np.zeros(BUCKETS, dtype=np.int32)
    for b in bag_ids:
        n_docs[b] += 1  # ids of a bag are distinct
    features = np.flatnonzero(n_docs >= least_docs).astype(np.int32)
    known = [n_docs[b] >= least_docs for b in bag_ids]
    totals = [max(1, c.sum()) for c in bag_counts]
    bag_ids = [b[k] for b, k in zip(bag_ids, known)]
    bag_counts = [c[k] for c, k in zip(bag_counts, known)]
    flat = np.searchsorted(features, np.concatenate(bag_ids)).astype(np.int32)
    lengths = np.array([len(b) for b in bag_ids])
    ends = np.cumsum(lengths)
    share = np.concatenate([(GAIN * c / n).astype(np.float32) for c, n in zip(bag_counts, totals)])
    share_of_class = np.bincount(y, minlength=2) / len(y)
    importance = (0.5 / np.maximum(share_of_class, 1e-9))[y].astype(np.float32)
    model, rng = Trainer(len(features), seed), np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            take = np.concatenate([np.arange(ends[r] - lengths[r], ends[r]) for r in rows])
            model.batch(flat[take], share[take], np.repeat(np.arange(len(rows)), lengths[rows]), y[rows], importance[rows],
                        rate * (1 - epoch / epochs))
    odds = np.zeros(BUCKETS, dtype=np.float32)
    direction = model.weights[:, 1] - model.weights[:, 0]
    odds[features] = GAIN * (model.vectors @ direction)
    return odds, float(model.bias[1] - model.bias[0])


def sample_bags(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text_col: str, label_col: str, max_docs: int):
    """Bags of the training sample (ids, counts, labels; at most ``max_docs`` of each class) and
    the number of labelled rows of each class."""
    known = (labels.where(F.col(key).isNotNull() & F.col(label_col).isNotNull() & learn)
             .groupBy(key).agg(F.max(label_col).cast("int").alias("__y"))
             .where(F.col("__y").isin(0, 1)))
    sizes = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}  # two rows
    picked = sample_by_hash(known.where(F.col("__y") == 1), key, max_docs).unionByName(sample_by_hash(known.where(F.col("__y") == 0), key, max_docs))
    src = docs.select(F.col(key), F.col(text_col).alias("__text")).join(F.broadcast(picked), key)  # at most 2 * max_docs ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, 500_000):
                ids, who = bags(texts[a:b])
                code, n = np.unique(who.astype(np.int64) * BUCKETS + ids, return_counts=True)
                cuts = pa.array(np.searchsorted(code, np.arange(b - a + 1) * BUCKETS).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(cuts, pa.array((code % BUCKETS).astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32))), batch.column(1)[a:b], batch.column(2)[a:b]],
                    names=["ids", "n", "y", "k"])

    kind = docs.schema[key].dataType.simpleString()
    rows = src.select("__text", "__y", key).mapInArrow(run, f"ids array<int>, n array<int>, y int, k {kind}").toArrow().combine_chunks()
    order = pc.sort_indices(rows, [("k", "ascending"), ("y", "ascending")]).to_numpy()
    if not len(order):
        return [], [], np.empty(0, np.int64), sizes

    def parts(name: str) -> list[np.ndarray]:
        column = rows.column(name).chunk(0)
        flat, at = column.values.to_numpy(), column.offsets.to_numpy()
        return [flat[at[i]:at[i + 1]] for i in order]

    ids, counts, y = parts("ids"), parts("n"), rows.column("y").to_numpy()[order]
    some = [i for i, bag in enumerate(ids) if len(bag)]
    return [ids[i] for i in some], [counts[i] for i in some], y[some].astype(np.int64), sizes


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_docs: int = 2000, least_docs: int = 5) -> tuple[np.ndarray, float] | None:
    small_batches(docs.sparkSession, 200)
    ids, counts, y, sizes = sample_bags(docs, labels, learn, key, text_col, label_col, max_docs)
    if len(set(y.tolist())) < 2:
        return None
    odds, bias = fit(ids, counts, y, least_docs=least_docs)
    return odds, bias + float(np.log(sizes[1] / sizes[0]))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with score (probability of toxic) and predicted."""
    small_batches(docs.sparkSession, 200)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            if model is None:
                p = np.zeros(n)
            else:
                texts, z = batch.column(0).to_pylist(), np.empty(n)
                for a, b in slices(texts, 500_000):
                    ids, who = bags(texts[a:b])
                    z[a:b] = np.bincount(who, model[0][ids], b - a) / np.maximum(np.bincount(who, minlength=b - a), 1) + model[1]
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])

    src = docs.select(F.col(text_col).alias("__text"), *[F.col(c) for c in keep])
    return src.mapInArrow(run, f"{fields}, score double, predicted int")
