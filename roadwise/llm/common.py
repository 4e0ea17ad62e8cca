"""Shared helpers: written intermediate tables, byte-level words, 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes; the separators are ASCII, so byte and
code point splitting agree.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, release  # noqa: F401

# --------------------------------------------------------------------------- storage


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with a columnar, compressed table that outlives any executor. Each
    call takes a new folder, so two runs never share a table. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` whole texts in an Arrow batch: ten thousand long texts, and their
    copies in the worker, would not fit beside the heap of a small executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str | Column, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod`` (the fold of a row)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


def fold_of(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def sample_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest key hash: a repeatable bounded sample (top-n per task,
    then a merge of n rows per task)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(7)), F.col(key)).limit(n)


# --------------------------------------------------------------------------- hashing

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on an array of uint64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _odd(n: int, seed: int) -> np.ndarray:
    i = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return mix64(i + _U(seed)) | _U(1)


_BYTE = _odd(256, 11)
_POS = _odd(4096, 23)


def _position_keys(n: int) -> np.ndarray:
    global _POS
    if n > len(_POS):
        _POS = _odd(1 << (int(n) - 1).bit_length(), 23)
    return _POS


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 ``data``, A-Z lowered. ``bytes.lower`` touches A-Z only,
    and ``bytes.split`` cuts at the six separators."""
    words = data.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U, count=len(words))


_WORD = _odd(64, 41)


def shingle_hashes(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; with fewer words the whole
    sequence is one shingle; without words the result is empty."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(width, len(w))
    n = len(w) - k + 1
    total = np.full(n, k, dtype=_U)
    for j in range(k):
        total += w[j:j + n] * _WORD[j]
    return np.unique(mix64(total))


def slices(texts: list[str | None], limit: int = 1_500_000):
    """(from, to) of runs of texts of at most ``limit`` characters together (a longer text is
    alone), so that arrays over all characters of a run stay small."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def utf8(value: str | None) -> bytes:
    return value.encode("utf-8", "surrogatepass") if value else b""
