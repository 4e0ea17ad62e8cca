"""Operator 1: BPE encoding and decoding.

The vocabulary is a ``tokenizers`` JSON file with merges and an end-of-word suffix; the
file path is a parameter. Text is cut at special-token strings, normalised (NFC, white
space, lower case) and split into words; each word's bytes are merged by rank:

* short words hold their part boundaries and the rank of every adjacent pair in two plain
  arrays, scan for the smallest rank, delete that boundary and refresh the two
  neighbouring ranks;
* longer words take the same merges in the same order from a heap over a linked list.

Words repeat, so each task keeps a bounded cache of word -> ids; the cache is emptied when
full, and never changes a result. No shuffle: one pass over the table, any executor can
redo any partition.

Edge cases: a null or empty text encodes to no ids and decodes to the empty string; white
space alone gives no ids; repeated rows are encoded each on their own; other columns are
dropped (``key`` and ``text_col`` name the two that are read).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

SHORT_WORD = 48
CACHED_WORD = 64
CACHE_CHARS = 8_000_000  # with 32 for each word
# White_Space code points of Unicode (fixed values); the regex module's own \s also holds U+001C-1F.
_WS = r"\t-\r \x85\xa0  -     　"
_SPACES = regex.compile(f"[{_WS}]+")

# Word pattern of the vocabulary file (fixed value).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _WS + r"\p{L}\p{N}]+")


def _new_letters() -> frozenset[str]:
    """Letters and numbers that the interpreter's Unicode tables do not know yet. The regex
    module and the tokenizers library may disagree on them, so texts that hold one are cut
    into words by the library itself."""
    points = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x20000), range(0x2F000, 0x40000))))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", points) if unicodedata.category(c)[0] not in "LN")


_NEW = _new_letters()
_HIGH = re.compile(f"[{min(_NEW)}-\U0010ffff]")  # one range: a quick look before the set


def _byte_alphabet() -> list[str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the other
    bytes take the code points from 256 on, in order."""
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordCache(dict):
    """word -> tuple of ids, filled on a miss, emptied when its words hold too many characters;
    long words are not kept."""

    def __init__(self, codec: "Codec", limit: int):
        super().__init__()
        self.codec, self.limit, self.held = codec, limit, 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = tuple(self.codec.encode_word(word))
        if len(word) <= CACHED_WORD:
            if self.held >= self.limit:
                self.clear()
                self.held = 0
            self.held += len(word) + 32
            self[word] = out
        return out


class Codec:
    """The vocabulary of one file, with encode and decode of single texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        alphabet = _byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        # (left id, right id) -> rank, and rank -> merged id
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.byte = {c: b for b, c in enumerate(alphabet)}
        self.cache = WordCache(self, CACHE_CHARS)
        self.path, self.library = path, None

    def encode_word(self, word: str) -> list[int]:
        return self.encode_bytes(word.encode("utf-8"))

    def encode_bytes(self, data: bytes) -> list[int]:
        inner = self.inner
        parts = [inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return self._scan(parts) if len(parts) <= SHORT_WORD else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, none = self.rank.get, len(self.merged)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i] = self.merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank, n = self.rank.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := rank((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (q, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (q := rank((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (q, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def _plain(self, text: str) -> Iterator[int]:
        if not text.isascii():
            if _HIGH.search(text) and not _NEW.isdisjoint(text):
                return chain.from_iterable(map(self.encode_bytes, self._library_words(text)))
            # lower case code point by code point: no final sigma
            text = _SPACES.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")
        return chain.from_iterable(map(self.cache.__getitem__, _WORDS.findall(text.lower())))

    def _library_words(self, text: str) -> Iterator[bytes]:
        t = self.library = self.library or Tokenizer.from_file(self.path)
        for word, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text)):
            yield bytes(self.byte[c] for c in word)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        if not any(t in text for t in self.special):
            return np.fromiter(self._plain(text), dtype=np.int32)
        out: list[int] = []
        for piece in self.cut.split(text):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out.extend(self._plain(piece))
        return np.array(out, dtype=np.int32)

    def decode(self, ids) -> str:
        """The tokens with one space between (the file names no decoder); unknown ids are skipped."""
        token = self.token
        try:
            return " ".join([token[i] for i in ids])
        except KeyError:
            return " ".join([token[i] for i in ids if i in token])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(vocabulary).encode
        for batch in batches:
            rows = [enc(t.as_py()) for t in batch.column(1)]
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text of each id list; a null list decodes to ''."""
    @F.pandas_udf("string")
    def texts(ids):
        dec = codec(vocabulary).decode
        return ids.map(lambda x: "" if x is None else dec(x.tolist()))

    return encoded.withColumn(out_col, texts(F.col(ids_col)))
