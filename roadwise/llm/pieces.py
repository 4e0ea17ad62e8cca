"""Operator 12: SentencePiece (BPE) encoding and decoding by a prefix table.

The vocabulary is a SentencePiece BPE model file; its path is a parameter. For every prefix of
a run the table stores the one token that ends the encoding of that prefix:

* an automaton over the pieces lists the pieces that end at each place;
* of these exactly one may follow the token stored where it starts: two tokens are compatible
  when their joined text, merged by score, gives the two back;
* ids are then recovered backwards, from the whole run's last token to the first.

Merges cannot cross two neighbouring characters that no piece holds side by side, so a text is
cut there into runs (for a usual model: before each word's space, and around characters without
any merge). Runs repeat; each task keeps a cache of run -> ids of bounded characters, emptied
when full, which never changes a result. No shuffle: one pass over the table, any executor can redo any partition.

Edge cases: a null or empty text has no ids and decodes to the empty string; white space alone
is text; characters outside the vocabulary become byte pieces (or the unknown id, where the
model has none), U+2581 in a text reads as a space, as in the library; repeated rows are encoded
each on their own; other columns are dropped (``key`` and ``text_col`` name the two that are read).
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

SPACE = "▁"
LETTERS = "A-Za-z\u00c0-\u024f"  # one class of the cut; which one only matters for speed
LETTER = re.compile(f"[{LETTERS}]")
CACHE_CHARS = 8_000_000
CACHED_RUN = 64  # longer runs are not kept
CACHED_PAIRS = 2_000_000


class RunCache(dict):
    """run -> tuple of ids, filled on a miss, emptied when its runs hold too many characters."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.held = encode, limit, 0

    def __missing__(self, run: str) -> tuple[int, ...]:
        out = tuple(self.encode(run))
        if len(run) <= CACHED_RUN:
            if self.held >= self.limit:
                self.clear()
                self.held = 0
            self.held += len(run) + 32
            self[run] = out
        return out


class Pieces:
    """One model: cutting into runs, the prefix table of a run, decoding."""

    def __init__(self, path: str):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("a model with unused pieces is not supported: the library cuts those up again")
        self.bytes = {i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) for i in ids if sp.is_byte(i)}
        self.byte_id = {b[0]: i for i, b in self.bytes.items()}
        self.hidden = {i for i in ids if sp.is_control(i)}
        self.unknown, self.unknown_text = sp.unk_id(), sp.decode([sp.unk_id()])
        self.text = {i: sp.id_to_piece(i) for i in ids if i not in self.bytes and i not in self.hidden and i != self.unknown}
        self.id = {t: i for i, t in self.text.items()}
        self.shown = self.bytes | {i: t.replace(SPACE, " ").encode() for i, t in self.text.items()}
        scores = sorted({sp.get_score(i) for i in self.text}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        #: piece -> place of its merge, the best first
        self.rank = {t: place[sp.get_score(i)] for t, i in self.id.items()}
        self.none = len(scores)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        long = [t for t in self.id if len(t) > 1]
        for t in long:
            if self.merge(t) == [t]:  # no other piece can come out of merging
                self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        # Texts can be cut between characters that no piece holds side by side: before a space,
        # at the end of a line, between letters and other characters.
        joined = {(a, b) for t in long for a, b in zip(t, t[1:]) if a != SPACE}
        cut_line = not any("\n" in t for t in long)
        cut_letters = not any(bool(LETTER.match(a)) != bool(LETTER.match(b)) for a, b in joined)
        other = f"{SPACE}\n" if cut_line else SPACE
        words = f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{LETTERS}{other}]+" if cut_letters else f"{SPACE}*[^{other}]+"
        self.runs = re.compile("(?s:.+)" if any(b == SPACE for _, b in joined) else f"{words}|{SPACE}+" + ("|\n" if cut_line else ""))
        self.cache = RunCache(self.encode_run, CACHE_CHARS)
        # A model without any normalisation but the space in front and U+2581 for spaces.
        every = "".join(map(chr, chain(range(1, 0xD800), range(0xE000, 0x110000))))
        self.plain = all(sp.normalize(t) == SPACE + t.replace(" ", SPACE) for t in (every, "  a  b "))

    def merge(self, text: str) -> list[str]:
        """The definition of an encoding: the best adjacent pair first, of equals the leftmost."""
        parts, rank, none = list(text), self.rank.get, self.none
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether merging the joined text gives the two tokens back."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.pairs[pair] = self.merge(pair[0] + pair[1]) == [*pair]
        return known

    def last_tokens(self, run: str) -> list[str]:
        """The prefix table: the last token of every prefix's encoding, a single character
        unless a longer piece fits. Matches come by their end, so what they follow is settled."""
        last, known, settled = list(run), self.pairs.get, -1
        for end, piece in self.automaton.iter(run):
            if end == settled:
                continue
            start = end + 1 - len(piece)
            if start:
                pair = last[start - 1], piece
                fits = known(pair)
                if not (self.compatible(pair) if fits is None else fits):
                    continue
            last[end], settled = piece, end
        return last

    def encode_run(self, run: str) -> list[int]:
        last, at, back = self.last_tokens(run), len(run), []
        while at:
            back.append(last[at - 1])
            at -= len(back[-1])
        out: list[int] = []
        for token in reversed(back):
            if (i := self.id.get(token)) is not None:
                out.append(i)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in token.encode())
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one
                out.append(self.unknown)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        text = SPACE + text.replace(" ", SPACE) if self.plain else self.library.normalize(text)
        return np.fromiter(chain.from_iterable(map(self.cache.__getitem__, self.runs.findall(text))), dtype=np.int32)

    def decode(self, ids) -> str:
        """The pieces joined, byte pieces read as UTF-8 (a broken byte is U+FFFD), spaces put back,
        the one in front taken away; control ids show nothing."""
        try:
            out = b"".join(map(self.shown.__getitem__, ids)).decode()
        except (KeyError, UnicodeDecodeError):
            return self._decode_any(ids)
        return out[1:] if out[:1] == " " and ids[0] in self.text else out

    def _decode_any(self, ids) -> str:
        shown: list[list[int]] = [[]]
        for i in ids:  # a control id ends a row of bytes
            if i in self.hidden:
                shown.append([])
            else:
                shown[-1].append(i)
        unknown, out = self.unknown_text.encode(), []
        for part in filter(None, shown):
            data = [self.shown.get(i, unknown) for i in part]
            if not out and part[0] in self.text:
                data[0] = data[0].removeprefix(b" ")
            out.append(b"".join(data).decode("utf-8", "one-by-one"))
        return "".join(out)


codecs.register_error("one-by-one", lambda e: ("\ufffd", e.start + 1))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pieces(model).encode
        for batch in batches:
            rows = [enc(t.as_py()) for t in batch.column(1)]
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text of each id list; a null list decodes to ''."""
    @F.pandas_udf("string")
    def texts(ids):
        dec = pieces(model).decode
        return ids.map(lambda x: "" if x is None else dec(x.tolist()))

    return encoded.withColumn(out_col, texts(F.col(ids_col)))
