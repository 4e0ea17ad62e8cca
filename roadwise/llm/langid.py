"""Operator 10: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed from
left to right into the longest phrases that occur in that text; the entropy estimate is
phrases * log2(sample length) / characters, and the language with the smallest one wins.

The automata come from a bounded sample of every language: at most ``max_docs`` labelled rows
of smallest id hash and ``sample_chars`` characters (documented parameters). Every letter of
a sample is in its language's alphabet. The tasks build the automata, ``TOGETHER`` languages
at a time; with more languages each lot reads the texts once, and the best of the lots is
taken by an aggregate over (hash of the) text. The parse covers whole texts, in blocks of
``BLOCK`` characters (a phrase ends at a block's end): for alphabets of up to ``DENSE``
classes an automaton is a table of next states in which a missing transition leads to a
marked copy of the root's successor, so thousands of blocks advance by one character with one
table lookup, and the phrases are the visits to marked states. For larger alphabets, whose
table would be mostly empty, the transitions that exist are looked up by state and class.

Characters are lower-cased; everything but letters is a space and spaces in a row count
once; letters that no sample holds match nothing.

Edge cases: a null text or a text without letters is ``und`` with score 0; so is every text
when there is nothing to learn from; ties go to the language that sorts first; repeated rows
are judged each on its own; an empty table gives no rows; other columns are kept by
``identify`` only where named.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import small_batches

BLOCK = 512
WIDTH = 4096
SHARPNESS = 8.0
TOGETHER = 8  # languages whose automata a task holds
DENSE = 128  # classes up to which an automaton is a full table
SPACE, UNKNOWN = 0, 1  # classes before the letters of the samples


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions (class to next state) of each state of a code sequence's suffix automaton."""
    n = max(1, len(codes))
    link, length, last, size = [-1] * (2 * n), [0] * (2 * n), 0, 1
    rows: list[dict[int, int]] = [{}]
    for c in codes:
        cur = size
        size += 1
        rows.append({})
        length[cur] = length[last] + 1
        p = last
        while p >= 0 and c not in rows[p]:
            rows[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = rows[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = size
                size += 1
                rows.append(dict(rows[q]))
                length[clone], link[clone] = length[p] + 1, link[q]
                while p >= 0 and rows[p].get(c) == q:
                    rows[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return rows


class Dense:
    """The table as one array: entry state + class gives the offset of the next state; offsets
    from ``first_marked`` on belong to marked states. The last class pads."""

    def __init__(self, codes: list[int], alphabet: int):
        rows = automaton(codes)
        size, pad = len(rows), alphabet
        nxt = np.full((size, alphabet), -1, dtype=np.int32)
        for s, row in enumerate(rows):
            if row:
                nxt[s, list(row)] = list(row.values())
        root = nxt[0]
        # one marked copy for each class: what follows a break on that class
        marked = size + np.arange(alphabet, dtype=np.int32)
        table = np.empty((size + alphabet, alphabet + 1), dtype=np.int32)
        table[:size, :alphabet] = np.where(nxt >= 0, nxt, marked)
        table[0, :alphabet] = marked  # from the root every character begins a phrase
        table[:size, pad] = np.arange(size)
        after = np.where(root >= 0, root, 0)  # a marked state goes on like the root's successor
        table[size:] = table[after]
        # a class that the sample lacks is a phrase by itself: the root follows
        table *= alphabet + 1
        self.table, self.first_marked = table.ravel(), size * (alphabet + 1)

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        state = np.zeros(blocks.shape[1], dtype=np.int32)
        count = np.zeros(blocks.shape[1], dtype=np.int32)
        for row in blocks:
            state = self.table.take(state + row)
            count += state >= self.first_marked
        return count


class Sparse:
    """The same parse over the transitions that exist: each state's first one by state, the
    others by (state, class) in order."""

    def __init__(self, codes: list[int], alphabet: int):
        rows = automaton(codes)
        self.pad = alphabet
        self.start = np.zeros(alphabet + 1, dtype=np.int64)  # state after a break on a class
        self.start[list(rows[0])] = list(rows[0].values())
        self.only, self.next = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        self.more = np.zeros(len(rows), dtype=bool)
        others: list[tuple[int, int]] = []
        for s, row in enumerate(rows[1:], 1):  # from the root every character begins a phrase
            for i, (c, t) in enumerate(row.items()):
                if i:
                    self.more[s] = True
                    others.append((s * (alphabet + 1) + c, t))
                else:
                    self.only[s], self.next[s] = c, t
        others.sort()
        self.key, self.target = np.array([(-1, 0), *others], dtype=np.int64).T

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        state = np.zeros(blocks.shape[1], dtype=np.int64)
        count = np.zeros(blocks.shape[1], dtype=np.int32)
        for row in blocks:
            found, to = self.only[state] == row, self.next[state]
            at = np.flatnonzero(~found & self.more[state])
            if len(at):
                key = state[at] * (self.pad + 1) + row[at]
                place = np.minimum(self.key.searchsorted(key), len(self.key) - 1)
                found[at] = hit = self.key[place] == key
                to[at[hit]] = self.target[place[hit]]
            pad = row == self.pad
            count += ~found & ~pad
            state = np.where(pad, state, np.where(found, to, self.start[row]))
        return count


def sample(docs: DataFrame, key: str, text_col: str, lang_col: str, learn: Column, sample_chars: int,
           max_docs: int) -> dict[str, str]:
    """language -> sample text, as documented above."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    first = Window.partitionBy(lang_col).orderBy("__h", key)
    picked = (rows.select(F.col(key), F.col(lang_col), F.substring(text_col, 1, sample_chars).alias("__t"), F.xxhash64(key, F.lit(5)).alias("__h"))
              .withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= max_docs)
              .select(F.col(lang_col).alias("lang"), "__r", F.col("__t").alias("text")).collect())  # bounded for each language
    texts: dict[str, str] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["__r"])):
        texts[r["lang"]] = (texts.get(r["lang"], "") + r["text"] + "\n")[:sample_chars]
    return texts


@lru_cache(maxsize=4)
def _classes(letters: str) -> np.ndarray:
    """Class of every code point: space, unknown letter, or a known letter (lower-cased)."""
    known = {c: i + 2 for i, c in enumerate(letters)}
    lut = np.zeros(0x110000, dtype=np.uint8 if len(letters) < 254 else np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            lut[cp] = known.get(c.lower()[0], UNKNOWN)
    return lut


def classes(text: str, letters: str) -> np.ndarray:
    code = _classes(letters)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != SPACE) | (code[:-1] != SPACE)
    return code[keep]


class Model:
    """The automata of some languages. Texts are coded once over the letters of all of them;
    each automaton then sees its own alphabet."""

    def __init__(self, texts: dict[str, str]):
        self.letters = "".join(sorted({c.lower()[0] for t in texts.values() for c in t if c.isalpha()}))
        self.alphabet = 2 + len(self.letters)
        self.langs = sorted(texts)
        self.parsers, self.own, self.bits = [], [], []
        for lang in self.langs:
            codes = classes(texts[lang], self.letters)
            mine = np.union1d([SPACE, UNKNOWN], codes)
            own = np.full(self.alphabet + 1, UNKNOWN, dtype=np.int32)
            own[mine] = np.arange(len(mine))
            own[self.alphabet] = len(mine)  # pads
            self.parsers.append((Dense if len(mine) <= DENSE else Sparse)(own[codes].tolist(), len(mine)))
            self.own.append(own)
            self.bits.append(float(np.log2(max(2, len(codes)))))

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        """Phrase counts (blocks x languages) of a (BLOCK x blocks) class matrix."""
        out = np.empty((blocks.shape[1], len(self.langs)), dtype=np.int64)
        for j, (parser, own) in enumerate(zip(self.parsers, self.own)):
            out[:, j] = parser.phrases(own[blocks])
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character: texts x languages, has a letter)."""
        coded = [classes(t, self.letters) if t else np.empty(0, np.uint8) for t in texts]
        n = np.array([len(c) for c in coded], dtype=np.int64)
        letter = np.array([bool((c != SPACE).any()) for c in coded], dtype=bool)
        n_blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        total = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        for at in range(0, len(owner), WIDTH):
            mine = owner[at:at + WIDTH]
            grid = np.full((len(mine), BLOCK), self.alphabet, dtype=np.int32)
            first = int(np.searchsorted(owner, mine[0]))
            for d in np.unique(mine):
                lo, hi = np.searchsorted(mine, [d, d + 1])
                skip = (at - first) * BLOCK if d == mine[0] else 0
                part = coded[d][skip:skip + (hi - lo) * BLOCK]
                grid[lo:hi].reshape(-1)[:len(part)] = part
            np.add.at(total, mine, self.phrases(np.ascontiguousarray(grid.T)))
        return total * np.array(self.bits)[None, :] / np.maximum(n, 1)[:, None], letter

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language (``und`` without a letter), its entropy, and the sum over all languages
        of exp(-SHARPNESS * entropy beyond the best)."""
        h, letter = self.entropies(texts)
        low = h.min(axis=1)
        total = np.exp(-SHARPNESS * (h - low[:, None])).sum(axis=1)
        return [self.langs[b] if ok else "und" for b, ok in zip(h.argmin(axis=1), letter)], low, total


@lru_cache(maxsize=1)
def _model(texts: tuple[tuple[str, str], ...]) -> Model:
    """Built once in each Python worker."""
    return Model(dict(texts))


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_chars: int = 24_000, max_docs: int = 40) -> dict[str, str]:
    """The sample text of every language, from which the tasks build the automata."""
    return sample(docs, key, text_col, lang_col, learn, sample_chars, max_docs)


def identify(docs: DataFrame, model: dict[str, str], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score of every row's whole text."""
    small_batches(docs.sparkSession, 500)
    langs = sorted(model)
    lots = [tuple((x, model[x]) for x in langs[i:i + TOGETHER]) for i in range(0, len(langs), TOGETHER)]
    if not lots:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(lots) == 1:
        found = judged(docs.select(F.col(text_col).alias("__text"), *keep), lots[0])
        score = F.when(F.col("lang_pred") == "und", 0.0).otherwise(1 / F.col("total"))
        return found.select(*keep, "lang_pred", score.alias("score"))
    # a text is named by 128 bits of hashes, a row without a text by none
    name = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(11), c))
    a, b = name(F.col(text_col))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("__text"), a.alias("__a"), b.alias("__b"))
    each = None
    for lot in lots:
        one = judged(texts, lot)
        each = one if each is None else each.unionByName(one)
    # copies of a text in a lot are equal rows
    per_lot = each.withColumn("lot", F.col("first")).groupBy("__a", "__b", "lot").agg(
        F.first("lang_pred").alias("lang_pred"), F.first("low").alias("low"), F.first("total").alias("total"))
    best = per_lot.groupBy("__a", "__b").agg(
        F.min(F.struct("low", "lang_pred")).alias("best"), F.collect_list(F.struct("low", "total")).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda x, r: x + r["total"] * F.exp(-SHARPNESS * (r["low"] - F.col("best.low"))))
    best = best.select("__a", "__b", F.col("best.lang_pred").alias("__lang"), total.alias("__total"))
    out = docs.select(*keep, F.when(F.col(text_col).isNotNull(), a).alias("__a"), F.when(F.col(text_col).isNotNull(), b).alias("__b"))
    out = out.join(best, ["__a", "__b"], "left")
    return out.select(*keep, F.coalesce("__lang", F.lit("und")).alias("lang_pred"),
                      F.when(F.coalesce("__lang", F.lit("und")) == "und", 0.0).otherwise(1 / F.col("__total")).alias("score"))


def judged(src: DataFrame, lot: tuple[tuple[str, str], ...]) -> DataFrame:
    """``src`` (text first) with a lot's best language, entropy and sum, and the lot's first language."""
    keep = src.columns[1:]
    shared = src.sparkSession.sparkContext.broadcast(lot)
    fields = "".join(f"`{c}` {src.schema[c].dataType.simpleString()}, " for c in keep)
    names = [*keep, "lang_pred", "low", "total", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            langs, low, total = model.judge(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(low), pa.array(total),
                                              pa.array([model.langs[0]] * len(langs), pa.string())], names=names)

    return src.mapInArrow(run, fields + "lang_pred string, low double, total double, first string")
