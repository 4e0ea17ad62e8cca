"""Operator 4: exact set similarity join on word 5-grams (Jaccard >= 0.75), by the
universe-partition pigeonhole principle.

Sets of sizes r <= s with Jaccard >= 3/4 differ in at most H = floor((r + s) / 7) elements.
The universe of shingles is cut by hash into the m segments of a size band (sizes lo to
2 lo - 1, m = lo + 64). Of the segments that are not empty in a set, more than H are there,
so two similar sets agree on a whole non-empty segment. Each set gives signatures (hash of
segment number and content) for its own band, and for the next lower band where a similar
set can lie.

* Allocation. How common each signature is, is counted over the whole corpus; a set uses its
  H + 1 rarest segments (an order that all sets share, so the agreeing segment with the
  rarest content is used by both) and skips the others, among them passages that very many
  documents hold.
* One-deletion neighbourhoods. Where some set of a band has too few non-empty segments for
  that, all sets of the band also give, for each segment of two or more elements, the
  signatures of the segment without one element; such a segment then tolerates one
  difference and counts twice. If even that is too little, the band takes another hash.

Candidates of a signature are compared with one member first (a star; all pairs for up to
``SMALL`` members). After joining what is linked, members outside their group's main
component are compared with the member of another component that looks nearest, and what is
then still apart with every member of another component that can be near enough; so groups
of thousands of near copies never become all pairs. "Looks" and "can" mean a parity sketch:
the distance of two sketches never exceeds the symmetric difference, so discarding by it
loses nothing. What remains is verified exactly on the shingles of the whole texts.
Documents with equal sets are one representative throughout, told apart by 128 bits.

Edge cases: null or empty texts and texts of white space alone have no shingles and link
with nothing (their own id is their component); a row with a null id takes the component of
its equal texts, or null; repeated rows and repeated ids share a set's component; an empty
table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _odd, materialise, mix64, shingle_hashes, small_batches, utf8
from .components import components

SMALL = 4
HOT_ROWS = 1 << 15  # most common signatures that the allocation knows (an order only)
HOT_LEAST = 6
SALTS = 4
BLOCK = 2048  # members of a large group that one comparison holds
_U = np.uint64
_SALT = _odd(SALTS, 97)


def band_of(n: int) -> int:
    return n.bit_length() - 1


def segments_of(band: int) -> int:
    return (1 << band) + 64


def differences(n: int, band: int) -> int | None:
    """Most elements in which a set of size n and a similar one that meets it in the band can
    differ, or None if there is none. In the band of n itself that is also a larger set of the
    next band, so only the band below bounds the partner's size."""
    lo, hi = 1 << band, (2 << band) - 1
    low, high = -(-3 * n // 4), 4 * n // 3
    if max(lo, low) > min(hi, high):
        return None
    return (n + (high if band == band_of(n) else min(hi, high))) // 7


def bands_for(n: int) -> list[tuple[int, int]]:
    """(band, H): the set's own band and, if a similar set can be there, the one below."""
    own = band_of(n)
    out = [(own, differences(n, own))]
    if own and (h := differences(n, own - 1)) is not None:
        out.append((own - 1, h))
    return out


def segment_numbers(shingles: np.ndarray, band: int, salt: int) -> np.ndarray:
    """The segment of every element. Shingles are finished hashes, so under the first salt a segment
    is a range of them, and sorted shingles come segment by segment."""
    x = shingles if salt == 0 else mix64(shingles ^ _SALT[salt])
    return (((x >> _U(32)) * _U(segments_of(band))) >> _U(32)).astype(np.int64)


class Segments:
    """The non-empty segments of one set (sorted shingles) in one band."""

    def __init__(self, shingles: np.ndarray, band: int, salt: int):
        where = segment_numbers(shingles, band, salt)
        if salt:
            order = np.argsort(where, kind="stable")
            where, shingles = where[order], shingles[order]
        self.elements = shingles
        self.first = np.flatnonzero(np.diff(where, prepend=-1))
        self.size = np.diff(self.first, append=len(where))
        self.tag = mix64((where[self.first].astype(_U) << _U(8)) + _U(band * SALTS + salt + 1))
        self.sums = np.add.reduceat(self.elements, self.first)

    def exact(self) -> np.ndarray:
        return mix64(self.sums + self.tag)

    def deletions(self) -> np.ndarray:
        big = np.repeat(self.size > 1, self.size)
        rest = np.repeat(self.sums, self.size) - self.elements + np.repeat(self.tag, self.size)
        return mix64(rest[big])

    def slack(self, h: int, deletions: bool) -> int:
        """Pigeonhole weight beyond what h differences need (negative: not enough)."""
        return len(self.size) + (int((self.size > 1).sum()) if deletions else 0) - (h + 1)


def sketch_bits(n: int) -> int:
    return max(256, 4 << max(0, n - 1).bit_length())


def sketch(shingles: np.ndarray) -> bytes:
    bits = sketch_bits(len(shingles))
    odd = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):  # fold the longer one: its index loses the top bit
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(np.bitwise_count(x ^ y).sum())


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the (finished) hashes that stand for the set."""
    with np.errstate(over="ignore"):
        a = shingles.sum(dtype=_U) + _U(len(shingles))
        b = (shingles * ((shingles >> _U(31)) | _U(1))).sum(dtype=_U)
        a, b = mix64(np.array([a, b]))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


# ----------------------------------------------------------------------------- passes

_SET_SCHEMA = "kind int, doc_id long, n long, set_id long, check long, sketch binary"


def summaries(docs: DataFrame) -> DataFrame:
    """Kind 0: one row per document. Kind 1: (set_id: signature, n: how many sets of the task
    have it). Kind 2: (n: band, doc_id: salt, set_id / check: least slack without / with
    deletions)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        held_n, hot = 0, {}
        least: dict[tuple[int, int], list[int]] = {}

        def count() -> None:
            nonlocal held, held_n
            if held:
                code, n = np.unique(np.concatenate(held), return_counts=True)
                many = n > 1
                for c, k in zip(code[many].tolist(), n[many].tolist()):
                    hot[c] = hot.get(c, 0) + k
                if len(hot) > 3 * HOT_ROWS:  # keep the most common: an order, not a filter
                    for c in sorted(hot, key=hot.get)[:len(hot) - HOT_ROWS]:
                        del hot[c]
            held, held_n = [], 0

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1):
                s = shingle_hashes(utf8(text.as_py()))
                if not len(s):
                    row = (0, None, None, None)
                else:
                    a, b = identity(s)
                    row = (len(s), a, b, sketch(s))
                    if a not in seen:
                        seen.add(a)
                        for band, h in bands_for(len(s)):
                            for salt in range(SALTS if band < 5 else 1):
                                seg = Segments(s, band, salt)
                                low = least.setdefault((band, salt), [1 << 40, 1 << 40])
                                low[0] = min(low[0], seg.slack(h, False))
                                low[1] = min(low[1], seg.slack(h, True))
                                if salt == 0:
                                    held.append(seg.exact())
                                    held_n += len(held[-1])
                        if held_n > 250_000:
                            count()
                for column, value in zip(out, row):
                    column.append(value)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column(0).cast(pa.int64()), pa.array(out[0], pa.int64()),
                                              pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                                             names=["kind", "doc_id", "n", "set_id", "check", "sketch"])
        count()
        stats = [(1, None, n, int(np.uint64(c).astype(np.int64)), None, None) for c, n in hot.items()]
        stats += [(2, salt, band, low[0], low[1], None) for (band, salt), low in least.items()]
        if stats:
            cols = list(zip(*stats))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 4, pa.binary()))],
                                             names=["kind", "doc_id", "n", "set_id", "check", "sketch"])

    return docs.mapInArrow(run, _SET_SCHEMA)


def allocation(sets: DataFrame) -> tuple[dict[int, tuple[int, bool]], np.ndarray, np.ndarray]:
    """band -> (salt, deletions), and the common signatures with their counts (bounded)."""
    rows = sets.where("kind = 2").groupBy(F.col("n").alias("band"), F.col("doc_id").alias("salt")).agg(
        F.min("set_id").alias("plain"), F.min("check").alias("deleted")).collect()  # bands x salts
    plan: dict[int, tuple[int, bool]] = {}
    for r in sorted(rows, key=lambda r: (r["band"], r["salt"])):
        for deletions, slack in ((False, r["plain"]), (True, r["deleted"])):
            if slack >= 0 and (r["band"] not in plan or (plan[r["band"]][1] and not deletions)):
                plan[r["band"]] = (r["salt"], deletions)
    missing = {r["band"] for r in rows} - set(plan)
    if missing:
        raise RuntimeError(f"no hash separates the sets of bands {sorted(missing)}")
    hot = (sets.where("kind = 1").groupBy("set_id").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST)
           .orderBy(F.col("n").desc(), "set_id").limit(HOT_ROWS).toArrow())
    code = hot.column("set_id").to_numpy().view(_U)
    order = np.argsort(code)
    return plan, code[order], hot.column("n").to_numpy()[order]


def rarest(sig: np.ndarray, hot: np.ndarray, hot_n: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` rarest signatures: those that are not hot, by value, then the hot ones by count."""
    if len(sig) <= n:
        return sig
    at = np.minimum(hot.searchsorted(sig), len(hot) - 1) if len(hot) else None
    common = hot[at] == sig if len(hot) else np.zeros(len(sig), dtype=bool)
    cold = sig[~common]
    if len(cold) > n:
        return np.partition(cold, n - 1)[:n]
    rest, cost = sig[common], hot_n[at[common]] if len(hot) else common[common]
    return np.concatenate([cold, rest[np.lexsort((rest, cost))[:n - len(cold)]]])


def signatures_of(s: np.ndarray, plan: dict[int, tuple[int, bool]], hot: np.ndarray, hot_n: np.ndarray) -> np.ndarray:
    out = []
    for band, h in bands_for(len(s)):
        if band not in plan:
            continue
        salt, deletions = plan[band]
        seg = Segments(s, band, salt)
        sig = seg.exact()
        if deletions:
            out += [sig, seg.deletions()]
            continue
        out.append(rarest(sig, hot, hot_n, h + 1))
    return np.unique(np.concatenate(out))


def signatures(docs: DataFrame, plan, hot: np.ndarray, hot_n: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, payload): signatures, set ids and size codes of a task's sets, by signature
    bucket, 16 bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast((plan, hot, hot_n))  # at most HOT_ROWS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, hot, hot_n = shared.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, total
            if not held:
                return
            sig = np.concatenate([x[0] for x in held])
            sizes = [len(x[0]) for x in held]
            ids = np.repeat(np.array([x[1] for x in held], dtype=np.int64), sizes)
            codes = np.repeat(size_code(np.array([x[2] for x in held])), sizes)
            where = (sig % _U(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            sig, ids, codes = sig[order], ids[order], codes[order]
            full = np.flatnonzero(np.diff(cuts))
            data = [pack(sig[a:b], ids[a:b], codes[a:b]) for a, b in zip(cuts[full], cuts[full + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "payload"])
            held, total = [], 0

        for batch in batches:
            for text in batch.column(0):
                s = shingle_hashes(utf8(text.as_py()))
                if len(s):
                    a, _ = identity(s)
                    if a not in seen:
                        seen.add(a)
                        held.append((signatures_of(s, plan, hot, hot_n), a, len(s)))
                        total += len(held[-1][0])
                        if total > 200_000:
                            yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, payload binary")


def similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)


def size_code(n: np.ndarray) -> np.ndarray:
    """Sizes on a logarithmic scale in two bytes, for a first look; ``prune`` has the sizes."""
    return np.minimum(np.floor(2048 * np.log2(n)), 65535).astype(np.uint16)


def close_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True wherever ``similar_sizes`` is: 2048 * log2(4 / 3) is under 850, plus one for rounding."""
    return np.abs(a.astype(np.int32) - b.astype(np.int32)) <= 851


def pack(sig: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> bytes:
    """The upper 48 bits of the signatures (the bucket stands for others), ids and size codes.
    Two signatures that become one this way only make more candidates."""
    upper = (sig >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return upper.tobytes() + ids.tobytes() + codes.tobytes()


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(payload) // 16
    sig = np.zeros((n, 8), dtype=np.uint8)
    sig[:, :6] = np.frombuffer(payload, np.uint8, 6 * n).reshape(n, 6)
    return sig.view("<u8").ravel(), np.frombuffer(payload, np.int64, n, 6 * n), np.frombuffer(payload, np.uint16, n, 14 * n)


def bucket_candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one bucket. Kind 0: pair (x, y) of set ids; kind 1: member x of the large
    group y (a signature)."""
    sig, ids, ns = (np.concatenate(x) for x in zip(*map(unpack, pdf["payload"])))
    order = np.lexsort((mix64(ids.view(_U)), sig))  # the first of a group is the same set in most of a cluster's groups
    sig, ids, ns = sig[order], ids[order], ns[order]
    fresh = np.ones(len(sig), dtype=bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])  # copies in other tasks
    sig, ids, ns = sig[fresh], ids[fresh], ns[fresh]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(first, append=len(sig))
    place = np.arange(len(sig)) - np.repeat(first, size)
    size = np.repeat(size, size)
    xs, ys, kinds = [], [], []
    for back in range(1, SMALL):  # all pairs of small groups
        at = np.flatnonzero((size <= SMALL) & (place >= back))
        ok = at[close_codes(ns[at], ns[at - back])]
        xs.append(ids[ok])
        ys.append(ids[ok - back])
    at = np.flatnonzero((size > SMALL) & (place > 0))
    star = at - place[at]
    ok = close_codes(ns[at], ns[star])
    xs.append(ids[at][ok])
    ys.append(ids[star][ok])
    x, y = np.concatenate(xs), np.concatenate(ys)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
    big = size > SMALL
    group = mix64(sig[big] + mix64(np.array([pdf["bucket"].iloc[0]], dtype=_U)))
    kinds = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(int(big.sum()), np.int32)])
    return pd.DataFrame({"kind": kinds, "x": np.concatenate([pairs[:, 0], ids[big]]), "y": np.concatenate([pairs[:, 1], group.view(np.int64)])})


def prune(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): documents whose sizes and sketches allow a link, from pairs (x, y) of set ids."""
    side = lambda p, k: reps.select(F.col("set_id").alias(k), F.col("doc").alias(f"{p}"), F.col("n").alias(f"n{p}"), F.col("sketch").alias(f"k{p}"))
    both = pairs.join(side("a", "x"), "x").join(side("b", "y"), "y").where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = t.column("ka").to_pylist(), t.column("kb").to_pylist()
            h = (t.column("na").to_numpy() + t.column("nb").to_numpy()) // 7
            ok = np.array([sketch_distance(p, q) for p, q in zip(a, b)], dtype=np.int64) <= h if len(a) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents that link, by the shingles of their whole texts. Each b
    meets its a in a task that reads a's text once for up to 256 partners."""
    ranked = pairs.withColumn("part", (F.xxhash64("b") % 1024).cast("int"))
    fan = ranked.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / 256).cast("int").alias("parts"))
    members = ranked.join(fan, "a").select(F.col("b").alias("doc"), "a", F.pmod("part", "parts").alias("part"), F.lit(1).alias("role"))
    centres = members.select(F.col("a").alias("doc"), "a", "part", F.lit(0).alias("role")).distinct()
    known = reps.select(F.col("doc"), "set_id", "check")
    wanted = members.unionByName(centres).join(known, "doc")
    rows = (wanted.join(texts, "doc").select("a", "part", "role", "doc", "set_id", "check", "text")
            .repartition("a", "part").sortWithinPartitions("a", "part", "role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, s = None, None
        for t in batches:
            out_a, out_b = [], []
            a, part, role, doc, sid, check, text = (t.column(c) for c in range(7))
            for i in range(t.num_rows):
                own = shingle_hashes(utf8(text[i].as_py()))
                if identity(own) != (sid[i].as_py(), check[i].as_py()):
                    continue  # another row of the same id
                key = (a[i].as_py(), part[i].as_py())
                if role[i].as_py() == 0:
                    centre, s = key, own
                elif key == centre:
                    both = len(np.intersect1d(s, own, assume_unique=True))
                    if 100 * both >= 75 * (len(s) + len(own) - both):
                        out_a.append(key[0])
                        out_b.append(doc[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def fold(sketches: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches folded to the shortest one's length, as rows of 64-bit words, and their sizes."""
    short = min(map(len, sketches))
    out = np.empty((len(sketches), short // 8), dtype=_U)
    for i, k in enumerate(sketches):
        x = np.frombuffer(k, np.uint8)
        while len(x) > short:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        out[i] = x.view(_U)
    return out, n


def apart(g: pd.DataFrame, best_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of set ids of one group (or of two blocks of it) in different components, x
    outside the main one, whose sizes and sketches allow a link: for each x the nearest, or all."""
    words, n = fold(list(g["sketch"]), g["n"].to_numpy())
    comp, ids, left = g["c"].to_numpy(), g["set_id"].to_numpy(), g["left"].to_numpy()
    minority = np.flatnonzero((comp != g["main"].to_numpy()) & (left != 2))  # 2: only the second side of a block pair
    partners = np.flatnonzero(left != 1)  # 1: only the first side
    xs, ys = [], []
    for i in minority:
        ok = partners[(comp[partners] != comp[i]) & similar_sizes(n[partners], n[i])]
        if len(ok):
            d = np.bitwise_count(words[ok] ^ words[i]).sum(axis=1, dtype=np.int64)
            near = d <= (n[ok] + n[i]) // 7
            ok, d = ok[near], d[near]
            if best_only and len(ok):
                ok = ok[[int(np.lexsort((ids[ok], d))[0])]]
            xs.append(np.full(len(ok), ids[i]))
            ys.append(ids[ok])
    cat = lambda p: np.concatenate(p) if p else np.empty(0, np.int64)
    return cat(xs), cat(ys)


def between(member: DataFrame, joined: DataFrame, reps: DataFrame, best_only: bool) -> DataFrame:
    """Candidate pairs (x, y) between components of the same large group."""
    lone = reps.select("set_id", "doc", "n", "sketch").join(joined, F.col("doc") == F.col("node"), "left").select(
        "set_id", "n", "sketch", F.coalesce("component", "doc").alias("c"))
    rows = member.join(lone.select("set_id", "c"), "set_id")
    parts = rows.groupBy("g", "c").agg(F.count("*").alias("k"))
    main = (parts.groupBy("g").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count("*").alias("parts"), F.sum("k").alias("size"))
            .where("parts > 1").select("g", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    rows = rows.join(main, "g").withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("blocks")).cast("int"))
    # a member meets every block of its group: as first side in (own, j), as second in (i, own)
    at = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.when(
        j == F.col("own"), F.array(F.struct(j.alias("i"), j.alias("j"), F.lit(0).alias("left")))).otherwise(
        F.array(F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(1).alias("left")), F.struct(j.alias("i"), F.col("own").alias("j"), F.lit(2).alias("left")))))))
    rows = rows.select("g", "set_id", "c", "main", at.alias("at")).select("g", "set_id", "c", "main", "at.i", "at.j", "at.left")
    rows = rows.join(lone.select("set_id", "n", "sketch"), "set_id").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    names = ["g", "i", "j", "set_id", "c", "main", "left", "n", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None

        def found(frames: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            key = frames[["g", "i", "j"]].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
            pairs = [apart(frames.iloc[a:b], best_only) for a, b in zip(cuts, cuts[1:])]
            x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["x", "y"])

        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held[["g", "i", "j"]].to_numpy()
            done = int((last == last[-1]).all(axis=1).argmax())  # the last group may go on
            if done:
                yield from found(held.iloc[:done])
                held = held.iloc[done:].reset_index(drop=True)
        if held is not None and len(held):
            yield from found(held)

    return rows.select(*names).mapInArrow(run, "x long, y long").distinct()


def join(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every document."""
    small_batches(docs.sparkSession, 250)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(summaries(src), "sets")
    rows = sets.where("kind = 0")
    reps = materialise(rows.where("n > 0 and doc_id is not null").groupBy("set_id", "check").agg(
        F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "reps")
    plan, hot, hot_n = allocation(sets)
    total = reps.agg(F.sum("n")).first()[0] or 0
    buckets = max(256, int(total) // 500_000)
    grouped = signatures(src, plan, hot, hot_n, buckets).groupBy("bucket").applyInPandas(bucket_candidates, "kind int, x long, y long")
    found = materialise(grouped, "candidates")
    pairs = found.where("kind = 0").select("x", "y").distinct()
    # whole texts of the documents that may be compared, once
    named = found.select(F.col("x").alias("set_id")).unionByName(found.where("kind = 0").select(F.col("y").alias("set_id"))).distinct()
    wanted = reps.join(named, "set_id", "left_semi").select("doc")
    texts = materialise(src.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc", "left_semi"), "texts")
    links = materialise(verify(materialise(prune(pairs, reps), "pairs"), texts, reps), "links")
    member = found.where("kind = 1").select(F.col("y").alias("g"), F.col("x").alias("set_id"))
    joined = materialise(components(links), "components")
    for best_only in (True, False):
        more = prune(between(member, joined, reps, best_only), reps)
        more = materialise(verify(materialise(more, "pairs"), texts, reps), "links")
        if more.limit(1).count():
            links = links.unionByName(more)
            joined = materialise(components(links), "components")
    by_set = reps.join(joined, F.col("doc") == F.col("node"), "left").select("set_id", "check", F.coalesce("component", "doc").alias("c"))
    out = rows.join(by_set, ["set_id", "check"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumnRenamed("doc_id", key)


def keep_first(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller id (repeated ids stay together)."""
    found = join(docs, key, text_col)
    drop = found.where((F.col("n_shingles") > 0) & (F.col(key) != F.col("component_id"))).select(F.col(key)).distinct()
    return docs.join(drop, key, "left_anti")
