"""Spelling variants, SentencePiece ids and ranked search on small tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from roadwise.llm import lexical, pieces, queries, spelling

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# ---- op11

def brute_variants(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted(set("".join(words)))
    out, form = {}, {}
    for w, n in words.items():
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = [x for x in edits - {w} if x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = [n, len(near), form[w], words.get(form[w])]
    for w, row in out.items():
        root = w
        while form[root]:
            root = form[root]
        row.append(root)
    return sorted(((w, *row) for w, row in out.items()), key=str)


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def test_variants_equal_brute_force(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(queries.op11_spelling(spark, SF), *COLUMNS)
    assert got == brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()]) and any(r[3] for r in got)
    many = odd_docs.unionByName(odd_docs).unionByName(odd_docs)
    assert rows_of(spelling.variants(many), *COLUMNS) == brute_variants([(r["doc_id"], r["text"]) for r in many.collect()])
    assert spelling.variants(no_docs).count() == 0


def planted():
    """Words one edit apart with counts that chain, accents, a tie, and long words."""
    r = random.Random(4)
    words = {"letter": 700, "lettre": 60, "lettere": 130, "leter": 20, "lettr\u00e9": 11, "zzletter": 5, "aaletter": 40, "abletter": 40, "baletter": 6,
             "x" * 300: 50, "x" * 299: 9, "x" * 150 + "y" + "x" * 149: 7, "q" * 64: 30, "q" * 65: 150}
    words |= {"".join(r.choice("ab") for _ in range(r.randint(6, 9))): r.randint(5, 90) for _ in range(300)}
    bag = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(bag)
    return [(i, " ".join(bag[i::50]).replace("letter", "LETTER", 1)) for i in range(50)]


def test_chains_ties_and_long_words(spark, monkeypatch):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_variants(rows)
    assert rows_of(spelling.variants(docs), *COLUMNS) == want and max(len(w[0]) for w in want) >= 299
    # filters cut into slices, and one filter a round
    monkeypatch.setattr(spelling, "FILTER_WORDS", 40)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 100)
    monkeypatch.setattr(spelling, "CELLS", 5000)
    assert rows_of(spelling.variants(docs), *COLUMNS) == want


def test_filters_hold_all_their_words():
    words = ["".join(random.Random(i).choice("abcdef\u00e9") for _ in range(9)) for i in range(500)]
    (_, points), = spelling.by_length(words)
    h = spelling.finish(spelling.place_sums(points).sum(axis=1, dtype=np.uint64), 9)
    assert len(set(h.tolist())) == len(set(words))
    block, bits = spelling.block_and_bits(h, 200)
    assert block.max() < 200 and all(1 <= bin(int(b)).count("1") <= spelling.PROBES for b in bits)


# ---- op12

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_library(spark, odd_docs, no_docs, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_pieces(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    rows = pieces.decode(pieces.encode(odd_docs, MODEL), MODEL).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
    assert pieces.encode(no_docs, MODEL).count() == 0


def test_pieces_on_odd_characters_and_ids(library):
    p, r = pieces.pieces(MODEL), random.Random(6)
    letters = "ab \u2581\n\t\u00e9\u65e5\U0001f600thein0.\x00<>x\u2028\ufffd"
    texts = ["", " ", "\u2581", "<s> <unk> <0x0A>", "x" * 5000, " " * 999, "ab" * 3000]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randint(1, 0x2fff), r.randint(32, 126), r.randint(0xe000, 0x1ffff)])) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        ids = library.encode(t)
        assert p.encode(t).tolist() == ids and p.decode(ids) == library.decode(ids), repr(t)
    for _ in range(3000):
        ids = [r.choice([r.randint(0, 300), r.randint(0, 31_999)]) for _ in range(r.randint(0, 12))]
        assert p.decode(ids) == library.decode(ids), ids


def test_prefix_table_holds_the_last_token_of_every_prefix(library):
    p = pieces.pieces(MODEL)
    for run in ("\u2581internationalization", "\u2581\u2581\u2581\u2581\u2581the", "\u2581thherention"):
        assert p.last_tokens(run) == [p.merge(run[:i + 1])[-1] for i in range(len(run))]


# ---- op13

def brute_ranks(docs, items, k=20):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(d, Counter(term.findall((t or "").translate(lower)))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        ask = Counter(term.findall((text or "").translate(lower)))
        found = []
        for d, c in bags:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                    for t, times in ask.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def pairs(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_ranks_equal_brute_force(spark, odd_docs, no_docs, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_ranks(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert rows_of(queries.op13_lexical(spark, SF), "item_id", "rank", "doc_id", "score") == want
    ask = spark.createDataFrame([(1, "tha ming REL one"), (2, None), (3, ""), (4, "unknownterm"), (1, "stor stor stor vey"), (None, "two words \u65e5\u672c\u8a9e")],
                                "item_id long, text string")
    want = brute_ranks(pairs(odd_docs, "doc_id", "text"), pairs(ask, "item_id", "text"))
    found = lexical.search(lexical.build_index(odd_docs), ask)
    assert rows_of(found, "item_id", "rank", "doc_id", "score") == want
    assert lexical.search(lexical.build_index(no_docs), ask).count() == 0
    assert lexical.search(lexical.build_index(odd_docs), ask.limit(0)).count() == 0
    # many shards with floors, several blocks of queries
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 15)
    monkeypatch.setattr(lexical, "FLOOR_SHARDS", 2)
    want = brute_ranks(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"), k=7)
    index = lexical.build_index(docs.repartition(4), shard_terms=2000)
    assert index.where(F.col("term").isNull()).count() > 8
    assert rows_of(lexical.search(index, items, k=7), "item_id", "rank", "doc_id", "score") == want


def test_ties_and_copies(spark):
    rows = [(i, "alpha beta gamma") for i in range(60)] + [(100, "alpha " * 30), (101, "delta beta"), (7, "alpha beta gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ask = spark.createDataFrame([(0, "beta gamma"), (1, "alpha")], "item_id long, text string")
    want = brute_ranks(rows, pairs(ask, "item_id", "text"))
    assert rows_of(lexical.search(lexical.build_index(docs, shard_terms=50), ask), "item_id", "rank", "doc_id", "score") == want


def test_bounds_save_scoring():
    r = np.random.default_rng(3)
    documents = 5000
    places = [np.flatnonzero(r.random(documents) < p) for p in (0.3, 0.05, 0.01)]
    impacts = [(r.pareto(1.5, len(p)) * 1000).astype(np.int64) + 1 for p in places]
    post = lexical.Postings(places, impacts, documents)
    ids = np.arange(documents)
    weight = np.array([1, 3, 9])
    got_i, got_s, scored = lexical.search_shard(post, np.arange(3), weight, ids, 20, 0)
    full = np.zeros(documents, dtype=np.int64)
    for p, v, w in zip(places, impacts, weight):
        full[p] += v * w
    want = np.lexsort((ids, -full))[:20]
    order = np.lexsort((got_i, -got_s))
    assert got_i[order].tolist() == want.tolist() and got_s[order].tolist() == full[want].tolist() and scored < 1000
