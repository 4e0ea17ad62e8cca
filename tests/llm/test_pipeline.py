import corpus_pipeline
from roadwise.llm import langid, secret_scan
from test_operators import brute_components, pieces_of

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen.append((name, docs, out))
        docs = out
    for _, before, after in seen[:-1]:
        assert after.columns == list(corpus_pipeline.COLUMNS) and 0 < after.count() <= before.count()
    _, before, after = seen[2]
    components = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {d for d, (n, c) in components.items() if not n or d == c}
    _, before, after = seen[3]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["text"] == secret_scan.hide(texts[r["doc_id"]], "[secret]") and r["n_chars"] == len(r["text"])
    _, before, after = seen[4]
    want = sorted((r["doc_id"], i, len(p)) for r in before.collect() for i, p in enumerate(pieces_of(r["text"])))
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in after.collect()) == want
    assert corpus_pipeline.run(spark, SF).count() == after.count()
    assert langid.BLOCK == 512


def test_empty_and_odd_tables_pass_through(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.schema.names == docs.schema.names
            before, after = ([r["doc_id"] for r in x.collect()] for x in (docs, out))
            assert len(after) <= len(before) and set(after) <= set(before)
            docs = out
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert {r["doc_id"] for r in pieces} == set(kept)
        for d, text in kept.items():
            if d is not None and d != 0:  # 0 is repeated
                assert sum(r["length"] for r in pieces if r["doc_id"] == d) == sum(map(len, pieces_of(text)))
    assert not kept and not pieces
