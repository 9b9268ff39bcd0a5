"""The pipeline against plain versions of its stages, and on edge rows."""

import corpus_pipeline as C
from paperloom.llm import decontaminate, near_duplicates, pii, toxicity


def test_stages_on_the_fixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    clean = C.drop_toxic(spark, docs, sf)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, s in scores.items() if s < 0.7}
    assert clean.columns == docs.columns

    unique = C.drop_near_duplicates(spark, clean, sf)
    kept = {r["doc_id"] for r in near_duplicates.near_duplicates(clean).where("kept").collect()}
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(kept)

    free = C.drop_contaminated(spark, unique, sf)
    bad = {r["doc_id"] for r in decontaminate.contract(decontaminate.decontaminate(unique, bench)).where("contaminated").collect()}
    assert {r["doc_id"] for r in free.collect()} == kept - bad

    private = C.redact_personal_data(spark, free, sf)
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    assert set(texts) == kept - bad and not any(pii.base_spans(t)[0] for t in texts.values() if "]" in t and "@" in t)
    assert all(r["n_chars"] == len(r["text"]) for r in private.collect())
    assert C.pack_sequences(spark, private, sf).select("doc_id").distinct().count() == len(texts)


def test_edge_rows(spark, sf):
    rows = [(1, None, "en", "s", 0, "x"), (1, None, "en", "s", 0, "x"), (None, "some words here", "en", "s", 3, "x"), (None, "some words here", "en", "s", 3, "x"), (2, "", "en", None, None, "x"), (3, "a b c d e f g", "en", "s", 13, "x"), (3, "a b c d e f g", "en", "s", 13, "x"), (4, "a b c d e f g", "en", "s", 13, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _toxic_score string")
    out = docs
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns
    ids = sorted((r["doc_id"] or 0) for r in out.collect())
    assert ids == [0, 0, 1, 2, 3]
    pieces = C.STAGES[-1][1](spark, out, sf).collect()
    assert sum(p["doc_tokens"] for p in pieces if p["start"] == 0) == sum(p["length"] for p in pieces)
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_run(spark, sf):
    assert C.run(spark, sf).count() > 0
