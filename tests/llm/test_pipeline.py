"""Each pipeline stage against brute force on what its predecessor kept."""

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept

from factloom.llm import decontaminate, langid


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(90_001, None, "en", "s", 0), (90_002, "12 34", "en", "s", 5), (90_004, "7 — 7 !", None, "s", 5), (90_003, docs.first()["text"], "en", "s", 5)]
    rows = docs.unionAll(spark.createDataFrame(extra, docs.schema))
    kept = [r.asDict() for r in rows.collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            got = sorted(r["doc_id"] for r in out.collect())
            if name == "language_id":
                told = {r["doc_id"]: r for r in langid.languages(rows).collect()}  # held against a plain computation in the operator's tests
                want = [r["doc_id"] for r in kept if told[r["doc_id"]]["lang_pred"] != "und" and told[r["doc_id"]]["score"] >= corpus_pipeline.LEAST_SCORE]
                # without a letter no language is determined, whatever the fit says of the others
                assert not {90_001, 90_002, 90_004} & set(want) and len(want) > 0.95 * len(kept)
            elif name == "exact_dedup":
                first = {}
                for r in sorted(kept, key=lambda r: r["doc_id"]):
                    first.setdefault(" ".join(r["text"].replace("\n", " ").split(" ")), r["doc_id"])
                want = list(first.values())
            elif name == "simhash_near_dedup":
                want = brute_kept({r["doc_id"]: r["text"] for r in kept})
            else:
                items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
                leaked = {r["doc_id"] for r in kept if any(i in decontaminate.plain(r["text"]) for i in items)}
                assert leaked
                want = [r["doc_id"] for r in kept if r["doc_id"] not in leaked]
            assert got == sorted(want), name
            kept = [r for r in kept if r["doc_id"] in set(got)]
            rows = out.checkpoint()
        else:
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in kept)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
