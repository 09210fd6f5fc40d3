"""Chunking, audits, stores, search, re-ranking, clustering, answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import config
from factloom.operators import answer, chunking, quality, rerank, store, trace, vectors
from factloom.plans import ingest
from factloom.sources import pages


def test_settings(tmp_path):
    made = config.settings_from({"sources": [{"scheme_id": "a_b", "category": "C", "scheme_name": "N", "url": "u"}], "top_k": 2})
    assert made.candidate_k == 6 and made.token_budget == 230 and made.render_prefix("N", "C", "t") == "N (C). t"
    with pytest.raises(ValueError):
        config.Source("a-b", "", "", "")
    with pytest.raises(ValueError):
        config.settings_from({"sources": [made.sources[0], made.sources[0]]})
    with pytest.raises(ValueError):
        config.settings_from({"nope": 1})
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"top_k": 9}))
    assert config.load_settings(str(path)).top_k == 9
    path.write_text(json.dumps({"top_k": 8}))
    assert config.load_settings(str(path)).top_k == 9
    config.clear_settings_cache()
    assert config.load_settings(str(path)).top_k == 8
    with pytest.raises(ValueError):
        chunking.strategy(None, config.Settings(strategy="semantic", semantic_available=False))


def test_splitter():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in (30, 10, 50, 5))
    parts = chunking.split_recursively(text, 20, 5, ("\n\n", "\n", ". ", " ", ""), lambda t: len(t.split()))
    assert all(len(p.split()) <= 20 for p in parts) and len(parts) > 4
    assert {w for p in parts for w in p.split()} == set(text.split())
    assert chunking.split_recursively("abc", 20, 5, (" ", ""), len) == ["abc"]
    assert all(len(p) <= 7 for p in chunking.split_recursively("abcdefghij" * 3, 7, 2, ("",), len))


def fact_docs(spark, sf):
    from factloom.catalogue import shaping

    return shaping.fact_documents(spark, sf)


def test_ingest_and_gate(spark, sf):
    docs = fact_docs(spark, sf).checkpoint()
    chunks = ingest.chunk_rows(docs).cache()
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 100
    assert chunks.where("token_count > 200").count() == 0
    assert {r[0] for r in chunks.select("section").distinct().collect()} == {"overview", "fees_and_minimums", "portfolio", "fund_management"}
    stored = ingest.ingest(docs, dim=16).cache()
    assert stored.count() == chunks.count() and vectors.norm_report(stored, F.col("embedding"), 16).first()["all_dim"]
    with pytest.raises(quality.AuditFailed, match="allowlist"):
        ingest.ingest(docs, allowlist=spark.createDataFrame([("https://other.example",)], "url string"))


def test_run_log_of_an_ingest(spark, sf, tmp_path):
    docs = fact_docs(spark, sf).checkpoint()
    path, log = f"file://{tmp_path}/stored", f"file://{tmp_path}/log"
    entry = ingest.ingest_run(docs, path, log, config.Settings(sources=(config.Source("s3", "", "", ""), config.Source("none", "", "", ""))), dim=16)
    assert json.loads(json.dumps(entry)) == store.read_run_log(spark, log) and entry["duration_s"] > 0
    rows, told = spark.read.parquet(path).collect(), entry["stage_summary"]
    assert told["chunks"]["n"] == told["vectors"]["n"] == len(rows) and told["documents"] == docs.count()
    assert told["chunks"]["tokens"] == sum(r["token_count"] for r in rows) and told["chunks"]["longest"] == max(r["token_count"] for r in rows)
    assert told["chunks_per_section"] == {s: sum(r["section"] == s for r in rows) for s in ingest.SECTIONS}
    assert told["chunks_per_scheme"] == {"s3": sum(r["scheme_id"] == "s3" for r in rows), "none": 0}
    assert told["vectors"]["shortest"] == told["vectors"]["longest"] == 16 and abs(told["vectors"]["least_norm"] - 1) < 1e-3
    stats = chunking.corpus_stats(docs).first().asDict()
    assert {n: entry["decision"][n] for n in stats} == stats
    with pytest.raises(quality.AuditFailed):
        ingest.ingest_run(docs, f"{path}-2", f"{log}-2", allowlist=spark.createDataFrame([("https://other.example",)], "url string"))
    assert store.read_run_log(spark, f"{log}-2") == {} and not (tmp_path / "stored-2").exists()
    none = ingest.ingest_run(docs.limit(0), f"{path}-3", f"{log}-3")
    assert none["stage_summary"]["documents"] == 0 and none["stage_summary"]["vectors"] == {"n": 0, "shortest": None, "longest": None, "least_norm": None, "most_norm": None}


def test_leaders_of_labels_with_equal_vectors(spark):
    """Every label has the same vectors under ids of its own: no row goes to another label's leader."""
    rows = spark.createDataFrame([(f"l{i % 5}", i, [float(i // 5 % 3 == k) for k in range(3)]) for i in range(60)], "label string, id long, v array<double>").coalesce(1)
    got = {r["id"]: r["seed"] for r in vectors.leaders(rows, "id", "v", "label").collect()}
    assert got == {i: i % 15 for i in range(60)}


def test_semantic_strategy_is_what_ingest_stores(spark, sf):
    """The merged chunks against a plain greedy loop over the entity's chunks and their vectors."""
    docs = fact_docs(spark, sf).checkpoint()
    settings = config.Settings(strategy="semantic", chunk_tokens=5000, cluster_distance=0.6)
    stored = {r["chunk_id"]: r for r in ingest.ingest(docs, settings, dim=16).collect()}
    plain = store.embed(ingest.chunk_rows(docs, settings, *ingest.ORDER), "text", 16).collect()
    want = {}
    for scheme in {r["scheme_id"] for r in plain}:
        left, n = sorted((r for r in plain if r["scheme_id"] == scheme), key=lambda r: (r["family"], r["pos"], r["piece"])), 0
        while left:
            near = [1 - sum(x * y for x, y in zip(left[0]["embedding"], r["embedding"], strict=True)) <= 0.6 for r in left]
            near[0] = True
            want[f"{scheme}_{left[0]['section']}_semantic_{n}"] = (" ".join(r["text"] for r, own in zip(left, near, strict=True) if own), left[0]["value"])
            left, n = [r for r, own in zip(left, near, strict=True) if not own], n + 1
    assert {k: (r["text"], r["value"]) for k, r in stored.items()} == want and len(want) < len(plain)
    assert {(r["field"], r["value_type"], r["is_fact"]) for r in stored.values()} == {("semantic_cluster", "prose", False)}
    with pytest.raises(ValueError, match="not available"):
        ingest.ingest(docs, settings.with_(semantic_available=False))
    with pytest.raises(quality.AuditFailed, match="token_budget"):
        ingest.ingest(docs, settings.with_(chunk_tokens=60, cluster_distance=2.0), dim=16)


def test_audit_rules(spark):
    row = {"chunk_id": "c1", "scheme_id": "s", "field": "nav", "text": "S — NAV: 5.", "source_url": "https://a/", "value": "5", "scope": "fund", "historical": False, "is_fact": True, "token_count": 5}
    faults = [row, {**row, "chunk_id": "c2", "token_count": 500}, {**row, "chunk_id": "c3", "text": "NAV: 5 Return calculator"}, {**row, "chunk_id": "c4", "text": "5"}, {**row, "chunk_id": "c5", "value": "6"}, {**row, "chunk_id": "c6", "source_url": "https://b"}, {**row, "chunk_id": "c7", "scope": "amc"}, {**row, "chunk_id": "c8"}, {**row, "chunk_id": "c8"}]
    chunks = spark.createDataFrame(faults)
    gold = spark.createDataFrame([("nav", "s", "7"), ("nav", "t", "1")], "field string, scheme_id string, value string")
    found = quality.audit(chunks, spark.createDataFrame([("HTTPS://A",)], "url string"), 200, gold=gold, distinct={"nav": 1}, historical=spark.createDataFrame([("s", 1)], "scheme_id string, expected int"))
    got = sorted((r["rule"], r["key"]) for r in found.collect())
    assert got == [("allowlist", "c6"), ("distinct", "nav"), ("gold", "nav.s"), ("gold", "nav.t"), ("historical", "s"), ("label_value_atomic", "c4"), ("label_value_atomic", "c5"), ("noise", "c3"), ("scope", "c7"), ("token_budget", "c2"), ("unique", "c8")]
    status = {r["rule"]: r["status"] for r in quality.summary(found, ["gold", "scope", "orphan"]).collect()}
    assert status == {"gold": "fail", "scope": "fail", "orphan": "ok"}
    quality.gate(found.limit(0))


def test_blank_inputs_are_refused(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n\u2003"), (4, " a ")], "id int, t string")
    assert sorted((r["key"], r["detail"]) for r in quality.blank(rows, "id", "t").collect()) == [("1", "0 blank characters"), ("2", "0 blank characters"), ("3", "3 blank characters")]
    with pytest.raises(quality.AuditFailed, match="blank_input"):
        quality.gate(quality.blank(rows, "id", "t"))


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = store.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, store.upsert(once, new, ["k"]).collect()))


def test_embeddings_are_cached(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "id int, text string")
    first = store.cached_embeddings(rows, None, "id", "text", "m", 8).checkpoint()
    changed = rows.withColumn("text", F.when(F.col("id") == 2, "new").otherwise(F.col("text")))
    assert [r["id"] for r in store.stale(changed, first, "id", "text", "m", 8).collect()] == [2]
    assert store.stale(rows, first, "id", "text", "other", 8).count() == 3
    second = store.cached_embeddings(changed, first, "id", "text", "m", 8)
    assert {r["id"]: r["embedding"] for r in second.where("id <> 2").collect()} == {r["id"]: r["embedding"] for r in first.where("id <> 2").collect()}
    assert second.count() == 3
    assert store.fingerprint(rows, "id", "text", "m").first()[0] != store.fingerprint(changed, "id", "text", "m").first()[0]


def test_run_log_and_files(spark, tmp_path):
    log = str(tmp_path / "log")
    assert store.read_run_log(spark, log) == {}
    store.write_run_log(spark, log, "ingest", 1.23456, {"stage": "other"}, audit={"passed": True})
    entry = store.read_run_log(spark, log)
    assert entry["stage"] == "other" and entry["duration_s"] == 1.235 and entry["audit"] == {"passed": True}
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r["a"] for r in pages.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]
    assert pages.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "m.json").write_text('{"k": {"v": 1}, "l": {"v": 2}}')
    assert {r["key"]: json.loads(r["record"])["v"] for r in pages.json_map(spark, str(tmp_path / "m.json")).collect()} == {"k": 1, "l": 2}
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "s_1.txt").write_text("two\nlines")
    assert [(r["scheme_id"], r["text"]) for r in pages.snapshots(spark, str(tmp_path / "snap")).collect()] == [("s_1", "two\nlines")]
    (tmp_path / "snap" / "s_1.json").write_text('{"fetched_at": "2021-02-03"}')
    (tmp_path / "snap" / "s_2.txt").write_text("other")
    (tmp_path / "snap" / "s_2.json").write_text('{"fetched_at": null}')
    got = {r["scheme_id"]: str(r["fetched_at"]) for r in pages.snapshots(spark, str(tmp_path / "snap")).collect()}
    assert got["s_1"] == "2021-02-03" and got["s_2"] > "2021-02-03"
    for text in ("old", "new"):
        rows = [("s_1", text)] if text == "new" else [("s_1", text), ("s_2", text)]
        pages.write_snapshots(spark.createDataFrame(rows, "scheme_id string, text string"), str(tmp_path / "stored"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "stored")).select("scheme_id", "text").collect())) == [("s_1", "new"), ("s_2", "old")]
    path = str(tmp_path / "collection")
    assert store.open_or_create(spark, path, "a int").count() == 0
    spark.createDataFrame([(1,)], "a int").write.mode("append").parquet(path)
    assert store.open_or_create(spark, path, "a int").count() == 1 and store.open_or_create(spark, path, "a int", rebuild=True).count() == 0
    store.write_records(spark.createDataFrame([(1, "a")], "v int, p string"), str(tmp_path / "r"), "p")
    store.write_records(spark.createDataFrame([(2, "b")], "v int, p string"), str(tmp_path / "r"), "p", rebuild=False)
    assert sorted((r["v"], r["p"]) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [(1, "a"), (2, "b")]


def test_nearest(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0 if i else 0.0], str(i % 2)) for i in range(40)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>, label string").repartition(3)
    queries = spark.createDataFrame([(7, [1.0, 2.0, 3.0], ["1"]), (8, [0.0, 0.0, 0.0], None)], "qid long, embedding array<float>, allowed array<string>")
    got = vectors.nearest(corpus, queries, 6, label_col="label", allowed_col="allowed").collect()

    def distance(a, b):
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return 1.0 if size == 0 else 1 - sum(x * y for x, y in zip(a, b, strict=True)) / size

    for qid, vector, allowed in ((7, [1.0, 2.0, 3.0], {"1"}), (8, [0.0] * 3, {"0", "1"})):
        want = sorted((round(distance(vector, v), 12), i) for i, v, label in rows if label in allowed)[:6]
        assert [(round(r["distance"], 12), r["id"]) for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])] == want
    assert vectors.nearest(corpus.limit(0), queries, 6).count() == 0
    floor = {r["qid"]: r["grounded"] for r in vectors.grounded(vectors.nearest(corpus, queries.where("qid = 7"), 3), queries).collect()}
    assert floor == {7: True, 8: False}


def candidate(i, distance, field="f", value="v", historical=False, embedding=(1.0, 0.0)):
    return {"id": i, "distance": distance, "field": field, "value": value, "historical": historical, "embedding": list(embedding) if embedding else None, "rank": i}


def chosen(spark, rows, k, weight, max_per_field, penalty):
    schema = "rank int, id int, distance double, field string, value string, historical boolean, embedding array<double>"
    df = spark.createDataFrame([tuple(r[n] for n in ("rank", "id", "distance", "field", "value", "historical", "embedding")) for r in rows], schema)
    df = df.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("c"))
    return [rows[i]["id"] for i in df.select(rerank.select_diverse(F.col("c"), k, weight, max_per_field, penalty).alias("p")).first()["p"]]


def test_rerank_tiers(spark):
    rows = [candidate(i, 0.1 * i, "f", str(i)) for i in range(1, 5)] + [candidate(5, 0.9, "g", "x"), candidate(6, 0.95, "g", "x")]
    assert chosen(spark, rows, 4, 0.0, 3, "distance") == [1, 2, 3, 5]
    assert chosen(spark, rows, 9, 0.0, 3, "distance") == [1, 2, 3, 5, 6, 4]
    apart = [candidate(1, 0.1, value="a"), candidate(2, 0.2, value="b", embedding=(0.0, 1.0)), candidate(3, 0.25, value="c")]
    assert chosen(spark, apart, 2, 0.3, 3, "distance") == [1, 3]
    assert chosen(spark, apart, 2, 0.3, 3, "similarity") == [1, 2]
    assert chosen(spark, [candidate(1, 0.5), candidate(2, 0.5)], 1, 0.3, None, "distance") == [1]


def plain_choice(rows, k, weight, max_per_field, penalty):
    """The same choice by loops."""

    def apart(a, b):
        if a["embedding"] is None or b["embedding"] is None:
            return a["distance"] if penalty == "distance" else 1 - a["distance"]
        x, y = np.array(a["embedding"]), np.array(b["embedding"])
        size = np.linalg.norm(x) * np.linalg.norm(y)
        return (1 - x @ y / size if size else 1.0) if penalty == "distance" else (x @ y / size if size else 0.0)

    taken = []
    while len(taken) < min(k, len(rows)):

        def key(r):
            same = [t for t in taken if t["field"] == r["field"]]
            tier = 2 * (max_per_field is not None and len(same) >= max_per_field) + any(t["value"] == r["value"] for t in same)
            return tier, -((1 - weight) * (1 - r["distance"]) - weight * max([0.0, *(apart(r, t) for t in taken)])), r["rank"]

        taken.append(min((r for r in rows if r not in taken), key=key))
    return [r["id"] for r in taken]


@pytest.mark.parametrize("penalty", ["distance", "similarity"])
def test_rerank_equals_loops(spark, penalty):
    """Ties, nulls in every column, zero vectors and lists shorter than k."""
    rnd = np.random.default_rng(5)
    for n in (1, 3, 18, 30):
        rows = [
            candidate(i, round(float(rnd.uniform(0, 1)), 1), [None, "f", "g"][rnd.integers(3)], [None, "v", "w"][rnd.integers(3)], embedding=None if i % 7 == 3 else (0.0, 0.0, 0.0) if i % 11 == 5 else rnd.normal(size=3).tolist())
            for i in range(n)
        ]
        for limit in (None, 2):
            assert chosen(spark, rows, 6, 0.3, limit, penalty) == plain_choice(rows, 6, 0.3, limit, penalty)


def test_rerank_stays_in_the_jvm(spark):
    rows = [(1, i, float(i) / 10, i, "f", str(i), False, [1.0, float(i)]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "qid long, id long, distance double, rank int, field string, value string, historical boolean, embedding array<float>")
    out = rerank.rerank(df, 3)
    assert [(r["rank"], r["id"]) for r in sorted(out.collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 3)]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert rerank.rerank(df.limit(0)).count() == 0


def test_superseded(spark):
    rows = [(1, "exit_load_historical", True), (2, "exit_load", False), (3, "nav_historical", True)]
    df = spark.createDataFrame([(q, *r) for q in (1, 2) for r in rows if q == 1 or r[2]], "qid long, id long, field string, historical boolean")
    assert sorted(map(tuple, rerank.without_superseded(df).select("qid", "id").collect())) == [(1, 2), (1, 3), (2, 1), (2, 3)]


def test_leader_clusters(spark):
    rows = [(1, [1.0, 0.0], "a", "x"), (2, [0.9, 0.1], "a", "y"), (3, [0.0, 1.0], "a", "z"), (4, [1.0, 0.0], "b", None)]
    got = vectors.leader_clusters(spark.createDataFrame(rows, "id long, v array<double>, label string, t string"), "id", "v", "label", "t").collect()
    assert sorted((r["label"], r["seed"], r["members"], r["text"]) for r in got) == [("a", 1, [1, 2], "x y"), ("a", 3, [3], "z"), ("b", 4, [4], "")]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string, t string")
    pairs = vectors.close_pairs(df, df, "id", "v", "label")
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 2)]


def test_leaders_by_rounds(spark, monkeypatch):
    """Batches far smaller than the leaders give what one pass over a label gives."""
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=3).tolist() if i % 17 else [0.0, 0.0, 0.0], None if i % 5 == 4 else f"l{i % 2}") for i in range(150)]
    want = {}
    for label in {r[2] for r in rows}:
        lead = []
        for i, v, _ in sorted(r for r in rows if r[2] == label):
            size = np.linalg.norm(v) or 1.0
            near = [s for s, u in lead if 1 - np.dot(np.array(v) / size, u) <= 0.3]
            want[i] = near[0] if near else i
            if not near:
                lead.append((i, np.array(v) / size))
    monkeypatch.setattr(vectors, "BATCH", 4)
    got = vectors.leaders(spark.createDataFrame(rows, "id long, v array<double>, label string").repartition(5), "id", "v", "label", 0.3)
    assert {r["id"]: r["seed"] for r in got.collect()} == want
    assert vectors.leaders(spark.createDataFrame([], "id long, v array<double>, label string"), "id", "v", "label").count() == 0


def test_close_pairs_to_smaller_ids(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [1.0, 0.1], "a"), (4, [0.0, 1.0], "a"), (5, [1.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    pairs = vectors.close_pairs(df, df.where("id in (2, 3, 5)"), "id", "v", "label").collect()
    assert sorted((r["label"], r["a"], r["b"]) for r in pairs) == [("a", 1, 2), ("a", 1, 3), ("a", 2, 3)]


SOURCES = (config.Source("s_large_cap", "Large Cap", "Large Cap Fund", "https://facts.example/a"),)


class Second:
    """Fails the first time, or raises."""

    def __init__(self, first):
        self.first = first

    def chat(self, system, user, temperature, max_tokens):
        good = "The large cap load is 1.5%. https://facts.example/a\nLast updated from sources: 2024-01-02"
        if self.first == "raise":
            raise RuntimeError("no")
        return good if "previous answer failed" in system else good.replace(*self.first)


@pytest.mark.parametrize(
    ("first", "status", "retries"), [(("1.5%", "1.5%"), "answered", 0), (("1.5%", "9.5%"), "answered", 1), (("facts.example", "x.example"), "fallback", 0), ("raise", "generator_failed", 0)]
)
def test_answer_rounds(spark, first, status, retries):
    schema = "qid long, query string, context string, evidence array<struct<scheme_id:string,text:string>>, resolution struct<scheme_ids:array<string>,matched_alias:string,confidence:double,ambiguous:boolean>, refusal_type string, refusal_text string, grounded boolean, history array<struct<question:string,answer:string>>"
    row = ("q", "ctx", [("s_large_cap", "load 1.5%")], (["s_large_cap"], "large cap", 0.95, False))
    rows = spark.createDataFrame([(1, *row, None, None, True, []), (2, *row, "pii", "no", False, []), (3, *row, None, None, False, [])], schema)
    got = {r["qid"]: r for r in answer.answered(rows, Second(first), config.Settings(sources=SOURCES), "2024-01-01", "s_").collect()}
    assert (got[1]["status"], got[1]["retries"]) == (status, retries)
    assert got[2]["status"] == "refused" and got[2]["text"] == "no" and got[3]["status"] == "not_available"
    assert "x.example" not in got[1]["text"]
    with pytest.raises(ValueError):
        answer.generator("nobody")


def test_answers_never_hold_personal_data(spark, sf):
    from factloom.catalogue import answering
    from factloom.plans import answering as plan

    turns = answering.turns(spark, sf).where("role = 'user'")
    asked = plan.retrieve(turns, answering.SETTINGS, answering.ALIASES)
    text = " ".join(f"{r['query']} {r['question']} {r['search_text']}" for r in asked.where("refusal_type = 'pii'").collect())
    assert text and "ABCDE1234F" not in text and "9876543210" not in text and "@" not in text


def test_trace(spark):
    t = trace.trace(stage1=F.lit(1), stage5=F.struct(F.lit("x").alias("a")))
    row = spark.range(1).select(trace.is_complete(t).alias("c"), trace.to_text(t).alias("j")).first()
    assert not row["c"] and json.loads(row["j"])["stage5"] == {"a": "x"} and json.loads(row["j"])["stage2"] is None


def test_a_block_product_is_bounded_in_memory(spark, monkeypatch):
    """No product passes TILE queries to what keeps its rows, whatever the blocks' size, and ties at the k-th distance go by id."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = np.append(rng.integers(-3, 4, (60, 3)), np.ones((60, 1)), 1)  # whole numbers, so that products are exact
    rows = [(n, [float(x) for x in base[n % 60]]) for n in range(600)]  # ten rows at each distance
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(2)
    asked = df.where("id < 100").select(F.col("id").alias("qid"), "embedding")
    sizes = spark.sparkContext.accumulator(0)
    plain = vectors._products

    def watched(corpus, queries, columns, own, filtered, skip_self, keep):
        def seen(distance, ids):
            sizes.add(int(len(distance) > vectors.TILE))
            return keep(distance, ids)

        return plain(corpus, queries, columns, own, filtered, skip_self, seen)

    monkeypatch.setattr(vectors, "_products", watched)
    monkeypatch.setattr(vectors, "TILE", 16)
    got = {}
    for r in vectors.nearest(df, asked, 15).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
    size = np.sqrt((base * base).sum(1))
    every = 1 - base @ base.T / np.outer(size, size)
    for q, found in got.items():
        want = sorted(range(600), key=lambda i: (every[q % 60, i % 60], i))[:15]
        assert [found[n] for n in range(1, 16)] == want
    assert len(got) == 100 and sizes.value == 0


def test_a_second_layer_is_asked_only_where_the_first_says_yes(spark):
    from factloom.operators import guards

    rows = spark.createDataFrame([("what is the exit load",)], "q string")
    never = lambda text: F.raise_error(F.lit("asked")).cast("string")
    got = rows.select(guards.guard_chain(F.col("q"), F.lit(True), never).alias("c"), guards.two_layer_advice(F.col("q"), never)["blocked"].alias("a"), guards.two_layer_performance(F.col("q"), never)["blocked"].alias("p")).first()
    assert [d["triggered"] for d in got["c"]] == [False] * 4 and got["a"] is False and got["p"] is False


def test_a_trace_is_made_once(spark, sf):
    from factloom.catalogue.answering import full_trace

    assert all("/traces-" in f for f in full_trace(spark, sf).inputFiles())
