"""Steps of verify that are done once, and the same results as the plain forms."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from factloom import config, session
from factloom.functions import text as T
from factloom.operators import chunking, quality, store
from factloom.plans import ingest, verify


def test_stored_documents_are_read_once_for_each_family(spark, sf):
    from factloom.catalogue import shaping

    docs = session.staged(shaping.fact_documents(spark, sf), "documents")
    assert session.staged(docs, "again") is docs and session.staged(docs.limit(1), "some") is not docs
    plan = ingest.chunk_rows(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 6  # five families and the categories


def test_texts_are_searched_only_for_what_the_facts_lack(spark):
    docs = spark.createDataFrame([("s", "NAV: ₹5\nRating: 3", "H", {"nav": " ₹7 "})], "scheme_id string, text string, amc_name string, facts map<string,string>")
    rows = chunking.registry_values(docs, compared=False)
    assert {r["field"]: r["value"] for r in rows.collect() if r["value"]} == {"nav": "₹7", "rating": "3"}
    assert "from_text" not in rows.columns and {r["field"]: r["value"] for r in chunking.registry_values(docs).collect()} == {r["field"]: r["value"] for r in rows.collect()}


def test_long_short_and_missing_bodies(spark):
    long = ". ".join(" ".join(f"w{i}" for i in range(n)) for n in (30, 10, 25, 5))
    body = dict(scheme_id="s", doc_id="d", scheme_name="N", source_url="u", section="about", value="v", value_type="text", scope="fund", is_fact=False, historical=False, effective_date=None, family=0, pos=0)
    rows = spark.createDataFrame([{**body, "field": f, "body": b} for f, b in (("a", long), ("b", "one two."), ("c", None))], "scheme_id string, doc_id string, scheme_name string, source_url string, section string, value string, value_type string, scope string, is_fact boolean, historical boolean, effective_date date, family int, pos int, field string, body string")
    settings = config.Settings(chunk_tokens=20, overlap_tokens=5)
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    want = [(f"s_about_a_{i}", t, count(t)) for i, t in enumerate(chunking.split_recursively(long, 20, 5, settings.separators, count))]
    got = chunking.chunks(rows, spark.createDataFrame([("s", "C")], "scheme_id string, category string"), settings).select("chunk_id", "text", "token_count").collect()
    assert sorted(map(tuple, got)) == want + [("s_about_b_0", "one two.", 3), ("s_about_c_0", None, 0)] and len(want) > 3


def test_trims_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame([(f"{chr(i)} {chr(i)}a{chr(i)}b{chr(i)}\n",) for i in range(0x3100)], "x string")
    assert rows.where(~T.strip(F.col("x")).eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert rows.where(~T.cleaned(F.col("x")).eqNullSafe(F.regexp_replace(F.translate("x", "\n\r", " "), r"(?U)^\s+|\s+$", ""))).count() == 0


def test_hashed_vectors_by_a_plain_loop(spark):
    texts = ["a b a ₹5", "", None, "A É ü x_1 — ."] + [f"w{i} w{i // 2} z" for i in range(50)]
    got = store.embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string"), "t", 16).collect()
    for r in got:
        v = np.zeros(16, np.float32)
        for w in re.findall(r"\w+", (texts[r["id"]] or "").lower()):
            h = zlib.crc32(w.encode())
            v[h % 16] += 1.0 if h & (1 << 31) else -1.0
        size = np.sqrt(v @ v)
        assert r["embedding"] == (v / size if size else v).tolist()
    assert len(got) == len(texts)


def test_equal_vectors_that_are_no_numbers_differ(spark):
    nan, inf = float("nan"), float("inf")
    sides = {"same": ([1.0, 0.0], [1.0, 0.0]), "near": ([1.0, 0.0], [1.0, 0.00001]), "far": ([1.0, 0.0], [1.0, 0.1]), "nan": ([nan, 0.0], [nan, 0.0]), "inf": ([-inf, 0.0], [-inf, 0.0]), "null": (None, [1.0, 0.0]), "short": ([1.0], [1.0])}
    made = [spark.createDataFrame([(k, *v) for k, v in sides.items()], "chunk_id string, a array<float>, b array<float>").select("chunk_id", *[F.lit("x").alias(x) for x in dict.fromkeys(["text", "value", "embed_input", "historical", *verify.METADATA])], F.col(side).alias("embedding")) for side in "ab"]
    assert {r["key"]: r["detail"] for r in verify._compared(*made, 2).collect()} == {"far": "differs", "nan": "differs", "inf": "differs", "null": "not stored", "short": "length"}


def test_checks_of_the_same_rows_together(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -5)], "k int, x int")
    checks = [("high", F.col("x") > 3, F.col("x")), ("low", F.col("x") < 3, F.lit("low")), ("far", F.abs("x") > 4, F.col("x"))]
    apart = quality.together([quality.failures(rows, rule, F.col("k"), bad, detail) for rule, bad, detail in checks])
    assert sorted(map(tuple, quality.all_failures(rows, F.col("k"), checks).collect())) == sorted(map(tuple, apart.collect())) != []
