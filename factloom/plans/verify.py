"""Integrity of a store against its documents, computed anew: one row for each check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import Settings
from factloom.functions import vectors as V
from factloom.operators import facts, quality, store
from factloom.plans.ingest import chunk_rows
from factloom.session import staged

METADATA = ("doc_id", "scheme_id", "section", "field", "source_url", "value", "value_type", "scope", "effective_date", "historical", "is_fact", "token_count")
CHECKS = ("documents", "unique_documents", "text_hash", "chunk_drift", "metadata", "token_budget", "ids", "unit_vectors", "vectors", "allowlist")


def _compared(stored: DataFrame, fresh: DataFrame, dim: int, tolerance: float = 1e-4) -> DataFrame:
    """(rule, key, detail) of chunk_drift, metadata, ids and vectors: both sides meet in one full outer join by id, and only what differs is stored."""
    own = ["text", "value", "embed_input", "historical"]
    columns = list(dict.fromkeys([*own, *METADATA, "embedding"]))
    left = stored.select(F.col("chunk_id").alias("_key_a"), *[F.col(x).alias(f"_a_{x}") for x in columns])
    right = fresh.select(F.col("chunk_id").alias("_key_b"), *[F.col(x).alias(f"_b_{x}") for x in columns])
    no_a, no_b = F.col("_key_a").isNull(), F.col("_key_b").isNull()

    def first_change(names) -> Column:
        out = F.lit(None).cast("string")
        for x in reversed(names):
            out = F.when(~F.col(f"_a_{x}").eqNullSafe(F.col(f"_b_{x}")), F.lit(f"changed {x}")).otherwise(out)
        return out

    missing = F.when(no_b, "missing").when(no_a, "added")
    length = (F.size("_a_embedding") != dim) | (F.size("_b_embedding") != dim)
    apart = F.when(no_b | F.col("_b_embedding").isNull(), "not fresh").when(no_a | F.col("_a_embedding").isNull(), "not stored").when(length, "length")
    # equal vectors of finite numbers need no differences
    a, b = F.col("_a_embedding"), F.col("_b_embedding")
    same = (a == b) & (F.array_max(a) < float("inf")) & (F.array_min(a) > float("-inf"))
    apart = apart.when(~F.coalesce(same, F.lit(False)) & (V.largest_delta(a, b) >= tolerance), "differs")
    details = {"chunk_drift": F.coalesce(missing, first_change(own)), "metadata": F.when(~no_a & ~no_b, first_change(METADATA)), "ids": F.when(no_b, "left").when(no_a, "right"), "vectors": apart}
    told = F.filter(F.array(*[F.struct(F.lit(rule).alias("rule"), detail.alias("detail")) for rule, detail in details.items()]), lambda x: x["detail"].isNotNull())
    joined = left.join(right, F.col("_key_a") == F.col("_key_b"), "full_outer").select(F.coalesce("_key_a", "_key_b").cast("string").alias("key"), F.explode(told).alias("t"))
    return staged(joined.select("t.rule", "key", "t.detail"), "verify-compared")


def verify(docs: DataFrame, stored: DataFrame, allowlist: DataFrame, settings: Settings = Settings(), dim: int = 64, embedder=None) -> DataFrame:
    """(rule, failures, status): documents, recomputed chunks and vectors against what is stored."""
    c = F.col
    docs, stored = staged(docs, "verify-documents"), staged(stored, "verify-store")
    fresh = store.embed(chunk_rows(docs, settings), "embed_input", dim, embedder=embedder)  # only the comparison reads them
    compared = _compared(stored, fresh, dim)
    lost = facts.document_failures(docs).where("failure like '%absent from text' or failure like 'noise%' or failure = 'scheme_name missing'")
    key = c("chunk_id")
    parts = [
        quality.failures(lost, "documents", c("scheme_id"), F.lit(True), c("failure")),
        quality.repeated_keys(docs, "doc_id", "unique_documents"),
        quality.failures(docs, "text_hash", c("doc_id"), F.sha2("text", 256) != c("text_sha256"), F.lit("differs")),
        quality.all_failures(stored, key, [("token_budget", c("token_count") > settings.chunk_tokens, c("token_count")), ("unit_vectors", ~V.is_unit(c("embedding")), F.lit("norm"))]),
        compared.where("rule <> 'ids'"),
        compared.where("rule = 'ids'").distinct(),
        quality.orphans(stored, allowlist, "source_url", "url", "allowlist", "chunk_id"),
    ]
    return quality.summary(quality.together(parts), list(CHECKS))
