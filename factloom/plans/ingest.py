"""Documents to an audited store of chunks and vectors."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import Settings
from factloom.functions.text import token_count
from factloom.functions.vectors import norm
from factloom.operators import chunking, quality, store
from factloom.operators.observed import Watch
from factloom.operators.vectors import leader_clusters
from factloom.session import staged


#: The order in which an entity's chunks come: by family, place in it and piece.
ORDER = ("family", "pos", "piece")


def chunk_rows(docs: DataFrame, settings: Settings = Settings(), *keep: str) -> DataFrame:
    """Chunks of documents (columns of facts, text, facts map, doc_id, source_url); the allowlist is the documents' own entities."""
    return _cut(staged(docs, "documents"), settings, *keep)  # five families read them


def _cut(docs: DataFrame, settings: Settings, *keep: str) -> DataFrame:
    categories = docs.select("scheme_id", "category").distinct()
    return chunking.chunks(chunking.bodies(docs, holdings_mode=settings.holdings_mode), categories, settings, *keep)


def semantic_rows(docs: DataFrame, settings: Settings = Settings(), dim: int = 64, embedder=None) -> DataFrame:
    """Chunks of documents, those of an entity merged by leader clustering of their texts' vectors.

    The first chunk of an entity that no cluster has leads and takes every such chunk
    within ``cluster_distance``, in the chunks' order. A cluster is a chunk of its
    leader's section, source and value, whose text is its members'; the clusters of
    an entity are numbered. Entities may have any number of chunks, a cluster is one row.
    """
    return _merged(staged(docs, "documents"), settings, dim, embedder)


def _merged(docs: DataFrame, settings: Settings, dim: int, embedder) -> DataFrame:
    rows = chunking.numbered(_cut(docs, settings, *ORDER, "category"), ["scheme_id"], [*ORDER, "chunk_id"], "_id")
    rows = staged(store.embed(rows.withColumn("_id", F.col("_id").cast("long")), "text", dim, embedder=embedder), "semantic-chunks")
    told = leader_clusters(rows, "_id", "embedding", "scheme_id", "text", settings.cluster_distance)
    clusters = chunking.numbered(told.select(F.col("label").alias("scheme_id"), F.col("seed").alias("_id"), F.col("text").alias("_text")), ["scheme_id"], ["_id"], "_nth")
    led = clusters.join(rows, ["scheme_id", "_id"])
    template = settings.prefix_template.replace("%", "%%").replace("{scheme_name}", "%1$s").replace("{category}", "%2$s").replace("{text}", "%3$s")
    none = F.lit(None).cast("date")
    return led.select(
        F.concat_ws("_", "scheme_id", "section", F.lit("semantic"), "_nth").alias("chunk_id"), "doc_id", "scheme_id", "section", F.lit("semantic_cluster").alias("field"), F.col("_text").alias("text"),
        F.format_string(template, "scheme_id", "category", "_text").alias("embed_input"), "source_url", "value", F.lit("prose").alias("value_type"), F.lit("fund").alias("scope"), none.alias("effective_date"),
        F.lit(False).alias("historical"), F.lit(False).alias("is_fact"), token_count(F.col("_text")).alias("token_count"),
    )


def ingest(docs: DataFrame, settings: Settings = Settings(), dim: int = 64, embedder=None, allowlist: DataFrame | None = None, watch: Watch | None = None) -> DataFrame:
    """Chunks with vectors, after the audit found nothing: a failure raises before anything is embedded or stored.

    ``settings.strategy`` decides how documents are cut: ``semantic`` merges an entity's
    chunks (and is an error where it is not available), anything else keeps them by label.
    A ``watch`` takes figures of documents and chunks while they are written.
    """
    if settings.strategy == "semantic" and not settings.semantic_available:
        raise ValueError("strategy is semantic but it is not available")
    docs = staged(watch.rows("documents", docs, chunking.stat_figures()) if watch else docs, "documents")
    made = _merged(docs, settings, dim, embedder) if settings.strategy == "semantic" else _cut(docs, settings)
    chunks = staged(watch.rows("chunks", made, chunk_figures(settings)) if watch else made, "chunks")  # every rule of the audit reads them
    sources = allowlist if allowlist is not None else docs.select(F.col("source_url").alias("url"))
    quality.gate(quality.audit(chunks, sources, settings.chunk_tokens))
    return store.embed(chunks, "embed_input", dim, embedder=embedder)


SECTIONS = tuple(dict.fromkeys([r[1] for r in chunking.REGISTRY] + ["portfolio", "fund_management"]))


def chunk_figures(settings: Settings) -> dict[str, Column]:
    """Counts and token lengths; by section, and by entity for those that the settings list."""
    tokens = F.col("token_count")
    found = {"n": F.count(F.lit(1)), "tokens": F.coalesce(F.sum(tokens), F.lit(0)), "longest": F.max(tokens), "shortest": F.min(tokens), "facts": F.count_if(F.col("is_fact")), "historical": F.count_if(F.col("historical"))}
    found |= {f"section {s}": F.count_if(F.col("section") == s) for s in SECTIONS}
    return found | {f"scheme {s.scheme_id}": F.count_if(F.col("scheme_id") == s.scheme_id) for s in settings.sources}


def vector_figures() -> dict[str, Column]:
    size = norm(F.col("embedding"))
    return {"n": F.count(F.lit(1)), "shortest": F.min(F.size("embedding")), "longest": F.max(F.size("embedding")), "least_norm": F.min(size), "most_norm": F.max(size)}


def ingest_run(docs: DataFrame, path: str, log: str, settings: Settings = Settings(), dim: int = 64, embedder=None, allowlist: DataFrame | None = None) -> dict:
    """Stores what ``ingest`` makes at ``path`` and appends the run to the log at ``log``; gives the entry.

    The figures come from the writes themselves: documents, chunks and vectors are
    counted and measured by the tasks that write them. The decision is made of the
    documents' figures. A run that the audit stops leaves neither store nor entry.
    """
    began, watch = time.monotonic(), Watch()
    made = ingest(docs, settings, dim, embedder, allowlist, watch)
    store.write_records(watch.rows("vectors", made, vector_figures()), path)
    seen = watch.figures()
    chunks = seen["chunks"]
    parts = {kind: {n.removeprefix(f"{kind} "): chunks[n] for n in chunks if n.startswith(f"{kind} ")} for kind in ("section", "scheme")}
    sums = docs.sparkSession.createDataFrame([tuple(seen["documents"].values())], ", ".join(f"{n} long" for n in seen["documents"]))
    decision = chunking.strategy(chunking.stats_of(sums), settings).first().asDict()
    summary = {
        "documents": seen["documents"]["docs"], "chunks": {n: v for n, v in chunks.items() if " " not in n}, "chunks_per_section": parts["section"], "chunks_per_scheme": parts["scheme"],
        "vectors": seen["vectors"], "stored_at": path,
    }
    return store.write_run_log(docs.sparkSession, log, "ingest", time.monotonic() - began, decision=decision, stage_summary=summary, audit={"passed": True})
