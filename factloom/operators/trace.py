"""Traces as nested columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

STAGES = tuple(f"stage{i}" for i in range(1, 7))


def top_chunk(rank: Column, chunk_id: Column, scheme_id: Column, field: Column, value: Column, distance: Column, source: Column) -> Column:
    return F.struct(rank.alias("rank"), chunk_id.alias("chunk_id"), scheme_id.alias("scheme_id"), field.alias("field"), value.alias("value"), F.round(distance, 6).alias("cosine_distance"), source.alias("source_url"))


def retrieval(decisions: Column, resolution: Column, chunks: Column) -> Column:
    """Stage five: guard decisions, what was resolved and the chunks taken (structs of ``top_chunk``)."""
    return F.struct(decisions.alias("guard_decisions"), resolution.alias("scheme_resolution"), chunks.alias("top_chunks"))


def generation(citation: Column, validation: Column, retries: Column) -> Column:
    """Stage six: the citation, the checks and the tries."""
    return F.struct(citation.alias("citation_url"), validation.alias("validation"), retries.alias("retry_count"))


def recorded(log: dict) -> dict[str, Column]:
    """Stages one to four as the run log has them; what it lacks, or what is no object, is left out."""
    told = log.get("trace") if isinstance(log.get("trace"), dict) else {}
    return {f"stage{i}": F.lit(json.dumps(told[f"stage{i}"], ensure_ascii=False)) for i in range(1, 5) if isinstance(told.get(f"stage{i}"), dict)}


def trace(**stages: Column) -> Column:
    """A struct of the six stages; those not given are null."""
    return F.struct(*[stages.get(s, F.lit(None).cast("string")).alias(s) for s in STAGES])


def is_complete(t: Column) -> Column:
    out = F.lit(True)
    for s in STAGES:
        out = out & t[s].isNotNull()
    return out


def to_text(t: Column) -> Column:
    return F.coalesce(F.to_json(t, {"ignoreNullFields": "false"}), F.lit("{}"))
