"""Evaluation sets: what is expected of questions and answers, and totals by set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import Settings
from factloom.functions.text import collapse
from factloom.operators import guards, resolve


def _result(name: str, key: str, expected: Column, got: Column, passed: Column) -> list[Column]:
    return [F.lit(name).alias("set"), F.col(key).cast("string").alias("id"), expected.alias("expected"), got.alias("got"), F.coalesce(passed, F.lit(False)).alias("passed")]


def refusals(rows: DataFrame, settings: Settings, aliases: dict[str, list[str]], key: str = "id", query: str = "query", expected: str = "expected_refusal_type") -> DataFrame:
    """(set, id, expected, got, passed): whether the guards stop each question for the expected reason (null: not at all)."""
    found = resolve.resolve(F.col(query), aliases, [s.scheme_id for s in settings.sources])
    told = rows.withColumn("_chain", guards.guard_chain(F.col(query), F.size(found["scheme_ids"]) > 0)).withColumn("_got", guards.refusal_type(F.col("_chain")))
    return told.select(*_result("refusal", key, F.col(expected), F.col("_got"), F.col("_got").eqNullSafe(F.col(expected))))


def personal_data(rows: DataFrame, key: str = "id", text: str = "text", label: str = "label") -> DataFrame:
    """(set, id, expected, got, passed): whether each text's kind of personal data is found and none of it is left when redacted."""
    got = guards.pii(F.col(text))["kind"]
    return rows.select(*_result("pii", key, F.col(label), got, got.eqNullSafe(F.col(label)) & ~guards.has_pii(guards.redacted(F.col(text)))))


def golden(rows: DataFrame, facts: DataFrame, key: str = "id") -> DataFrame:
    """(set, id, expected, got, passed): whether the stored value of (scheme_id, field) has the expected one in it."""
    own = facts.select("scheme_id", "field", F.col("value").alias("_got"))
    return rows.join(own, ["scheme_id", "field"], "left").select(*_result("golden", key, F.col("expected_value"), F.col("_got"), F.contains(collapse(F.col("_got")), collapse(F.col("expected_value")))))


def totals(results: DataFrame) -> DataFrame:
    """(set, n, passed) of results."""
    return results.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))
