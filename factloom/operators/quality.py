"""Data-quality rules as failure rows (rule, key, detail); a load with any is refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalized_url, strip
from factloom.operators.chunking import REGISTRY


class AuditFailed(ValueError):
    """The audit found failures; nothing may be stored."""


def failures(rows: DataFrame, rule: str, key: Column, bad: Column, detail: Column) -> DataFrame:
    return rows.where(F.coalesce(bad, F.lit(False))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def all_failures(rows: DataFrame, key: Column, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """``failures`` of several checks (rule, bad, detail) of the same rows, which are read once."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))) for rule, bad, detail in checks]
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("_found")).select("_found.rule", "_found.key", "_found.detail")


def blank(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose input for the embedder is null or nothing but white space of any kind."""
    return failures(rows, "blank_input", F.col(key), *_blank(text))


def _blank(text: str) -> tuple[Column, Column]:
    return F.col(text).isNull() | (strip(F.col(text)) == ""), F.concat(F.coalesce(F.length(text), F.lit(0)), F.lit(" blank characters"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def gold_mismatches(gold: DataFrame, rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Gold rows without a row, or with another value (ends stripped)."""
    own = rows.select(*keys, F.col(value).cast("string").alias("_got"), F.lit(True).alias("_there"))
    joined = gold.join(own, keys, "left")
    differs = F.col("_there").isNull() | ~strip(F.col("_got")).eqNullSafe(strip(F.col(value).cast("string")))
    detail = F.when(F.col("_there").isNull(), F.lit("missing")).otherwise(F.concat(F.lit("expected "), F.coalesce(F.col(value).cast("string"), F.lit("null")), F.lit(", got "), F.coalesce("_got", F.lit("null"))))
    return failures(joined, "gold", F.concat_ws(".", *keys), differs, detail)


def repeated_keys(rows: DataFrame, key: str, rule: str = "unique") -> DataFrame:
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return failures(counts, rule, F.col(key), F.col("_n") > 1, F.concat(F.col("_n"), F.lit(" rows")))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, rule: str = "orphan", row_key: str | None = None) -> DataFrame:
    known = parents.select(F.col(parent_key).alias("_known")).distinct()
    lost = rows.join(known, rows[key] == known["_known"], "left_anti")
    return failures(lost, rule, F.col(row_key or key), F.lit(True), F.col(key))


def outside(rows: DataFrame, key: str, column: str, accepted: list[str], rule: str = "accepted") -> DataFrame:
    return failures(rows, rule, F.col(key), ~F.coalesce(F.col(column).isin(accepted), F.lit(False)), F.col(column))


def noisy(rows: DataFrame, key: str, text: str, markers: tuple[str, ...]) -> DataFrame:
    return together([failures(rows, "noise", F.col(key), F.col(text).contains(m), F.lit(m)) for m in markers])


def drift(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) by full outer join: missing, added, or the first changed column."""
    a = stored.select(F.col(key), *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = fresh.select(F.col(key), *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_b"))
    change = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added")
    for c in columns:
        change = change.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), f"changed {c}")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids that only one side has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionAll(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def distinct_values(rows: DataFrame, by: str, value: str, current: Column) -> DataFrame:
    return rows.where(current).groupBy(by).agg(F.countDistinct(value).alias("n_distinct"), F.count(F.lit(1)).alias("n"))


def audit(chunks: DataFrame, allowlist: DataFrame, budget: int, markers: tuple[str, ...] = ("Compare similar funds", "Return calculator", "Understand terms"), gold: DataFrame | None = None, distinct: dict[str, int] | None = None, historical: DataFrame | None = None) -> DataFrame:
    """All failures of a set of chunks."""
    c, key = F.col, F.col("chunk_id")
    known = allowlist.select(normalized_url(c("url")).alias("_known")).distinct()
    stray = chunks.join(known, normalized_url(c("source_url")) == c("_known"), "left_anti")
    labels = F.create_map(*[F.lit(x) for r in REGISTRY if "{" not in r[2] for x in (r[0], r[2])])
    label = F.try_element_at(labels, c("field"))
    latest = chunks.where(~c("historical")).groupBy("field", "scheme_id").agg(F.max_by("value", "chunk_id").alias("value"))
    checks = [
        ("token_budget", c("token_count") > budget, F.concat(c("token_count"), F.lit(" tokens"))),
        *[("noise", c("text").contains(m), F.lit(m)) for m in markers],
        ("label_value_atomic", c("is_fact") & label.isNotNull() & ~F.contains("text", label), F.lit("label split from value")),
        ("label_value_atomic", c("is_fact") & (c("value") != "") & ~F.contains("text", c("value")), F.lit("value absent from text")),
        ("scope", (c("scope") == "amc") & ~c("field").isin("amc_aum_total", "amc_incorporation_date"), F.lit("unexpected amc scope")),
        ("scope", (c("field") == "amc_aum_total") & (c("scope") != "amc"), F.lit("must have scope amc")),
    ]
    if "embed_input" in chunks.columns:
        checks.append(("blank_input", *_blank("embed_input")))
    parts = [all_failures(chunks, key, checks), failures(stray, "allowlist", key, F.lit(True), c("source_url")), repeated_keys(chunks, "chunk_id")]
    if gold is not None:
        parts.append(gold_mismatches(gold, latest, ["field", "scheme_id"]))
    if distinct:
        counts = distinct_values(chunks.where(c("field").isin(list(distinct))), "field", "value", ~c("historical"))
        want = F.try_element_at(F.create_map(*[F.lit(x) for kv in distinct.items() for x in kv]), c("field"))
        parts.append(failures(counts, "distinct", c("field"), c("n_distinct") != want, F.concat(c("n_distinct"), F.lit(" distinct values"))))
    if historical is not None:
        counts = chunks.groupBy("scheme_id").agg(F.sum((c("field") == "exit_load_historical").cast("int")).alias("_n"))
        joined = historical.join(counts, "scheme_id", "left")
        parts.append(failures(joined, "historical", c("scheme_id"), F.coalesce("_n", F.lit(0)) != c("expected"), F.concat(F.coalesce("_n", F.lit(0)), F.lit(" historical rows"))))
    return together(parts)


def summary(found: DataFrame, rules: list[str]) -> DataFrame:
    """(rule, failures, status) for every rule, those without failures too."""
    every = found.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    counts = found.groupBy("rule").agg(F.count(F.lit(1)).alias("failures"))
    n = F.coalesce("failures", F.lit(0))
    return every.join(counts, "rule", "left").select("rule", n.alias("failures"), F.when(n == 0, "ok").otherwise("fail").alias("status"))


def gate(found: DataFrame, show: int = 10) -> None:
    """Raises with the first few failures; the only action of the audit."""
    rows = found.limit(show + 1).collect()
    if rows:
        raise AuditFailed("; ".join(f"{r['rule']} {r['key']}: {r['detail']}" for r in rows[:show]))
