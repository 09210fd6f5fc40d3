"""Prompts, pluggable generators, and the bounded generate-and-validate rounds."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import Settings
from factloom.functions.text import UPDATED_PREFIX, urls
from factloom.operators.history import history_text
from factloom.operators.validate import safe_citation, validated
from factloom.session import staged

SYSTEM = "Answer only from the context, in at most %d sentences, copying names and numbers. Name the scheme. End with one allowed citation and the line '" + UPDATED_PREFIX + " <date>'."
NOT_AVAILABLE = "That information is not available in the published pages."
FALLBACK = "I could not produce a verified answer. Please see the source page."


class Generator(Protocol):
    """What writes text: called in tasks, a batch of (system, user) at a time."""

    def chat(self, system: str, user: str, temperature: float, max_tokens: int) -> str: ...


class FakeGenerator:
    """Deterministic: canned text by question, else the context's first line with citation and date."""

    def __init__(self, canned: dict[str, str] | None = None, date: str = "2024-01-01"):
        self.canned, self.date = canned or {}, date

    def chat(self, system: str, user: str, temperature: float = 0.0, max_tokens: int = 220) -> str:
        if user in self.canned:
            return self.canned[user]
        lines = system.split("<context>\n", 1)[-1].split("\n</context>", 1)[0].split("\n")
        source = next((x.removeprefix("source: ") for x in lines if x.startswith("source: ")), "")
        return f"{lines[0]}\n{source}\n{UPDATED_PREFIX} {self.date}"


GENERATORS = {"fake": FakeGenerator}


def generator(provider: str, **options) -> Generator:
    if provider not in GENERATORS:
        raise ValueError(f"unknown generator {provider!r}; known: {sorted(GENERATORS)}")
    return GENERATORS[provider](**options)


def context_line(field: Column, historical: Column, name: Column, value: Column, text: Column, source: Column) -> Column:
    shown = F.coalesce(F.nullif(value, F.lit("")), text)
    old = F.when(historical, " [SUPERSEDED - not current]").otherwise("")
    return F.concat(F.lit("["), field, F.lit("]"), old, F.lit(" "), name, F.lit(": "), shown, F.lit("\nsource: "), source)


def prompt_contexts(selected: DataFrame) -> DataFrame:
    """(qid, context): lines of the selected rows (qid, rank, line) in rank order, a blank line between them."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return selected.groupBy("qid").agg(rows.alias("_r")).select("qid", F.array_join(F.transform("_r", lambda r: r["line"]), "\n\n").alias("context"))


def system_text(context: Column, query: Column, allowlist: list[str], max_sentences: int, history: Column | None = None) -> Column:
    head = SYSTEM % max_sentences + "\nAllowed citations:\n" + "\n".join(f"- {u}" for u in allowlist)
    text = F.concat(F.lit(f"{head}\n<context>\n"), context, F.lit("\n</context>\nQuestion: "), query)
    if history is None:
        return text
    told = F.concat(F.lit("\nConversation so far:\n"), history_text(history))
    return F.concat(text, F.when(F.size(history) > 0, told).otherwise(""))


def generated(rows: DataFrame, write: Generator, settings: Settings) -> DataFrame:
    """Adds answer from the columns system and query; null where the generator fails."""
    temperature, limit = settings.temperature, settings.generator_tokens

    @F.pandas_udf("string")
    def run(system, query):
        import pandas as pd

        def one(s, q):
            try:
                return write.chat(s, q, temperature, limit)
            except Exception:  # a generator may fail in any way; the row then gets the fallback
                return None

        return pd.Series([one(s, q) for s, q in zip(system, query, strict=True)], dtype=object)

    return rows.withColumn("answer", run("system", "query"))


def answered(rows: DataFrame, write: Generator, settings: Settings, fetched_at: str, prefix: str = "") -> DataFrame:
    """(qid, text, citation_url, status, failures, retries) of each row.

    Rows have qid, query, context, evidence, resolution, refusal_type, refusal_text,
    grounded and history. Refused rows never reach the generator, nor do rows without
    context. A failed answer is tried again with the reasons added, ``retries`` times;
    one that failed a discarding check is not. What is left gets the fixed fallback.
    Rounds are bounded and each is one pass over the rows still open.
    """
    c, lit = F.col, F.lit
    allowlist = [s.url for s in settings.sources]
    out = ["qid", "text", "citation_url", "status", "failures", "retries"]

    def row(df: DataFrame, text, url, status, failures, retries: int) -> DataFrame:
        return df.select("qid", text.alias("text"), url.cast("string").alias("citation_url"), lit(status).alias("status"), failures.cast("array<string>").alias("failures"), lit(retries).alias("retries")).select(*out)

    none = F.array()
    refused = rows.where("refusal_type is not null")
    open_rows = rows.where("refusal_type is null")
    empty = ~c("grounded") | (F.coalesce("context", lit("")) == "")
    parts = [row(refused, c("refusal_text"), lit(None), "refused", none, 0), row(open_rows.where(empty), lit(NOT_AVAILABLE), lit(allowlist[0]), "not_available", none, 0)]
    left = open_rows.where(~empty).withColumn("system", system_text(c("context"), c("query"), allowlist, settings.max_sentences, c("history")))
    link = safe_citation(c("answer"), allowlist)
    fallback = F.concat(lit(f"{FALLBACK}\n\nSource: "), link, lit(f"\n{UPDATED_PREFIX} {fetched_at}"))
    for attempt in range(settings.retries + 1):
        # what a round generates is used in several places and must be one text: it is cut off here
        tried = validated(generated(left, write, settings), allowlist, settings.max_sentences, prefix)
        tried = staged(tried, "answers")
        parts.append(row(tried.where("answer is null"), lit(FALLBACK), lit(allowlist[0]), "generator_failed", none, attempt))
        told = tried.where("answer is not null")
        parts.append(row(told.where("passed"), F.trim("answer"), F.get(urls(c("answer")), lit(0)), "answered", c("failures"), attempt))
        failed = told.where("not passed")
        last = attempt == settings.retries
        final = failed if last else failed.where("discardable")
        parts.append(row(final, fallback, link, "fallback", c("failures"), attempt))
        if not last:
            reasons = F.concat(c("system"), lit("\n\nYour previous answer failed: "), F.array_join("failures", ", "), lit(". Rewrite it accordingly."))
            left = failed.where("not discardable").withColumn("system", reasons).select(*left.columns)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every
