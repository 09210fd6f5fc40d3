"""Checks of an answer against its evidence, as columns over one row per answer.

Rows have answer, query, evidence: array<struct<scheme_id, text>>, resolution (as
``resolve`` gives it) and, for the allowlist, an array of normalised URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import UPDATED_PREFIX, fact_tokens, last_updated, let, normalized_url, sentence_count, squeezed, urls
from factloom.operators.guards import gives_advice, pii

CHECKS = ("citation_present", "citation_allowed", "grounded", "evidence_scheme_match", "scheme_named", "no_advice", "no_pii", "sentence_budget", "has_last_updated")
#: A failure of one of these discards the answer without a retry.
DISCARD = ("citation_allowed", "no_advice", "no_pii")


def ungrounded(answer: Column, evidence: Column, query: Column, exact: bool = False) -> Column:
    """The answer's fact tokens that stand neither in the evidence nor in the question.

    By default a token may stand within a longer one, white space apart; ``exact``
    asks for it as a token.
    """
    texts = F.transform(evidence, lambda e: F.coalesce(e["text"], F.lit("")))
    if exact:
        known = F.array_union(F.flatten(F.transform(texts, fact_tokens)), fact_tokens(query))
        return let(F.transform(known, squeezed), lambda own: F.filter(fact_tokens(answer), lambda t: ~F.array_contains(own, squeezed(t))))
    # squeezed once, not for each token; a zero byte is in no token, so none spans evidence and question
    told = squeezed(F.concat(F.array_join(texts, " "), F.lit("\0"), F.coalesce(query, F.lit(""))))
    return let(told, lambda own: F.filter(fact_tokens(answer), lambda t: ~F.contains(own, squeezed(t))))


def _skipped(resolution: Column) -> Column:
    return F.coalesce((F.size(resolution["scheme_ids"]) == 0) | resolution["ambiguous"], F.lit(True))


def evidence_conflicts(evidence: Column, resolution: Column) -> Column:
    own = F.array_distinct(F.filter(F.transform(evidence, lambda e: e["scheme_id"]), lambda s: F.coalesce(s != "", F.lit(False))))
    return F.when(_skipped(resolution), F.array().cast("array<string>")).otherwise(F.array_except(own, resolution["scheme_ids"]))


def scheme_named(answer: Column, resolution: Column, prefix: str = "") -> Column:
    short = F.transform(resolution["scheme_ids"], lambda s: F.replace(s, F.lit(prefix), F.lit("")) if prefix else s)
    names = F.concat(F.array(F.coalesce(resolution["matched_alias"], F.lit(""))), short, F.transform(short, lambda s: F.replace(s, F.lit("_"), F.lit(" "))))
    return _skipped(resolution) | let(F.lower(F.coalesce(answer, F.lit(""))), lambda low: F.exists(names, lambda n: (n != "") & F.contains(low, F.lower(n))))


def checks(answer: Column, query: Column, evidence: Column, resolution: Column, allowlist: Column, max_sentences: int = 3, prefix: str = "") -> dict[str, Column]:
    cited = urls(answer)
    return {
        "citation_present": F.size(cited) == 1,
        "citation_allowed": F.coalesce(let(cited, lambda own: (F.size(own) == 1) & let(F.get(own, F.lit(0)), lambda u: F.array_contains(allowlist, normalized_url(u)))), F.lit(False)),
        "grounded": F.size(ungrounded(answer, evidence, query)) == 0,
        "evidence_scheme_match": F.size(evidence_conflicts(evidence, resolution)) == 0,
        "scheme_named": F.coalesce(scheme_named(answer, resolution, prefix), F.lit(False)),
        "no_advice": ~gives_advice(answer),
        "no_pii": pii(answer).isNull(),
        "sentence_budget": sentence_count(answer) <= max_sentences,
        "has_last_updated": F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lit(UPDATED_PREFIX.lower())),
    }


def validated(rows: DataFrame, allowlist: list[str], max_sentences: int = 3, prefix: str = "") -> DataFrame:
    """Adds checks (map), failures (in order), passed, discardable, sentences, ungrounded_tokens, pii_kind, cited_date."""
    c = F.col
    known = F.array(*[normalized_url(F.lit(u)) for u in allowlist]) if allowlist else F.array().cast("array<string>")
    # what several results are made of is computed once, and the checks that follow from it read it
    parts = {"sentences": sentence_count(c("answer")), "ungrounded_tokens": ungrounded(c("answer"), c("evidence"), c("query")), "pii_kind": pii(c("answer"))["kind"], "cited_date": last_updated(c("answer"))}
    rows = rows.withColumn("_told", let(F.struct(*[v.alias(n) for n, v in parts.items()]), lambda t: t))
    made = checks(c("answer"), c("query"), c("evidence"), c("resolution"), known, max_sentences, prefix)
    made |= {"grounded": F.size("_told.ungrounded_tokens") == 0, "no_pii": c("_told.pii_kind").isNull(), "sentence_budget": c("_told.sentences") <= max_sentences}
    rows = rows.withColumn("checks", let(F.array(*[F.struct(F.lit(n).alias("key"), made[n].alias("value")) for n in CHECKS]), F.map_from_entries))
    failed = F.transform(F.filter(F.map_entries("checks"), lambda e: ~e["value"]), lambda e: e["key"])
    rows = rows.select(*[x for x in rows.columns if x != "_told"], failed.alias("failures"), *[c(f"_told.{n}").alias(n) for n in parts])
    return rows.withColumns({"passed": F.size("failures") == 0, "discardable": F.arrays_overlap("failures", F.array(*map(F.lit, DISCARD)))})


def safe_citation(answer: Column, allowlist: list[str]) -> Column:
    """The answer's first URL if it is allowlisted, else the allowlist's first."""
    own = F.get(urls(answer), F.lit(0))
    known = F.array(*[normalized_url(F.lit(u)) for u in allowlist])
    return F.when(F.array_contains(known, normalized_url(own)), own).otherwise(F.lit(allowlist[0]))
