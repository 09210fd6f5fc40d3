"""A batch of questions to answers: guards, resolution, search, re-ranking, generation, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.config import Settings
from factloom.functions import text as T
from factloom.operators import answer, guards, history, rerank, resolve, store, vectors
from factloom.session import staged

c = F.col


def retrieve(turns: DataFrame, settings: Settings, aliases: dict[str, list[str]]) -> DataFrame:
    """Questions (conv_id, turn, question) with hint, resolution, decisions and refusal, before any search.

    A turn with personal data keeps neither its text nor a place in later history.
    """
    shown = F.substring(T.collapse(F.coalesce("question", F.lit(""))), 1, settings.max_query_chars)
    rows = turns.withColumn("_raw", shown).withColumn("resolution", resolve.resolve(c("_raw"), aliases, [s.scheme_id for s in settings.sources]))
    rows = rows.withColumn("question", guards.redacted(c("_raw")))
    rows = history.carried_forward(rows, F.when(~c("resolution.ambiguous"), c("resolution.scheme_ids")), settings.history_turns)
    rows = rows.withColumn("resolution", history.with_hint(c("resolution"), c("hint")))
    rows = rows.withColumn("decisions", guards.guard_chain(c("_raw"), F.size("resolution.scheme_ids") > 0))
    kind = guards.refusal_type(c("decisions"))
    refusals = {**guards.REFUSALS, "out_of_corpus": guards.scope_refusal([s.scheme_name for s in settings.sources])}
    text = F.try_element_at(F.create_map(*[F.lit(x) for kv in refusals.items() for x in kv]), c("refusal_type"))
    rows = rows.withColumn("refusal_type", kind).withColumn("refusal_text", text)
    names = F.create_map(*[F.lit(x) for s in settings.sources for x in (s.scheme_id, s.scheme_name)])
    lead = F.when(c("resolution.matched_alias") == "from conversation history", F.try_element_at(names, F.get("resolution.scheme_ids", F.lit(0))))
    return rows.withColumn("query", F.when(c("refusal_type") == "pii", "").otherwise(c("_raw"))).withColumn("search_text", F.concat_ws(" ", lead, "query")).drop("_raw")


def answer_turns(spark: SparkSession, turns: DataFrame, settings: Settings, aliases: dict[str, list[str]], corpus: DataFrame, dim: int = 64, write=None, fetched_at: str = "2024-01-01") -> DataFrame:
    """(qid, conv_id, turn, text, citation_url, status, failures, retries): every turn once.

    ``corpus`` has vec_id, embedding and label; a label stands for an entity by its
    remainder. Only turns that no guard stopped are embedded and searched for.
    """
    asked = staged(retrieve(turns, settings, aliases).withColumn("qid", F.xxhash64("conv_id", "turn")), "asked")
    open_rows = asked.where("refusal_type is null")
    ids = [s.scheme_id for s in settings.sources]
    scheme = F.get(F.array(*map(F.lit, ids)), (c("label") % len(ids)).cast("int"))
    chunks = corpus.select(c("vec_id").alias("id"), "embedding", scheme.alias("scheme_id"))
    queries = staged(store.embed(open_rows.select("qid", "search_text", c("resolution.scheme_ids").alias("allowed")), "search_text", dim).drop("search_text"), "queries")
    near = vectors.nearest(chunks, queries, settings.candidate_k, label_col="scheme_id", allowed_col="allowed")
    near = staged(near, "candidates")
    grounded = vectors.grounded(near, queries, settings.floor)
    found = near.join(chunks, "id").withColumns({"field": F.concat(F.lit("f"), (c("id") % 3).cast("string")), "value": F.concat((c("id") % 5).cast("string"), F.lit("%")), "historical": F.lit(False)})
    chosen = rerank.rerank(found, settings.final_k, settings.mmr_lambda, settings.max_per_field)
    urls = F.create_map(*[F.lit(x) for s in settings.sources for x in (s.scheme_id, s.url)])
    names = F.create_map(*[F.lit(x) for s in settings.sources for x in (s.scheme_id, s.scheme_name)])
    own = chosen.join(found.select("qid", "id", "scheme_id", "field", "value"), ["qid", "id"])
    text = F.concat(F.element_at(names, c("scheme_id")), F.lit(" "), c("field"), F.lit(" is "), c("value"))
    line = answer.context_line(c("field"), F.lit(False), F.element_at(names, c("scheme_id")), c("value"), text, F.element_at(urls, c("scheme_id")))
    contexts = answer.prompt_contexts(own.withColumn("line", line))
    evidence = own.groupBy("qid").agg(F.collect_list(F.struct("scheme_id", text.alias("text"))).alias("evidence"))
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-settings.history_turns, -1)
    told = F.when(history.usable(c("question")) & ~c("question").startswith("[redacted"), F.struct("question", F.lit("").alias("answer")))
    rows = asked.withColumn("history", F.collect_list(told).over(order)).join(grounded, "qid", "left").join(contexts, "qid", "left").join(evidence, "qid", "left")
    rows = rows.withColumns({"grounded": F.coalesce("grounded", F.lit(False)), "evidence": F.coalesce("evidence", F.array().cast("array<struct<scheme_id:string,text:string>>"))})
    floor = (c("refusal_type").isNull()) & ~c("grounded")
    rows = rows.withColumns({"refusal_text": F.when(floor, guards.REFUSALS["ungrounded"]).otherwise(c("refusal_text")), "refusal_type": F.when(floor, "ungrounded").otherwise(c("refusal_type"))})
    rows = rows.select("qid", "conv_id", "turn", "query", "context", "evidence", "resolution", "refusal_type", "refusal_text", "grounded", "history")
    rows = staged(rows, "rows")
    out = answer.answered(rows, write or answer.FakeGenerator(date=fetched_at), settings, fetched_at, "alpha_")
    return rows.select("qid", "conv_id", "turn", "refusal_type").join(out, "qid")
