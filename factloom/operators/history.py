"""Conversation state: turns paired into exchanges, windows of earlier ones, carried-forward hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

REDACTED = "[redacted"


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer) of each user turn; the answer is the next turn's text if the assistant speaks."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return (
        turns.withColumns({"_next": F.lead("text").over(order), "_role": F.lead("role").over(order)})
        .where("role = 'user'")
        .select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("_role") == "assistant", F.col("_next")).alias("answer"))
    )


def earlier(turns: int = 10):
    """The frame of up to ``turns`` earlier rows of a conversation."""
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-turns, -1)


def usable(question: Column) -> Column:
    """Questions that history may show: neither empty nor redacted."""
    return F.coalesce((question != "") & ~question.startswith(REDACTED), F.lit(False))


def history(rows: DataFrame, turns: int = 10) -> DataFrame:
    """Adds history: array of struct(question, answer) of the earlier usable exchanges, oldest first."""
    one = F.when(usable(F.col("question")), F.struct("question", "answer"))
    return rows.withColumn("history", F.collect_list(one).over(earlier(turns)))


def carried_forward(rows: DataFrame, value: Column, turns: int = 10, name: str = "hint") -> DataFrame:
    """Adds the last non-null ``value`` of the earlier usable exchanges (an as-of join of a conversation with itself)."""
    return rows.withColumn(name, F.last(F.when(usable(F.col("question")), value), ignorenulls=True).over(earlier(turns)))


def history_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("Q: "), t["question"], F.lit("\nA: "), F.coalesce(t["answer"], F.lit("")))), "\n")


def with_hint(resolution: Column, hint: Column) -> Column:
    """The hint stands in where nothing was resolved: confidence 0.5, not ambiguous."""
    use = (F.size(resolution["scheme_ids"]) == 0) & hint.isNotNull() & (F.size(hint) > 0)
    return F.struct(
        F.when(use, hint).otherwise(resolution["scheme_ids"]).alias("scheme_ids"),
        F.when(use, "from conversation history").otherwise(resolution["matched_alias"]).alias("matched_alias"),
        F.when(use, 0.5).otherwise(resolution["confidence"]).alias("confidence"),
        F.when(use, False).otherwise(resolution["ambiguous"]).alias("ambiguous"),
    )
