"""Exact dedup over normalised text, with built-in functions alone.

Rows are grouped by the 128-bit MD5 of the normalised text together with the
text itself, so two texts that share a hash never share a group: the grouping
compares their bytes. Equal texts of one task collapse before the shuffle (the
aggregate is partial), hence a text that a third of all rows hold reaches the
reducer as one row for each task. What goes back to the rows is narrow: hash,
SHA-256, id and count, no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import fresh

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    The smallest id of equal texts stays. A null text is an empty text. Null ids
    sort after all others: such a row stays only where all ids of its group are
    null. Repeated rows (same id and text) count in group_size and are kept
    together; ``dedup`` leaves one of them. Other columns are not read. An empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text")).withColumns({"_hash": F.unhex(F.md5("_text")), "_sha": F.unhex(F.sha2("_text", 256))})
    texts = rows.groupBy("_hash", "_sha", "_text").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Texts that shared both digests would be told apart above and then meet here; better to stop than to mix them.
    groups = (
        texts.groupBy("_hash", "_sha")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
        .withColumn("group_size", F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share their MD5 and their SHA-256")).cast("long")))
        .drop("_texts")
    )
    # The key is made anew on both sides: each side then has an exchange of its own for the join, and a key that very many rows share can be split.
    key = F.concat("_hash", "_sha").alias("_key")
    joined = rows.select("_id", key).join(groups.select(key, "_sha", "keep_id", "group_size"), "_key")
    return joined.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    Of rows with the same id and text any one stays; null ids as in ``exact_groups``.
    Join and removal of repeated rows share one exchange of the texts.
    """

    k, sha = fresh(docs, "_key", "_sha")

    def key(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("\u0000none"))

    keep = exact_groups(docs, id_col, text_col).where("kept").select(key(id_col).alias(k), F.col("text_sha256").alias(sha))
    rows = docs.withColumns({k: key(id_col), sha: F.sha2(normalised(F.col(text_col)), 256)})
    return rows.join(keep, [k, sha], "left_semi").dropDuplicates([k, sha]).select(*docs.columns)
