"""Keyed stores of rows and vectors: upserts, fingerprints, cached embeddings, run logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vectors as V


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; old rows that vanished stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def record(c: Column, kind: str = "string") -> Column:
    """A store's scalar: null as empty, dates in ISO."""
    text = F.date_format(c, "yyyy-MM-dd") if kind == "date" else c.cast("string")
    return F.coalesce(text, F.lit(""))


def records(rows: DataFrame) -> DataFrame:
    """The projection a store keeps: every column but vectors as text."""
    return rows.select(*[F.col(n) if t.startswith("array") else record(F.col(n), t).alias(n) for n, t in rows.dtypes])


#: Characters that ``ordered_fingerprint`` puts in one row.
MANIFEST_CHARS = 64_000_000


def fingerprint(rows: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """One row: a fingerprint of the model and the rows' keys and texts, whatever their order.

    Each row is hashed on its own and the hashes are added up in four parts, so rows
    are never brought together: partial sums meet, not texts.
    """
    h = F.sha2(F.concat(F.col(key).cast("string"), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), 256)
    parts = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = rows.select(h.alias("_h")).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select(F.sha2(F.concat_ws(",", F.lit(model), "n", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


def ordered_fingerprint(rows: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """One row: SHA-256 over the model and then each row's key and text in key order, as one text.

    Everything comes together in one row, so it is for manifests: rows of more than
    MANIFEST_CHARS in all are an error before anything is brought together.
    ``fingerprint`` is for a corpus.
    """
    size = rows.agg(F.coalesce(F.sum(F.length(F.col(key).cast("string")) + F.length(F.coalesce(F.col(text), F.lit("")))), F.lit(0))).first()[0]
    if size > MANIFEST_CHARS:
        raise ValueError(f"a manifest of {size} characters; fingerprint() takes any number of rows")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return rows.agg(F.sha2(F.concat(F.lit(model), F.array_join(F.transform(pairs, lambda s: F.concat(s["k"], s["t"])), "")), 256).alias("fingerprint"))


def stale(rows: DataFrame, cached: DataFrame, key: str, text: str, model: str, dim: int) -> DataFrame:
    """Rows whose embedding must be made: no cached row of the same key, text hash, model and length."""
    valid = cached.where((F.col("model") == model) & (F.size("embedding") == dim)).select(F.col(key), F.col("text_hash"))
    own = rows.withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return own.join(valid, [key, "text_hash"], "left_anti")


def embed(rows: DataFrame, text: str, dim: int = 64, name: str = "embedding", embedder=None) -> DataFrame:
    """Adds unit vectors: ``embedder`` (Column to Column of array<float>) or hashed bags of words, batched in Arrow."""
    if embedder is not None:
        return rows.withColumn(name, embedder(F.col(text)))

    @F.arrow_udf("array<float>")
    def hashed(texts):
        import re
        import zlib

        import numpy as np
        import pyarrow as pa

        words = [re.findall(r"\w+", (t or "").lower()) for t in texts.to_pylist()]
        known: dict[str, int] = {}
        for own in words:
            for w in own:
                if w not in known:
                    known[w] = zlib.crc32(w.encode())
        h = np.array([known[w] for own in words for w in own], np.int64)
        place = np.repeat(np.arange(len(words)), np.array([len(own) for own in words], np.int64)) * dim + h % dim
        v = np.bincount(place, np.where(h >> 31, 1.0, -1.0), len(words) * dim).astype(np.float32).reshape(-1, dim)
        size = np.sqrt(np.einsum("ij,ij->i", v, v))
        v /= np.where(size == 0, np.float32(1), size)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim), pa.int32()), pa.array(v.ravel()))

    return rows.withColumn(name, hashed(F.col(text)))


def cached_embeddings(rows: DataFrame, cached: DataFrame | None, key: str, text: str, model: str, dim: int, embedder=None) -> DataFrame:
    """(key, text_hash, model, embedding) of all rows; only stale ones are embedded anew."""
    columns = [key, "text_hash", "model", "embedding"]
    if cached is None:
        fresh = rows.withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        return embed(fresh, text, dim, embedder=embedder).withColumn("model", F.lit(model)).select(*columns)
    made = embed(stale(rows, cached, key, text, model, dim), text, dim, embedder=embedder).withColumn("model", F.lit(model)).select(*columns)
    current = rows.select(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_hash"))
    kept = cached.where((F.col("model") == model) & (F.size("embedding") == dim)).join(current, [key, "text_hash"], "left_semi").select(*columns)
    return kept.unionByName(made)


def write_records(rows: DataFrame, path: str, partition: str | None = None, rebuild: bool = True) -> None:
    """Stores rows as Parquet; only partitions that occur are replaced unless rebuilt."""
    writer = rows.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "static" if rebuild else "dynamic")
    writer.parquet(path)


def open_or_create(spark: SparkSession, path: str, schema: str, rebuild: bool = False) -> DataFrame:
    """The rows stored at ``path``; an empty store is made where there is none, or anew with ``rebuild``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if rebuild or not there:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: What a chunk has where neither its row nor its metadata says so.
CHUNK_DEFAULTS = {"section": "", "field": "", "source_url": "", "value_type": "text", "scope": "fund", "is_fact": "false", "historical": "false"}


def chunks_from_metadata(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of search hits (chunk_id, text and metadata as text): the stored row where there is one, else rebuilt from the metadata with defaults."""
    own = [x for x in chunks.columns if x != "chunk_id"]
    stored = chunks.select("chunk_id", *[F.col(x).alias(f"_{x}") for x in own], F.lit(True).alias("_there"))

    def told(name: str, kind: str) -> Column:
        if name == "doc_id":
            made = F.coalesce(F.nullif("doc_id", F.lit("")), "scheme_id") if "doc_id" in hits.columns else F.col("scheme_id")
        elif name == "embed_input":
            made = F.col("text")
        elif name in hits.columns:
            made = F.nullif(F.col(name).cast("string"), F.lit("")) if name == "value" else F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(CHUNK_DEFAULTS.get(name)))
        else:
            made = F.lit(CHUNK_DEFAULTS.get(name))
        return F.when(F.col("_there"), F.col(f"_{name}")).otherwise(made.cast(kind)).alias(name)

    kinds = dict(chunks.dtypes)
    return hits.join(stored, "chunk_id", "left").select("chunk_id", *[told(x, kinds[x]) for x in own])


def vector_failures(stored: DataFrame, fresh: DataFrame, key: str, dim: int, tolerance: float = 1e-4) -> DataFrame:
    """(key, failure) by id: missing on a side, other length, or a number further off than ``tolerance``."""
    a = stored.select(F.col(key), F.col("embedding").alias("_a"))
    b = fresh.select(F.col(key), F.col("embedding").alias("_b"))
    bad = (
        F.when(F.col("_b").isNull(), "not fresh").when(F.col("_a").isNull(), "not stored").when((F.size("_a") != dim) | (F.size("_b") != dim), "length")
        .when(V.largest_delta(F.col("_a"), F.col("_b")) >= tolerance, "differs")
    )
    return a.join(b, key, "full_outer").select(key, bad.alias("failure")).where("failure is not null")


def too_long(rows: DataFrame, key: str, tokens: str, budget: int) -> DataFrame:
    return rows.where(F.col(tokens) > budget).select(key, tokens)


def write_run_log(spark: SparkSession, path: str, stage: str, duration_s: float, extra: dict | None = None, **parts) -> dict:
    """Appends one JSON row and gives it; ``extra`` is merged last and may replace anything."""
    from datetime import UTC, datetime

    entry = {"generated_at": datetime.now(UTC).isoformat(), "stage": stage, **parts, "duration_s": round(duration_s, 3), **(extra or {})}
    spark.createDataFrame([(json.dumps(entry, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("append").text(path)
    return entry


def read_run_log(spark: SparkSession, path: str) -> dict:
    """The latest entry, or an empty map where there is no log."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path).select("value", F.get_json_object("value", "$.generated_at").alias("at")).orderBy(F.desc("at")).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return {}
    return json.loads(rows[0]["value"]) if rows else {}
