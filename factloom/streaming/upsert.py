"""Streaming sink of keyed rows: the last row of a key stays, batch after batch.

The table lies in buckets of the key, and each batch makes a version of the buckets
that it touches: ``<path>/v=<epoch>/_bucket=<n>``. A batch reads and writes the
buckets of its own keys alone, in one job, so its cost follows the batch, not the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.store import upsert

BUCKETS = 64
#: Versions of a bucket that stay behind the newest: a batch that runs again needs the one before its own.
KEPT = 1


def upserting(path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function.

    Of a batch's rows of one key the one with the largest ``order`` counts. A batch
    that runs again writes its versions again from those before it, so rows are
    applied once; readers take each bucket's latest version (``latest``). Older
    versions are removed, KEPT of them stay.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").withColumn("_bucket", bucket).persist()
        touched = [r["_bucket"] for r in last.select("_bucket").distinct().collect()]  # ``buckets`` rows at most
        before = _index(spark, path, epoch)
        own = [before[b][-1] for b in touched if b in before]
        rows = upsert(spark.read.parquet(*own).withColumn("_bucket", bucket), last, keys) if own else last
        if touched:
            rows.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v={epoch:012d}")
        for b in touched:
            for old in before.get(b, [])[: -KEPT or None]:
                _remove(spark, old)
        last.unpersist()

    return run


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest rows (of versions older than ``before``, which must still be there), or None."""
    paths = [versions[-1] for versions in _index(spark, path, before).values()]
    return spark.read.parquet(*paths) if paths else None


def _index(spark: SparkSession, path: str, before: int | None) -> dict[int, list[str]]:
    """The folders of each bucket, oldest first, of whole versions older than ``before``; versions without buckets are removed."""
    found: dict[int, list[str]] = {}
    for name in _names(spark, path):
        if name.startswith("v=") and (before is None or int(name[2:]) < before):
            inside = _names(spark, f"{path}/{name}")
            if "_SUCCESS" not in inside:
                continue
            own = [x for x in inside if x.startswith("_bucket=")]
            if not own:
                _remove(spark, f"{path}/{name}")
            for x in own:
                found.setdefault(int(x.partition("=")[2]), []).append(f"{path}/{name}/{x}")
    return found


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)
