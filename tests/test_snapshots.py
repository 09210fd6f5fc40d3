"""Stores with identity: whole snapshots, another model is an error, and drift reads what differs."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import quality, snapshots

ME = snapshots.Identity("bag-64", 2)


def rows(spark, n=3000):
    return spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("value"), F.array(F.col("id") / 7, F.lit(1.0)).cast("array<float>").alias("embedding")).repartition(4)


def test_snapshot_and_identity(spark, tmp_path):
    path, own = f"file://{tmp_path}/store", rows(spark)
    with pytest.raises(FileNotFoundError):
        snapshots.opened(spark, path, ME)
    told = snapshots.write(own, path, ME)
    assert told["rows"] == 3000 and told == {**snapshots.manifest(spark, path), "columns": told["columns"]} and len(told["files"]) >= 256
    back = snapshots.opened(spark, path, ME)
    assert back.dtypes == own.dtypes and back.exceptAll(own).count() == 0 and back.count() == 3000
    for other in (snapshots.Identity("other", 2), snapshots.Identity("bag-64", 3), snapshots.Identity("bag-64", 2, "dot")):
        with pytest.raises(snapshots.StoreMismatch):
            snapshots.opened(spark, path, other)
    assert snapshots.write(own.repartition(7), f"{path}2", ME)["fingerprint"] == told["fingerprint"]
    assert snapshots.write(own.where("chunk_id <> 'c5'"), f"{path}3", ME)["fingerprint"] != told["fingerprint"]


def test_a_killed_rebuild_leaves_the_old_snapshot(spark, tmp_path):
    path, own = f"file://{tmp_path}/store", rows(spark, 100)
    first = snapshots.write(own, path, ME)
    broken = own.withColumn("text", F.when(F.col("chunk_id") == "c50", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        snapshots.write(broken, path, ME)
    assert snapshots.manifest(spark, path)["snapshot"] == first["snapshot"] and snapshots.opened(spark, path, ME).count() == 100
    gone = snapshots.replaced(own.where("chunk_id not in ('c1', 'c2')"), path, ME)
    assert sorted(r[0] for r in gone.collect()) == ["c1", "c2"] and snapshots.opened(spark, path, ME).count() == 98
    assert snapshots.replaced(own, f"{path}-new", ME).count() == 0


def test_drift_reads_what_differs(spark, tmp_path):
    path, own = f"file://{tmp_path}/store", rows(spark)
    snapshots.write(own, path, ME)
    fresh = own.where("chunk_id <> 'c7'").withColumn("value", F.when(F.col("chunk_id") == "c9", "other").otherwise(F.col("value"))).withColumn("embedding", F.when(F.col("chunk_id") == "c11", F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")).otherwise(F.col("embedding")))
    fresh = fresh.unionAll(own.limit(1).withColumn("chunk_id", F.lit("new"))).checkpoint()
    want = sorted(map(tuple, quality.drift(own, fresh, "chunk_id", ["text", "value", "embedding"]).collect()))
    out = snapshots.drift(spark, path, fresh)
    assert sorted(map(tuple, out.collect())) == want == [("c11", "changed embedding"), ("c7", "missing"), ("c9", "changed value"), ("new", "added")]
    read = {f.split("_range=")[1][:2] for f in out.inputFiles() if "_range=" in f}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_range" in plan.replace("isnotnull(_range", "_range") or len(read) <= 4
    assert snapshots.drift(spark, path, own).count() == 0
    every = own.withColumn("text", F.lit("x"))
    assert snapshots.drift(spark, path, every).count() == 3000


def test_trees_differ_where_rows_do(spark):
    own = rows(spark, 500).checkpoint()
    a = snapshots.tree(own, "chunk_id", own.columns).checkpoint()
    assert {r["level"]: r["n"] for r in a.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {0: 500, 1: 500, 2: 500}
    for change in (own.where("chunk_id <> 'c3'"), own.unionAll(own.where("chunk_id = 'c3'")), own.withColumn("value", F.when(F.col("chunk_id") == "c3", "").otherwise(F.col("value")))):
        found = snapshots.differing(a, snapshots.tree(change, "chunk_id", own.columns)).collect()
        assert [r[0] for r in found] == [own.where("chunk_id = 'c3'").select(snapshots.range_of(F.col("chunk_id"))).first()[0]]
    empty = snapshots.tree(own.where("false"), "chunk_id", own.columns)
    assert snapshots.differing(empty, empty).count() == 0 and snapshots.differing(a, empty).count() == a.where("level = 2").count()
