"""Streams against their batch forms."""

from pyspark.sql import functions as F

from factloom.operators import history
from factloom.streaming import upsert
from factloom.streaming.history import ROCKSDB, replayed, with_hints


def test_history_stream_equals_batch(spark, sf):
    got = {(r["conv_id"], r["turn"]): r["before"] for r in replayed(spark, f"{sf}/conversations.parquet").collect()}
    rows = history.exchanges(spark.read.parquet(f"{sf}/conversations.parquet"))
    batch = history.history(rows).select("conv_id", "turn", F.array_join(F.transform("history", lambda t: t["question"]), "\n").alias("before"))
    assert got == {(r["conv_id"], r["turn"]): r["before"] for r in batch.collect()} and got


def test_hints_of_late_and_repeated_turns(spark, tmp_path):
    """Three runs over one state: new turns, the same again with one that comes late, and one after the conversation was forgotten."""
    schema = "conv_id long, turn long, question string, scheme_ids array<string>, at timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def run(n, rows):
        """Rows (conversation, turn, question, entities, minute) as one batch; what is answered then."""
        made = spark.createDataFrame([(*r[:4], r[4] * 60) for r in rows], "conv_id long, turn long, question string, scheme_ids array<string>, s long")
        made.withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = with_hints(spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("at", "10 minutes"), keep=3, at="at", idle_ms=30 * 60_000)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = {(r["conv_id"], r["turn"]): r["hint"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert len(got) == spark.read.parquet(f"{tmp_path}/out").count()  # a turn is answered once
        new = {k: v for k, v in got.items() if k not in seen}
        seen.update(new)
        return new

    seen: dict = {}
    first = [(1, 1, "q", ["a"], 100), (1, 2, "q", None, 101), (1, 5, "q", ["c"], 105), (2, 1, "[redacted]", ["z"], 100), (2, 2, "q", ["b"], 101), (2, 3, None, ["y"], 102), (2, 4, "", ["x"], 103), (3, 1, "q", ["k"], 100)]
    assert run(1, first) == {(1, 1): None, (1, 2): ["a"], (1, 5): ["a"], (2, 1): None, (2, 2): None, (2, 3): ["b"], (2, 4): ["b"], (3, 1): None}
    again = [*first, (1, 4, "q", ["b"], 104), (1, 6, "q", None, 106), (2, 5, "q", None, 104), (2, 6, "q", None, 105)]
    assert run(2, again) == {(1, 4): ["a"], (1, 6): ["c"], (2, 5): ["b"], (2, 6): None}  # three turns back, and no further
    assert run(3, [(1, 7, "q", None, 107), (9, 1, "q", ["n"], 400)]) == {(1, 7): ["c"], (9, 1): None}
    assert run(4, [(9, 2, "q", None, 401)]) == {(9, 2): ["n"]}  # the watermark is now past what conversations 1 to 3 had
    assert run(5, [(1, 8, "q", ["d"], 402), (9, 3, "q", None, 402)]) == {(1, 8): None, (9, 3): ["n"]}


def test_upserting_stream(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    apply = upsert.upserting(path, ["k"], "at")
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    two = spark.createDataFrame([(2, "d", 5), (3, "e", 1)], "k int, v string, at int")
    apply(one, 0)
    apply(two, 1)
    apply(two, 1)
    assert sorted((r["k"], r["v"]) for r in upsert.latest(spark, path).collect()) == [(1, "b"), (2, "d"), (3, "e")]
    assert sorted((r["k"], r["v"]) for r in upsert.latest(spark, path, before=1).collect()) == [(1, "b"), (2, "c")]
    assert upsert.latest(spark, f"file://{tmp_path}/none") is None
    for epoch in range(2, 6):
        apply(spark.createDataFrame([(3, f"e{epoch}", epoch)], "k int, v string, at int"), epoch)
    assert sorted((r["k"], r["v"]) for r in upsert.latest(spark, path).collect()) == [(1, "b"), (2, "d"), (3, "e5")]
    kept = [(v.name, b.name) for v in sorted((tmp_path / "table").iterdir()) for b in v.glob("_bucket=*")]
    of = {b: [v for v, x in kept if x == b] for _, b in kept}
    assert len(of) == 3 and max(map(len, of.values())) <= 2  # old versions of a bucket go; batches of key 3 left the other buckets alone
    apply(one.where("k < 0"), 9)
    assert sorted((r["k"], r["v"]) for r in upsert.latest(spark, path).collect()) == [(1, "b"), (2, "d"), (3, "e5")]
