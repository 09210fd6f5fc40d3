"""The conversation window as a stream with state, and its replay over a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.operators.history import usable
from factloom.session import shared_folder

TURNS = 10


def with_history(turns: DataFrame, keep: int = TURNS) -> DataFrame:
    """Streaming user turns (conv_id, turn, question) with the usable questions before them.

    State is the last ``keep`` questions of a conversation. Redacted ones take a place
    in it, as in the batch window, but are not shown. Turns of a batch are taken in
    turn order.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        import pandas as pd

        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, question in zip(rows["turn"], rows["question"], strict=True):
            question = question or ""
            shown = [q for q in held if q and not q.startswith("[redacted")]
            out.append((key[0], turn, question, "\n".join(shown), len(shown)))
            held = [*held, question][-keep:]
        state.update((held,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "question", "before", "n_before"])

    grouped = turns.select("conv_id", "turn", "question").groupBy("conv_id")
    return grouped.applyInPandasWithState(step, "conv_id long, turn long, question string, before string, n_before long", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """All user turns of a Parquet table through the stream; the sink is a table in the shared folder."""
    out = shared_folder(spark, "stream")
    schema = spark.read.parquet(path).schema
    turns = spark.readStream.schema(schema).parquet(f"{path}*").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    stream = with_history(turns).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema("conv_id long, turn long, question string, before string, n_before long").parquet(f"{out}/rows")


class Hints(StatefulProcessor):
    """Keeps a conversation's last turns with the entity each names, and gives each turn that of the turns before it."""

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "turn long, scheme_ids array<string>")

    def handleInputRows(self, key, rows, timerValues):
        held = {r[0]: r[1] for r in self.held.get()}
        taken = sorted(rows, key=lambda r: r["turn"])
        for r in taken:
            if r["turn"] in held:
                continue  # a repeated turn was answered
            before = sorted(t for t in held if t < r["turn"])[-self.keep :]
            hint = next((held[t] for t in reversed(before) if held[t] is not None), None)
            held[r["turn"]] = r["scheme_ids"]
            yield Row(conv_id=key[0], turn=r["turn"], hint=hint)
        # a turn that comes late still finds what stood before it, and a repeated one its own place
        self.held.put([(t, held[t]) for t in sorted(held)[-2 * self.keep :]])
        if self.idle_ms is not None and taken:
            due = max([*self.handle.listTimers(), *(int(r["_at"].timestamp() * 1000) + self.idle_ms for r in taken)])
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_hints(turns: DataFrame, keep: int = TURNS, at: str | None = None, idle_ms: int = 3_600_000) -> DataFrame:
    """(conv_id, turn, hint) of streaming user turns (conv_id, turn, question, scheme_ids): the entities carried forward.

    ``scheme_ids`` is null or empty where the turn names no entity or is ambiguous; empty, redacted and null
    questions carry nothing but take a place among the last ``keep`` turns, as in the
    batch form. A turn is answered once: one that the state still has is passed over
    when it comes again (the state has the last 2 * keep turns). One that comes late
    sees the turns before it; answers already given stay. With ``at``, a column with a
    watermark, a conversation without turns for ``idle_ms`` of event time is forgotten,
    and Spark drops turns behind the watermark. Needs the state store of RocksDB.
    """
    told = turns.select("conv_id", "turn", F.when(usable(F.col("question")) & (F.size("scheme_ids") > 0), F.col("scheme_ids")).alias("scheme_ids"), *([F.col(at).alias("_at")] if at else []))
    processor = Hints(keep, idle_ms if at else None)
    return told.groupBy("conv_id").transformWithState(statefulProcessor=processor, outputStructType="conv_id long, turn long, hint array<string>", outputMode="Append", timeMode="EventTime" if at else "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hints_replayed(spark: SparkSession, path: str, asked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A Parquet table of turns through the stream of hints; ``asked`` makes of it the columns that ``with_hints`` reads."""
    out, key = shared_folder(spark, "hints"), "spark.sql.streaming.stateStore.providerClass"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        stream = with_hints(asked(rows)).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema("conv_id long, turn long, hint array<string>").parquet(f"{out}/rows")
