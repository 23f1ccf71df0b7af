"""Streams of document events: debounce, change-only emission, sessions, idempotency, rate limits, barriers.

Each has a batch form over a table and, where state is needed, a Structured Streaming form that gives the same rows under availableNow.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators.history import changes
from folioflow.session import fields

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, schema, **options) -> DataFrame:
    """A stream of parquet files; the event time is cast, as watermarks need a timestamp with a zone."""
    s = spark.readStream.schema(schema).options(**options).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """One row a burst: events of a key less than gap apart; emitted once it is quiet. Works on batches and on streams with a watermark."""
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).select(key, "n", "last", F.col("w.start").alias("first"))


def changed(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Events whose state differs from the one before it of their key."""
    return changes(events, [key], order, state)


def changed_stream(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """changed as a stream: the last state of every key is kept in the state store. Events of one batch are taken in their order."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Last(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "v string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            got = pd.concat(list(rows)).sort_values(order, kind="stable")
            known, keep = (self.last.get()[0] if self.last.exists() else None), []
            for v in got[state]:
                keep.append(v != known)
                known = v
            self.last.update((known,))
            yield got[keep]

        def close(self) -> None:
            pass

    return events.groupBy(key).transformWithStateInPandas(Last(), outputStructType=events.schema, outputMode="Append", timeMode="None")


def folded(events: DataFrame, keys: list[str], order: list[str], start: Callable, column: str, value: str | None = None) -> DataFrame:
    """events with a boolean column: start() gives a key's fold, a function of value (the first order column if none is named), called for each event in order.

    Events come sorted and stream through the fold, so a task holds one batch and the state of one key, however many events a key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            out = []
            for *key, at in zip(*own, batch.column(batch.schema.get_field_index(value or order[0])).to_pylist(), strict=True):
                if step is None or key != last:
                    last, step = key, start()
                out.append(step(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, column])

    dealt = events.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, f"{fields(events)}, {column} boolean")


def rate_limited(events: DataFrame, key: str, at: str, order: str, most: int, seconds: int) -> DataFrame:
    """Events with allowed: at most so many allowed ones in the seconds before, rejected ones don't count. A fold over each key's events."""

    def start() -> Callable:
        window: deque = deque(maxlen=most) if most else deque()

        def step(t: int) -> bool:
            fine = most > 0 and (len(window) < most or window[0] <= t - seconds * 1_000_000)
            if fine:
                window.append(t)  # the oldest of most allowed ones leaves
            return fine

        return step

    return folded(events, [key], [at, order], start, "allowed")


def first_in_ttl(events: DataFrame, keys: list[str], at: str, order: str, micros: int) -> DataFrame:
    """keys and order of new events: an event is new when no new event of its keys lies less than micros before it."""

    def start() -> Callable:
        last: list = []

        def step(t: int) -> bool:
            fine = not last or t - last[0] >= micros
            if fine:
                last[:] = [t]
            return fine

        return step

    return folded(events, keys, [at, order], start, "fresh").where("fresh").select(*keys, order)


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """The rows of each key that are taken in order while their sizes fit the budget; one that does not fit is passed over, the next one may."""

    def start() -> Callable:
        left = [budget]

        def step(n: int | None) -> bool:
            fine = n is not None and 0 < left[0] >= n
            if fine:
                left[0] -= n
            return fine

        return step

    return folded(rows, keys, order, start, "_fits", size).where("_fits").drop("_fits")


def polled(queue: DataFrame, by: str, order: list, worker: str | None = None) -> DataFrame:
    """What a worker's poll takes of each queue (by): the first queued job by order, one a poll."""
    first = Window.partitionBy(by).orderBy(*order)
    taken = queue.where("status = 'queued'").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return taken.withColumn("status", F.lit("running")) if worker is None else taken.withColumn("status", F.lit("running")).withColumn("worker", F.lit(worker))


def poll_stream(queue: DataFrame, sink: Callable, checkpoint: str, every: str | None = None, by: str = "pool"):
    """The poll loop as a stream: each trigger hands the queued jobs that came since the last one to sink, with place: their turn in their queue (by).

    The most urgent come first, then the older ones; places are told for each queue, so no trigger's jobs are sorted as a whole. Without every it takes
    what is there and ends; with it, it polls at that pace until it is stopped.
    """
    turn = Window.partitionBy(by).orderBy("priority", "created_at", "job_id")
    work = lambda df, n: sink(df.where("status = 'queued'").withColumn("place", F.row_number().over(turn)), n)
    writer = queue.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def pushed(snapshots: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Polls of a snapshot whose serialised payload differs from the last one of their key: what a watcher is sent."""
    said = snapshots.withColumn("_said", F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    return changes(said, [key], order, "_said").withColumn("payload", F.col("_said")).drop("_said")


def sessions(events: DataFrame, key: str, at: str, kind: str, now, idle: int) -> DataFrame:
    """State of each session: dirty when something came after the last flush, abandoned after idle micros, else clean."""
    got = events.groupBy(key).agg(F.max(F.when(F.col(kind) == "flush", F.col(at))).alias("flushed"), F.max(F.when(F.col(kind) != "flush", F.col(at))).alias("touched"), F.count_if(F.col(kind) != "flush").alias("deltas"))
    state = F.when(F.greatest("flushed", "touched") < now - idle, "abandoned").when(F.col("touched") > F.coalesce("flushed", F.lit(-1)), "dirty").otherwise("clean")
    return got.withColumn("state", state)


def barrier(events: DataFrame, key: str, at: str, order: str, is_write, is_check, ttl: int) -> DataFrame:
    """Each write with whether a check lies at most ttl micros before it: an as-of lookup by a running last, no join."""
    w = Window.partitionBy(key).orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_check, F.col(at)), ignorenulls=True).over(w)
    return events.withColumn("checked_at", last).where(is_write).withColumn("open", F.coalesce(F.col(at) - F.col("checked_at") <= ttl, F.lit(False)))
