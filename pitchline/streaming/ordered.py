"""State by key that takes rows in their own order, whatever the order of files.

A row waits in the key's state until the watermark has passed its time; then
the rows up to there go through the state in order.  Arrival decides nothing:
any way of cutting and shuffling the files gives the rows of one ordered pass,
as long as no row is later than the watermark allows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pitchline.session import setting, shared_dir
from pitchline.streaming.ingest import files

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A waiting row in a packed part, and of how many rows a part is at most.
WAITING, PART_ROWS = np.dtype([("at", "<i8"), ("tie", "<i8"), ("value", "<f8")]), 1 << 15


class _InOrder(StatefulProcessor):
    """Waiting rows in a list, packed: a call of the state takes a batch of rows, not one; in a value the key's
    fold and its one timer, at the earliest waiting time."""

    def __init__(self, start: float, step: Callable[[float, int, float], float]):
        self.start, self.step = start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting_parts", "part binary")
        self.fold = handle.getValueState("fold", "n long, level double, due long")

    def _held(self) -> tuple[int, float, int | None]:
        return tuple(self.fold.get()) if self.fold.exists() else (0, self.start, None)

    @staticmethod
    def _parts(rows: np.ndarray) -> list[tuple[bytes]]:
        return [(rows[i : i + PART_ROWS].tobytes(),) for i in range(0, len(rows), PART_ROWS)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for b in rows:
            if len(b):
                new = np.empty(len(b), WAITING)
                new["tie"], new["value"], new["at"] = (b.iloc[:, i].to_numpy() for i in (2, 3, 4))  # by place: versions differ in what they call the columns
                self.waiting.appendList(self._parts(new))
                least = int(new["at"].min())
                first = least if first is None else min(first, least)
        n, level, due = self._held()
        if first is not None and (due is None or first < due):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            self.fold.update((n, level, first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        parts = [np.frombuffer(part, WAITING) for (part,) in self.waiting.get()]
        rows = np.concatenate(parts) if parts else np.empty(0, WAITING)
        rows = rows[np.lexsort((rows["tie"], rows["at"]))]  # stable: of equal ones the last to come is last
        if len(rows):
            rows = rows[np.append((rows["at"][1:] != rows["at"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1]), True)]
        ends = int(np.searchsorted(rows["at"], upto, side="right"))
        ready, later = rows[:ends], rows[ends:]
        n, level, _ = self._held()
        levels = [level]
        for i, value in enumerate(ready["value"].tolist()):
            levels.append(self.step(levels[-1], n + i, value))
        due = int(later["at"][0]) if len(later) else None
        if due is None:
            self.waiting.clear()
        else:
            self.waiting.put(self._parts(later))
            self.handle.registerTimer(due)
        self.fold.update((n + len(ready), levels[-1], due))
        if len(ready):
            yield pd.DataFrame({"_key": [key[0]] * len(ready), "_ms": ready["at"], "_tie": ready["tie"], "n": np.arange(n + 1, n + 1 + len(ready)), "before": levels[:-1], "after": levels[1:]})

    def close(self) -> None:
        pass


def ordered_fold(rows: DataFrame, key: str, time: str, tie: str, value: str, step: Callable[[float, int, float], float], start: float, late: str = "7 days") -> DataFrame:
    """A stream of ``key, time, tie, n, before, after``: ``step(level, rows before, value)`` over a key's rows by ``time``, then ``tie``.

    ``tie``, a whole number, tells a key's rows of one time apart; a row that
    comes again with the same three is one row as long as it waits.  Times
    count to the millisecond, so ``tie`` decides within one.  A row is given
    out when the watermark, ``late`` behind the newest time seen, has passed
    it; one older than the watermark when it comes is dropped by the stream.
    Rows without key, time, tie or value are left out.
    """
    kind = rows.schema[key].dataType.simpleString()
    known = rows.where(" and ".join(f"`{c}` is not null" for c in (key, time, tie, value)))
    # times without a zone are taken as UTC
    rows = known.select(F.col(key).alias("_key"), F.col(time).cast("timestamp").alias("_at"), F.col(tie).cast("long").alias("_tie"), F.col(value).cast("double").alias("_value"))
    rows = rows.withColumn("_ms", F.unix_millis("_at")).withWatermark("_at", late)
    schema = f"_key {kind}, _ms long, _tie long, n long, before double, after double"
    out = rows.groupBy("_key").transformWithStateInPandas(_InOrder(start, step), schema, "Append", "EventTime")
    return out.select(F.col("_key").alias(key), F.timestamp_millis("_ms").cast("timestamp_ntz").alias(time), F.col("_tie").alias(tie), "n", "before", "after")


def ordered_run(spark: SparkSession, path: str, key: str, time: str, tie: str, value: str, step: Callable[[float, int, float], float], start: float, only: str = "*.parquet", late: str = "7 days", home: str | None = None, per_batch: int = 1000) -> DataFrame:
    """What ``ordered_fold`` has given out so far of the files of ``path``, new ones included.

    Rows that still wait, and the levels of all keys, stay in the checkpoint
    below ``home`` for the next run.
    """
    home = home or f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.session.timeZone", "UTC"), setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        out = ordered_fold(files(spark, path, only=only, per_batch=per_batch), key, time, tie, value, step, start, late)
        out.writeStream.outputMode("append").format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{home}/out")
