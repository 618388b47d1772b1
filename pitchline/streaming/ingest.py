"""Incremental loads and windows as file streams.

Each run takes the files that the checkpoint has not seen and ends
(``availableNow``); the same query left running is a live feed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitchline.session import setting, shared_dir


def files(spark: SparkSession, path: str, schema=None, only: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    """The Parquet files of the folder ``path`` whose names match ``only``, as a stream."""
    schema = schema or spark.read.option("pathGlobFilter", only).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", only).option("maxFilesPerTrigger", per_batch).parquet(path)


def load_new(spark: SparkSession, path: str, keys: list[str], out: str, checkpoint: str, schema=None) -> None:
    """Append the rows of files not loaded yet to ``out``, each key once over all runs.

    A batch is held against what ``out`` has, so that no state grows with the
    keys ever seen; it lands under its own number, which a repeated batch
    overwrites.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        try:
            known = spark.read.parquet(out).where(F.col("batch") != number).select(*keys)
        except AnalysisException:  # nothing was loaded yet
            known = None
        rows = rows if known is None else rows.join(known, keys, "left_anti")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files(spark, path, schema).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def session_totals(spark: SparkSession, path: str, time: str, key: str, value: str, gap: str, only: str = "*.parquet", late: str = "7 days", home: str | None = None) -> DataFrame:
    """``key, start, end, n, total`` of sessions: rows of a key less than ``gap`` apart.

    A session is given out once the watermark has passed its end; what is still
    open at the end of a run stays in the checkpoint's state for the next one.
    """
    home = home or f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.session.timeZone", "UTC"):
        rows = files(spark, path, only=only).select(F.col(time).cast("timestamp").alias("_t"), key, value).withWatermark("_t", late)
        totals = rows.groupBy(F.session_window("_t", gap).alias("_w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        out = totals.select(key, F.col("_w.start").cast("timestamp_ntz").alias("start"), F.col("_w.end").cast("timestamp_ntz").alias("end"), "n", "total")
        out.writeStream.outputMode("append").format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{home}/out")


def window_totals(spark: SparkSession, path: str, time: str, key: str, value: str, width: str, only: str = "*.parquet", late: str = "7 days", home: str | None = None) -> DataFrame:
    """``key, start, n, total`` in tumbling windows, late rows included up to ``late``.

    Every batch writes the windows it changed under its own number, which a
    repeated batch overwrites; a window's last version counts.
    """
    home = home or f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.session.timeZone", "UTC"):  # watermarks need instants: times without a zone are taken as UTC
        rows = files(spark, path, only=only).select(F.col(time).cast("timestamp").alias("_t"), key, value).withWatermark("_t", late)
        totals = rows.groupBy(F.window("_t", width).alias("_w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))

        def save(batch: DataFrame, number: int) -> None:
            out = batch.select(key, F.col("_w.start").cast("timestamp_ntz").alias("start"), "n", "total")
            out.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

        totals.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    saved = spark.read.parquet(f"{home}/out")
    return saved.groupBy(key, "start").agg(F.max_by(F.struct("n", "total"), "batch").alias("_r")).select(key, "start", "_r.*")


def running_ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float, start: float) -> DataFrame:
    """``key, n, ema`` after each batch of a stream: the average goes on from the key's state.

    Rows are put in order within a batch; batches are taken as they come.
    """
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, start)
        for x in pd.concat(list(parts)).sort_values(order)[value]:
            n, ema = n + 1, (1 - alpha) * ema + alpha * float(x)
        state.update((n, ema))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [ema]})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)
