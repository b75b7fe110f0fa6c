"""Structured Streaming twins: tumbling, sliding and session windows, and a stateful throttle by key.

Each takes a streaming DataFrame with an event time column ``ts`` and states
its watermark. In append and update mode the engine drops rows later than that
and frees their windows; complete mode keeps every window and drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(s: DataFrame, width: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return s.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"))


def sliding(s: DataFrame, width: str, step: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return s.withWatermark("ts", delay).groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"))


def sessions(s: DataFrame, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return s.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def throttle(s: DataFrame, key: str, least_ms: int, delay: str = "1 hour") -> DataFrame:
    """Passes a row if its key's last passed row is at least ``least_ms`` older; the state is that one time.

    Rows of a micro-batch are taken in order of time. Once the watermark is so
    far beyond a key's last row that any later one would pass, its state goes.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = f"{key} long, ms long"

    def keep(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for t in sorted(t for pdf in pdfs for t in pdf["ms"]):
            if last is None or t - last >= least_ms:
                out.append((k[0], t))
                last = t
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + least_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "ms"])

    rows = s.withWatermark("ts", delay).select(key, "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy(key).applyInPandasWithState(keep, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(df: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what there is and returns its result as written (in complete mode the last state).

    A micro-batch owns a folder by its number and replaces it, so one that runs
    again after a failure leaves no row twice.
    """
    spark, schema = df.sparkSession, df.schema
    out = f"{folder}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(schema).option("basePath", out).parquet(out).select(*schema.names)
