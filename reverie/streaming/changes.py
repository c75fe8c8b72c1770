"""The change feed as a stream: sources, subscriptions, deduplication, windows and budget alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.operators.histories import subscribed

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The events below ``path`` as a stream of changes: table, key, row_id, kind, at, value.

    ``path`` names a folder of Parquet files or one file.
    """
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and "*" not in name else reader.parquet(path)
    return changes(raw)


def changes(events: DataFrame) -> DataFrame:
    """Events seen as changes of per-type tables; works on streams and tables."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "update").otherwise("insert")
    return events.select(F.col("event_type").alias("table"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("row_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"), "value")


def once(stream: DataFrame, delay: str, *keys: str) -> DataFrame:
    """Each key once while the watermark remembers it."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(list(keys))


def windowed(stream: DataFrame, length: str, delay: str = "1 day") -> DataFrame:
    """Counts and sums of each table's changes in tumbling windows; late rows count while the watermark allows."""
    return stream.withWatermark("at", delay).groupBy(F.window("at", length).alias("w"), "table").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "table", "n", "total")


def session_windows(stream: DataFrame, gap: str, delay: str = "1 day") -> DataFrame:
    """Sessions of each key, closed by a gap."""
    return stream.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), "key").agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("opened"), "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation over what there is now and returns its last complete state, written to Parquet files.

    Each batch replaces a folder of its own, so that a batch that is run again changes nothing.
    """
    spark, last = stream.sparkSession, []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:09d}")
        last.append(number)

    query = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{max(last):09d}") if last else spark.createDataFrame([], stream.schema)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends what there is now to Parquet files, exactly once, and returns them."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def alert_transitions(stream: DataFrame, amount: float, warn: float) -> DataFrame:
    """``key, status, at``: whenever a key's running spend reaches a new status (ok, warning, exceeded).

    State is two numbers a key; rows of a batch are taken in the order of time.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        spent, status = state.get if state.exists else (0.0, "ok")
        out = []
        rows = pd.concat([f for f in frames if len(f)]).sort_values("at", kind="stable")
        for at, value in zip(rows["at"], rows["value"], strict=True):
            spent += value
            now = "exceeded" if spent >= amount else "warning" if spent >= amount * warn else "ok"
            if now != status:
                out.append((key[0], now, at))
                status = now
        state.update((spent, status))
        yield pd.DataFrame(out, columns=["key", "status", "at"])

    return stream.select("key", "at", "value").groupBy("key").applyInPandasWithState(step, "key string, status string, at timestamp", "spent double, status string", "append", GroupStateTimeout.NoTimeout)


__all__ = ["alert_transitions", "changes", "event_stream", "once", "run_to_end", "run_to_files", "session_windows", "subscribed", "windowed"]
