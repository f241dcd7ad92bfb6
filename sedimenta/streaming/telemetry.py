"""Streams of telemetry (an extension: batch is what the data model asks for): windows with watermarks, sessions, duplicates, state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedimenta.operators.telemetry import OTLP_SCHEMA, observations


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of OTLP documents as they arrive in a folder, with an event time."""
    raw = spark.readStream.schema(OTLP_SCHEMA).option("multiLine", "true").json(folder)
    return observations(raw).withColumn("at", F.timestamp_micros(F.expr("timestamp_ns div 1000")))


def once(obs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Without spans that come again within the watermark."""
    return obs.withWatermark("at", late).dropDuplicatesWithinWatermark(["trace_id", "span_id", "kind"])


def windowed(events: DataFrame, at: str = "at", width: str = "1 minute", late: str = "10 minutes", keys: tuple[str, ...] = ("source_service", "kind"), value: str = "latency_ms") -> DataFrame:
    """Counts and means by tumbling windows; events later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("events"), F.avg(value).alias("mean")).select(F.col("window.start").alias("window_start"), *keys, "events", "mean")


def sessions(events: DataFrame, at: str = "at", gap: str = "5 minutes", late: str = "10 minutes", key: str = "trace_id") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def last_snapshots(snaps: DataFrame) -> DataFrame:
    """Change of size of each feature against its snapshot before, kept as state: snaps(feature_id, commit_id, nodes)."""

    def step(key, parts, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("commit_id")
        out = []
        for r in rows.itertuples():
            kind = "BORN" if last is None else "GROWN" if r.nodes >= 1.3 * max(last, 1) else "SHRUNK" if r.nodes <= 0.7 * max(last, 1) else None
            if kind:
                out.append((key[0], int(r.commit_id), kind))
            last = int(r.nodes)
        state.update((last,))
        yield pd.DataFrame(out, columns=["feature_id", "commit_id", "event_type"])

    return snaps.groupBy("feature_id").applyInPandasWithState(step, "feature_id bigint, commit_id bigint, event_type string", "nodes bigint", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """What is there now, into a table in memory."""
    stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
