"""The event aggregates as streams, and their batch runs to the end of what is there.

Each ``*_of`` function takes a streaming or a batch DataFrame of events (event_id, ts, user_id, event_type, value) and
declares one plan for both. ``run_available`` drives a stream over the files that are there, for tests and catch-up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.session import shared_dir

LATE = "2 hours"


def read_events(s: SparkSession, path: str) -> DataFrame:
    """The events as a stream of Parquet files, times as timestamps."""
    schema = s.read.parquet(path).schema
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        folder, name = path, "*.parquet"
    else:
        folder, name = path.rstrip("/").rsplit("/", 1)
    return s.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


CLOSE = "__close__"


def read_closed(s: SparkSession, path: str) -> DataFrame:
    """The events, and one row far behind the last of them that moves the watermark past every open window: what a stream that goes on would
    do in time. Its own window stays open, so an aggregate in append mode never shows it."""
    e = read_events(s, path)
    last = s.read.parquet(path).agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    folder = f"{shared_dir(s)}/close-{uuid.uuid4().hex}"
    end = s.range(1).select(*[((F.lit(last) if last else F.current_timestamp()) + F.expr("interval 400 days")).cast("timestamp").alias("ts") if f.name == "ts" else F.lit(CLOSE).alias("event_type") if f.name == "event_type" else F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema.fields])
    end.write.parquet(folder)
    return e.union(s.readStream.schema(e.schema).parquet(folder).select(*e.columns))


def tumbling_of(e: DataFrame) -> DataFrame:
    w = F.window("ts", "1 hour")
    return e.withWatermark("ts", LATE).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_failures_of(e: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """Failure share in windows of 6 hours every hour; degraded from ``least`` failures and ``share`` on."""
    g = e.withWatermark("ts", LATE).groupBy(F.window("ts", "6 hours", "1 hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return g.select(F.col("window.start").alias("start"), "n", "failures", ((F.col("failures") >= least) & (F.col("failures") >= share * F.col("n"))).alias("degraded"))


def sessions_of(e: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = e.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated_of(e: DataFrame) -> DataFrame:
    """One row an event id among those within the watermark of each other."""
    e = e.withWatermark("ts", LATE)
    return (e.dropDuplicatesWithinWatermark(["event_id"]) if e.isStreaming else e.dropDuplicates(["event_id"])).select("event_id", "user_id", "event_type", "ts")


def enriched_of(e: DataFrame, static: DataFrame) -> DataFrame:
    """Events with the attributes of a static table, by user."""
    return e.join(static, "user_id", "left").select("event_id", "event_type", "segment")


def run_available(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is available, in append mode, into a Parquet table in the shared folder and returns that table. Windows
    are written once, when the watermark has passed them, and their state is dropped; rows later than that are refused."""
    s = stream.sparkSession
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{base}/out")


def replay_limiter(e: DataFrame, limit: int = 5, seconds: int = 3600) -> DataFrame:
    """(event_id, admitted): at most ``limit`` admitted events a user in any ]t - seconds, t]; refused ones do not count.

    The state of a user is the times of its last ``limit`` admissions, so a user's events stream through it in order: rows are
    partitioned by user and sorted by time, and no group is ever held as a whole.
    """
    import pyarrow as pa

    def run(batches):
        user, kept = None, []
        for b in batches:
            out = []
            for i, u, t in zip(*(c.to_pylist() for c in b.columns)):
                if u != user:
                    user, kept = u, []
                kept = [x for x in kept if x > t - seconds * 1_000_000]
                ok = len(kept) < limit
                if ok:
                    kept.append(t)
                out.append((i, ok))
            if out:
                x = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1])], names=["event_id", "admitted"])

    rows = e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").select("event_id", "user_id", "t").mapInArrow(run, "event_id bigint, admitted boolean")
