"""Structured Streaming over the event table: windows, sessions, deduplication, velocity and rate limits, drift by window.
A replay reads what is there (availableNow) and gives a batch frame of what the stream emitted."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

N = "*"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder shared by driver and executors; our own only where none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The event table as a stream of its files; ts with zone, as watermarks need it."""
    path = f"{folder}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        reader, path = reader.option("pathGlobFilter", "events.parquet"), folder  # a stream's source is a folder
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def replay(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs the stream to its end. append: all rows; complete: the rows of the last epoch; update: of each key the row
    of the last epoch. Every epoch is written under its number, so one that is run again replaces itself."""
    spark = stream.sparkSession
    out, state = shared_path(spark, "stream"), shared_path(spark, "state")
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        found = spark.read.option("basePath", out).schema(T.StructType([*schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(f"{out}/epoch=*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = found.agg(F.max("epoch").alias("last"))
        return found.crossJoin(F.broadcast(last)).filter("epoch = last").drop("epoch", "last")
    if mode == "update" and keys:
        rest = [c for c in stream.columns if c not in keys]
        latest = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("s"))
        return latest.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
    return found.drop("epoch")


def tumbling(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(N).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, size: str = "24 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count(N).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(N).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _until(state: GroupState, last: int, span: int) -> None:
    """The state goes when the watermark passes the end of its window (at least a millisecond ahead of it)."""
    state.setTimeoutTimestamp(max((int(last) + span) // 1000, state.getCurrentWatermarkMs()) + 1)


def velocity(stream: DataFrame, minutes: int = 600, limit: int = 2, late: str = "1 day") -> DataFrame:
    """Rows with more than ``limit`` of the user's events in the ``minutes`` before, both ends included; a user's state is
    the times inside the window, and ends with it: a timer drops it when the watermark has passed. Within a batch rows go by
    time; what is older than the state holds counts by what it finds, what is older than ``late`` is left out."""
    span = minutes * 60_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        us, ids, counts = rows["us"].tolist(), rows["event_id"].tolist(), []
        every = sorted([*times, *us])
        from bisect import bisect_left, bisect_right

        for t in us:
            counts.append(bisect_right(every, t) - bisect_left(every, t - span))
        last = every[-1]
        state.update((every[bisect_left(every, last - span) :],))
        _until(state, last, span)
        out = pd.DataFrame({"event_id": ids, "user_id": key[0], "n": counts})
        yield out[out["n"] > limit]

    keyed = stream.withWatermark("ts", late).select("event_id", "user_id", "ts", F.unix_micros("ts").alias("us"))
    kept = "event_id bigint, user_id bigint, n bigint", "times array<bigint>"
    return keyed.groupBy("user_id").applyInPandasWithState(step, *kept, "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(stream: DataFrame, most: int = 5, seconds: int = 300, late: str = "1 day") -> DataFrame:
    """At most ``most`` rows a user in any ``seconds``: the others are left out. State: the times let through, until the
    watermark has passed the last one's span; rows older than ``late`` are left out."""
    span = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        keep = []
        for t in rows["us"].tolist():
            sent = [s for s in sent if s > t - span]
            keep.append(len(sent) < most)
            if keep[-1]:
                sent.append(t)
        state.update((sent,))
        _until(state, rows["us"].max(), span)
        yield rows[keep][["event_id"]].assign(user_id=key[0])

    keyed = stream.withWatermark("ts", late).select("event_id", "user_id", "ts", F.unix_micros("ts").alias("us"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint", "sent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def drift_by_batch(stream: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """PSI of every micro-batch against a fixed reference: batch, n (rows), psi."""
    from larkspur.operators.stats import psi_equal_width

    spark = reference.sparkSession
    out, state = shared_path(spark, "drift"), shared_path(spark, "state")

    def write(batch: DataFrame, epoch: int) -> None:
        made = psi_equal_width(reference, batch, column).crossJoin(F.broadcast(batch.agg(F.count(N).alias("n"))))
        made.select(F.lit(epoch).cast("bigint").alias("batch"), "n", "psi").write.mode("overwrite").parquet(f"{out}/epoch-{epoch}")

    stream.writeStream.option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/epoch-*")
