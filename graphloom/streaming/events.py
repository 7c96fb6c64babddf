"""Streams: file watching, debouncing, windows over events, and graphs kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.graph import durable

from .state import BUCKETS, KeyedState


def with_time(events: DataFrame) -> DataFrame:
    """Events whose ts has no zone, read as UTC, since watermarks need an instant."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) for each window; works on streams and tables alike."""
    e = with_time(events).withWatermark("ts", late)
    out = e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding(events: DataFrame, length: str = "1 day", slide: str = "12 hours", late: str = "1 day") -> DataFrame:
    e = with_time(events).withWatermark("ts", late)
    out = e.groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users_approx"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "users_approx")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """(user_id, start, n): bursts of a user's events with less than ``gap`` between them."""
    e = with_time(events).withWatermark("ts", late)
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


#: Changed files up to which they are opened by name; beyond, by the time of the first change.
BY_NAME = 10_000


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, modified) of the files under a folder; none is opened."""
    return _binary(spark, glob).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


def _binary(spark: SparkSession, glob: str):
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)


def hashed(spark: SparkSession, folder: str, files: DataFrame, glob: str = "*") -> DataFrame:
    """``files`` (path, length, modified, ...) with a hash of their contents. Only they are opened, or,
    where there are very many, files as new as the oldest of them."""
    some = files.select("path", "modified").limit(BY_NAME + 1).collect()
    if not some:
        return files.withColumn("content_hash", F.lit(None).cast("string"))
    if len(some) <= BY_NAME:
        opened = spark.read.format("binaryFile").load([r["path"] for r in some])
    else:
        since = files.agg(F.min("modified")).head()[0]
        opened = _binary(spark, glob).load(folder).where(F.col("modificationTime") >= F.lit(since))
    return files.join(opened.select("path", F.sha2("content", 256).alias("content_hash")), "path")


def changed_files(before: DataFrame | None, now: DataFrame, hashes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, change, length, modified, content_hash): files that came, were rewritten or went between two
    listings, and those that were touched only. ``before`` has hashes; ``hashes`` finds them for files
    that are new, or have another length or time."""
    if before is None:
        return hashes(now).select("path", F.lit("added").alias("change"), "length", "modified", "content_hash")
    old = before.select("path", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), F.col("content_hash").alias("old_hash"))
    other = F.col("old_length").isNull() | (F.col("length") != F.col("old_length")) | (F.col("modified") != F.col("old_modified"))
    differ = hashes(now.join(old, "path", "left").where(other))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") != F.col("content_hash"), "modified").otherwise("touched")
    came = differ.select("path", change.alias("change"), "length", "modified", "content_hash")
    gone = old.join(now, "path", "left_anti").select("path", F.lit("removed").alias("change"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("content_hash"))
    return came.unionByName(gone)


def watch_files(spark: SparkSession, folder: str, state_path: str, update: Callable[[DataFrame, int, str], None], glob: str = "*", checkpoint: str | None = None, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Calls ``update(changes, number, depth)`` with the files of a folder that came, were rewritten or
    went (path, change, modified, content_hash), trigger by trigger. Spark's own file source knows a file by its
    path and never reports that it was rewritten or removed, so each trigger compares a listing with the
    one before, which is kept in a :class:`KeyedState` that takes in what changed. Files are opened only if
    their length or time differs; a file that was only touched has not changed. A trigger that is repeated
    after a failure compares the same two."""
    state = KeyedState(spark, state_path, ["path"], "modified", removed="gone")

    def run(_: DataFrame, number: int) -> None:
        found = changed_files(state.read(number), listing(spark, folder, glob), lambda files: hashed(spark, folder, files, glob))
        found = durable(found)
        if found.isEmpty():
            return
        state.write(found.select("path", "length", "modified", "content_hash", (F.col("change") == "removed").alias("gone")), number)
        changes = found.where("change <> 'touched'").drop("length")
        if not changes.isEmpty():
            update(changes, number, depth_of(changes))

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint or f"{state_path}/_checkpoint")
    return writer.trigger(**({"once": True} if once else {"processingTime": every})).start()


def debounced(changes: DataFrame, gap: str = "1 second", late: str = "1 second") -> DataFrame:
    """The last change (path, modified, content_hash) of each burst of changes of a path, a burst being
    over after ``gap`` without one."""
    bursts = changes.withWatermark("modified", late).groupBy("path", F.session_window("modified", gap).alias("burst"))
    last = F.max(F.struct(F.col("modified").alias("at"), "content_hash"))
    return bursts.agg(last.alias("last")).select("path", F.col("last.at").alias("modified"), "last.content_hash")


#: Files in a batch up to which an update is local or reaches the files that call them; beyond, all.
SMALL, MEDIUM = 2, 5


def depth_of(batch: DataFrame) -> str:
    n = batch.select("path").distinct().limit(MEDIUM + 1).count()
    return "local" if n <= SMALL else "affected" if n <= MEDIUM else "full"


def maintain(changes: DataFrame, update: Callable[[DataFrame, int, str], None], checkpoint: str, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Calls ``update(batch, number, depth)`` for each batch of a stream of changes."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            update(batch, number, depth_of(batch))

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": every})).start()


def upsert(state_path: str, key: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key in a :class:`KeyedState`."""

    def write(batch: DataFrame, number: int) -> None:
        KeyedState(batch.sparkSession, state_path, key, order, buckets=buckets).write(batch, number)

    return write
