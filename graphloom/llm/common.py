"""Helpers that the corpus operators share: reading, durable intermediate tables, hashing."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, one of this machine, if Spark runs
    in this process alone (tests), and else an error: executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _own[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean_up)
    _written.append((spark, path))
    return path


def clean_up() -> None:
    """Deletes every intermediate table that this process wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm, jsc = spark._jvm, spark._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that lost executors cost no
    recomputation beyond this point and later uses do not repeat what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled for this table goes when it is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents that no model may learn labels from; null ids too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


#: Rows and bytes that go to a Python worker at once where they hold whole texts; the default of
#: 10,000 rows may be hundreds of megabytes. A single longer row goes alone.
TEXT_ROWS, TEXT_BYTES = 500, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Makes the session send texts to Python in small batches. Spark reads these settings when a
    result is computed, so they have to outlast this call; a stricter setting of the caller stays."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        name = "spark.sql.execution.arrow." + name
        if not 0 < _number(conf.get(name)) <= most:
            conf.set(name, str(most))
    return df


def _number(setting: str) -> int:
    """A size setting in bytes, as Spark prints it or as it was given."""
    digits, unit = re.fullmatch(r"(-?\d+)([a-zA-Z]*)", setting).groups()
    return int(digits) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit.lower()[:1]]


def with_text_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for a Python stage; the id as text, since pandas has floats for nullable
    integers."""
    return small_batches(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def built_once(key: str, build):
    """What ``build`` returns, kept for later tasks of the same Python worker; one value at a time."""
    kept = getattr(sys, "_graphloom_built", (None, None))
    if kept[0] != key:
        sys._graphloom_built = (None, None)  # not two at once
        sys._graphloom_built = kept = (key, build())
    return kept[1]


M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))
