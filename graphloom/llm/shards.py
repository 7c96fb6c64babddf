"""Sharding by sampled splitters, under the law that shards have nearly equal bytes.

Records are ordered by a key made of a hash of their group (equal texts) and a hash of their id. A
sample of keys, drawn with chances in proportion to size, gives quantiles that split this order into
many ranges of about equal bytes; ranges that turn out overfull are subdivided. Exact sizes of the
ranges and running sums inside them place every record in the whole order, which is then cut into
shards. A group at a cut stays in one shard if it is small.

The law is about bytes, so a record or a group is only kept whole where that costs a shard at most
1 / BIG of its share: a larger record is dealt by itself to the emptiest shard first, at most BIG for
each shard, with room left for it by the cuts, and a larger group is cut.

Null texts count 16 bytes, have checksum 0 and are a group. Rows that repeat an id are placed each, in
neighbouring slots if their texts are equal too. A null id is a value like any other. An empty table
gives an empty result. Other columns pass through; columns that
begin with two underscores are the operator's own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BIG = 64
#: Ranges per shard, sampled keys per range, and rows of a range beyond which there are more ranges.
RANGES, SAMPLES, RANGE_ROWS = 32, 16, 500_000


def placer(bounds: np.ndarray):
    """Number of ``bounds``, ascending, that are at most the value."""

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right").astype(np.int32))

    return place


def _ranges(small: DataFrame, total: int, rows: int, n_shards: int) -> tuple[np.ndarray, list]:
    """Splitters of the key order, and (range, bytes, rows) of each range with rows."""
    n = n_shards * RANGES + rows // RANGE_ROWS
    luck = F.pmod(F.xxhash64("__key", F.lit(3)), F.lit(1 << 31)) / float(1 << 31)
    sample = small.where(luck < F.col("size") * F.col("__times") * float(n * SAMPLES / total)).select("__key")
    keys = np.sort(np.array([r[0] for r in sample.collect()], np.int64))  # n * SAMPLES on average
    splitters = np.unique(keys[:: max(1, len(keys) // n)])
    while True:  # each round cuts the keys of an overfull range into two parts at least, and keys have 64 bits
        found = small.groupBy(placer(splitters)("__key").alias("range")).agg(F.sum(F.col("size") * F.col("__times")), F.sum("__times"), F.min("__key"), F.max("__key")).collect()
        over = [r for r in found if r[1] > 4 * total / n and r[4] > r[3]]
        if not over:
            break
        more = [np.linspace(r[3], r[4], int(r[1] * n / total) + 2)[1:-1].astype(np.int64) for r in over]
        splitters = np.unique(np.concatenate([splitters, *more]))
    return splitters, sorted((r[0], r[1], r[2]) for r in found)


def assign_shards(records: DataFrame, n_shards: int) -> DataFrame:
    """Records (doc_id, size, group, ...) with ``shard`` and ``slot``, numbers from 0 in a shard.
    ``group`` is a hash of what should stay together. Records equal in all columns are one with a
    count until they are placed, so that they do not meet in a task."""
    key = F.shiftleft(F.shiftright(F.xxhash64("group"), 32), 32) + F.xxhash64("doc_id", F.lit(1)).bitwiseAND(0xFFFFFFFF)
    names = records.columns
    base = cut(records.groupBy(*names).agg(F.count("*").alias("__times")).withColumn("__key", key), "records")
    rows, total = base.agg(F.coalesce(F.sum("__times"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("__times")), F.lit(0))).first()
    order = ["__key", *names]
    empty = base.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if not rows:
        return empty.limit(0)
    share = total / n_shards
    limit = share / BIG

    # large records, at most BIG * n_shards of them
    times = F.explode(F.sequence(F.lit(1), F.col("__times")))
    large = base.where(F.col("size") > limit).withColumn("__time", times).withColumn("__row", F.row_number().over(Window.orderBy(F.desc("size"), *order)))
    sizes = [r[0] for r in large.orderBy("__row").select("size").collect()]
    heap, dealt, load, count = [(0, s) for s in range(n_shards)], [], [0] * n_shards, [0] * n_shards
    for i, size in enumerate(sizes):
        held, s = heapq.heappop(heap)
        dealt.append((i + 1, s, count[s]))
        load[s], count[s] = held + size, count[s] + 1
        heapq.heappush(heap, (load[s], s))
    spark = base.sparkSession
    if dealt:
        to = spark.createDataFrame(dealt, "__row int, shard int, slot long")
        first = large.join(F.broadcast(to), "__row").select(*names, "shard", "slot")
    else:
        first = empty.limit(0)
    rest = total - sum(sizes)
    small = base.where(F.col("size") <= limit)
    n_small = rows - len(sizes)
    if not n_small:
        return first

    # the level to which the small ones fill every shard
    level, left, filled = 0.0, rest, sorted(load)
    for i, held in enumerate(filled):
        room = sum(held - x for x in filled[:i])
        if room > rest:
            break
        level = held + (left - room) / (i + 1)
    bounds = np.cumsum([max(0.0, level - x) for x in load])[:-1]

    splitters, found = _ranges(small, max(1, rest), n_small, n_shards)
    offsets, at, row = [], 0, 0
    for number, size, n in found:
        offsets.append((number, at, row))
        at, row = at + size, row + n
    to = F.broadcast(spark.createDataFrame(offsets, "__range int, __bytes long, __rows long"))  # as many rows as ranges
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = small.withColumns({"__range": placer(splitters)("__key"), "__held": F.col("size") * F.col("__times")})
    placed = ranged.withColumns({"__end": F.sum("__held").over(inside), "__row": F.sum("__times").over(inside)}).join(to, "__range").withColumn("__time", times)
    before = F.col("__times") - F.col("__time")  # of equal records that come after this one
    placed = placed.withColumns({"__begin": F.col("__bytes") + F.col("__end") - F.col("size") * (before + 1), "__row": F.col("__rows") + F.col("__row") - before})
    placed = cut(placed.select(*names, "__key", "__begin", "__row"), "placed")

    # a small group that a cut divides goes to one side
    of = F.shiftright("__key", 32)
    cuts = F.array(*(F.lit(float(b)) for b in bounds)) if len(bounds) else F.array().cast("array<double>")
    at_cut = F.exists(cuts, lambda b: (F.col("__begin") <= b) & (b < F.col("__begin") + F.col("size")))
    divided = [r[0] for r in placed.where(at_cut).select(of).distinct().collect()]  # one for each cut at most
    groups = placed.where(of.isin(divided)).groupBy(of.alias("g")).agg(F.min("__begin"), F.max(F.col("__begin") + F.col("size"))).collect() if divided else []
    for k, b in enumerate(bounds):
        for _, begin, end in groups:
            if begin < b < end and end - begin <= limit:
                bounds[k] = begin if b - begin <= end - b else end
    # a record belongs to the shard in which its middle lies
    middle = F.col("__begin") + F.col("size") / 2
    shards = cut(placed.withColumn("shard", placer(np.sort(bounds))(middle)), "shards")
    starts = {r[0]: r[1] for r in shards.groupBy("shard").agg(F.min("__row")).collect()}  # one for each shard at most
    to = spark.createDataFrame([(s, r, count[s]) for s, r in starts.items()], "shard int, __first long, __large long")
    then = shards.join(F.broadcast(to), "shard").withColumn("slot", F.col("__row") - F.col("__first") + F.col("__large"))
    return first.unionByName(then.select(*names, "shard", "slot"))


def shard_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents (doc_id, text)."""
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    records = docs.select(F.col("doc_id").cast("long"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("group"))
    out = assign_shards(records, n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, n_shards: int, path: str) -> None:
    """Writes the documents as Parquet, a folder for each shard, rows in the order of their slots. Rows
    equal in id and text take the slots of theirs in any order."""
    text = F.col("text").cast("string")
    key = [F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__hash")]
    numbered = docs.select(*key, F.monotonically_increasing_id().alias("__row"), F.struct(*docs.columns).alias("__doc"))
    records = docs.select(*key, (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    placed = assign_shards(records.select(F.col("__id").alias("doc_id"), "size", "text_crc32", F.col("__hash").alias("group")), n_shards)
    placed = placed.select(F.col("doc_id").alias("__pid"), F.col("group").alias("__phash"), "shard", "slot")
    # the first, second ... of equal rows takes the first, second ... of their places
    nth = lambda names, by: F.row_number().over(Window.partitionBy(*names).orderBy(*by))
    numbered = numbered.withColumn("__n", nth(("__id", "__hash"), ("__row",)))
    placed = placed.withColumn("__n", nth(("__pid", "__phash"), ("shard", "slot"))).withColumnRenamed("__n", "__pn")
    on = F.col("__id").eqNullSafe(F.col("__pid")) & (F.col("__hash") == F.col("__phash")) & (F.col("__n") == F.col("__pn"))
    out = numbered.join(placed, on).select("__doc.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    clash = [c for c in docs.columns if c in ("shard", "slot")]
    out = out.drop(*clash).withColumnsRenamed({"__shard": "shard", "__slot": "slot"})
    out.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
