"""A keyed table that is kept up to date by batches and merged when it is read.

Each batch is written as it came, dealt into buckets by a hash of the key. A manifest says, for each
bucket, which folders hold its rows: one that is merged, and those of batches since, oldest first. A
bucket with more than MERGE of these is merged into a new folder when a batch touches it. So what a batch
writes grows with the batch, and with the buckets that it brings to their turn, but not with the table.

Manifests are numbered by batch and appear at once, by renaming. A batch that is repeated after a failure
starts from the manifest before it again. Folders that none of the last KEEP manifests names go.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.sources.files import file_system, read_text, write_atomic

BUCKETS, MERGE, KEEP = 64, 8, 2


@dataclass
class KeyedState:
    """The newest row of each key: that of the latest batch, and in a batch of the largest ``order``.
    Rows of a batch for which ``removed`` is true take their key out."""

    spark: SparkSession
    path: str
    key: list[str]
    order: str
    removed: str | None = None
    buckets: int = BUCKETS

    def numbers(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, before: int | None = None) -> dict | None:
        """The newest manifest, or the newest before a batch."""
        found = [n for n in self.numbers() if before is None or n < before]
        return json.loads(read_text(self.spark, f"{self.path}/manifests/{found[-1]}.json")) if found else None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.key)), F.lit(self.buckets)).cast("int")

    def newest(self, rows: DataFrame, *before: str) -> DataFrame:
        """One row for each key, by ``before`` and then the order; sums are partial before they are shuffled."""
        columns = [c for c in rows.columns if c != "batch_number"]
        best = F.max_by(F.struct(*columns), F.struct(*before, self.order, F.xxhash64(*columns))).alias("row")
        return rows.groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(self.key)]).agg(best).select("row.*")

    def rows(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        """All rows of some buckets, or all, with the batch they came in as ``batch_number``."""
        schema = StructType.fromJson(manifest["schema"]).add("batch_number", "long")
        folders: dict[str, list[str]] = {}
        for b, held in manifest["buckets"].items():
            for folder in held if buckets is None or b in buckets else ():
                folders.setdefault(folder, []).append(f"{self.path}/{folder}/bucket={b}")
        paths = [p for of in folders.values() for p in of]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table now, or as it was before a batch; None before the first."""
        manifest = self.manifest(before)
        if manifest is None:
            return None
        rows = self.newest(self.rows(manifest), "batch_number")
        return rows if self.removed is None else rows.where(~F.coalesce(F.col(self.removed), F.lit(False)))

    def write(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch; ``number`` grows from batch to batch."""
        manifest = self.manifest(number) or {"schema": batch.schema.jsonValue(), "buckets": {}}
        columns = StructType.fromJson(manifest["schema"]).names
        folder = f"data/{number}-{uuid.uuid4().hex[:8]}"
        newest = self.newest(batch.select(*columns))
        dealt = newest.withColumns({"batch_number": F.lit(number).cast("long"), "bucket": self.bucket()})
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        touched = self.written(folder)
        full = [b for b in touched if len(manifest["buckets"].get(b, [])) >= MERGE]
        for b in touched:
            manifest["buckets"].setdefault(b, []).append(folder)
        if full:
            merged = f"data/{number}-merged-{uuid.uuid4().hex[:8]}"
            rows = self.newest(self.rows(manifest, full), "batch_number")
            if self.removed is not None:
                rows = rows.where(~F.coalesce(F.col(self.removed), F.lit(False)))
            rows = rows.withColumns({"batch_number": F.lit(number).cast("long"), "bucket": self.bucket()})
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{merged}")
            there = self.written(merged)
            for b in full:
                manifest["buckets"][b] = [merged] if b in there else []
        write_atomic(self.spark, f"{self.path}/manifests/{number}.json", json.dumps(manifest))
        self.clean(number)

    def written(self, folder: str) -> list[str]:
        fs, path = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket="))

    def clean(self, number: int) -> None:
        """Deletes manifests but the last KEEP, and folders of batches up to ``number`` that those do not
        name."""
        fs, data = file_system(self.spark, f"{self.path}/data")
        numbers = [n for n in self.numbers() if n <= number]
        named = set()
        for n in numbers[-KEEP:]:
            for held in json.loads(read_text(self.spark, f"{self.path}/manifests/{n}.json"))["buckets"].values():
                named.update(held)
        for n in numbers[:-KEEP]:
            fs.delete(file_system(self.spark, f"{self.path}/manifests/{n}.json")[1], False)
        for s in fs.listStatus(data):
            name = s.getPath().getName()
            if f"data/{name}" not in named and int(name.split("-")[0]) <= number:
                fs.delete(s.getPath(), True)
