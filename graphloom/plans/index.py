"""The persisted index: tables of a graph, laid out for lookups.

Tables are dealt into buckets by a hash of the column they are looked up by, a folder for each, and
sorted by it inside. A lookup computes the bucket of its key, so that Spark reads one folder and skips
row groups by their statistics; what it costs does not grow with the graph. Edges are kept twice, by
target and by source, and nodes by id and by file. Tests of a node are found among its callers, nodes of a
test among its callees. An index that knows its graph writes a table when it is first asked for.

Searches for a part of an id go by trigrams: a table has a row for each id and each three characters in
a row in it, and another how many ids have each trigram. Of the trigrams that an answer must have the
rarest is read, and what is found is held against the pattern. Patterns without three plain characters in
a row read all ids.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.graph import EDGE, Graph
from graphloom.operators import lookup
from graphloom.sources.files import file_system, read_text, write_atomic

#: Rows of a bucket, about.
BUCKET_ROWS = 1_000_000
#: Table and the column it is looked up by.
KEYS = {
    "nodes": "id", "files": "file", "callers": "target", "callees": "source", "layers": "layer",
    "trigrams": "gram", "trigram_counts": "gram", "dependency_hashes": "id",
}
#: Wildcards are plain characters where a text is no pattern; nothing is known of their trigrams then.
LITERAL = {ord("*"): "\u00e9", ord("?"): "\u00e9"}
#: Trigrams of a pattern that are looked up to find the rarest.
ASKED = 64


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_index(graph: Graph, path: str, hashes: DataFrame | None = None) -> dict[str, int]:
    """Writes the tables under a path, replacing an index there, and gives their numbers of rows.
    ``hashes`` (id, dependency_hash) are left out if there are none."""
    counts = {}
    for name in KEYS:
        if name != "dependency_hashes" or hashes is not None:
            write_table(graph, path, name, hashes)
            counts[name] = Index(graph.nodes.sparkSession, path).table(name)[0].count()
    return counts


def write_table(graph: Graph, path: str, name: str, hashes: DataFrame | None = None) -> None:
    """Writes one table of an index. ``trigram_counts`` are counted in the table of trigrams there."""
    spark, key = graph.nodes.sparkSession, KEYS[name]
    if name == "trigrams":
        df = trigrams(graph.nodes.select("id").distinct())
    elif name == "trigram_counts":
        df = Index(spark, path, graph).table("trigrams")[0].groupBy("gram").agg(F.count("*").alias("n"))
    elif name == "layers":
        df = graph.described().select("id", "layer", "arch_layer")
    elif name == "dependency_hashes":
        df = hashes.select("id", "dependency_hash")
    else:
        df = graph.edges if name in ("callers", "callees") else graph.described()
    rows = graph.edges.count() if name in ("callers", "callees") else graph.nodes.count() * (12 if name == "trigrams" else 1)
    pieces = max(1, rows // BUCKET_ROWS)
    dealt = df.withColumns({"bucket": bucket(F.col(key), pieces), "__deal": F.xxhash64(*df.columns)})
    # a key may hold any share of the rows: ranges of equal numbers of rows cut a large bucket into many files
    dealt = dealt.repartitionByRange(pieces, "bucket", "__deal").drop("__deal").sortWithinPartitions("bucket", key)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    write_atomic(spark, f"{path}/{name}.json", json.dumps({"buckets": pieces, "schema": dealt.schema.jsonValue()}))


def trigrams(ids: DataFrame) -> DataFrame:
    """(gram, id): the different three characters in a row of each id, in lower case."""
    low = F.lower("id")
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return ids.where(F.length(low) >= 3).select(F.explode(F.array_distinct(grams)).alias("gram"), "id")


def grams_of(pattern: str) -> list[str]:
    """Trigrams that ids matching a glob must have. Characters beyond ASCII are left out, as lower case
    is not the same everywhere."""
    found = {run[i : i + 3].lower() for run in re.split(r"[*?]", pattern) for i in range(len(run) - 2)}
    return sorted(g for g in found if g.isascii())[:ASKED]


@dataclass
class Index:
    """Lookups in what :func:`write_index` wrote. Tables are opened once; with ``source``, the graph, those
    that are not there are written."""

    spark: SparkSession
    path: str
    source: Graph | None = None
    opened: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)

    def table(self, name: str) -> tuple[DataFrame, int]:
        if name not in self.opened:
            fs, about = file_system(self.spark, f"{self.path}/{name}.json")
            if self.source is not None and not fs.exists(about):
                write_table(self.source, self.path, name)
            about = json.loads(read_text(self.spark, f"{self.path}/{name}.json"))
            schema = StructType.fromJson(about["schema"])  # an empty table has no files to tell it
            self.opened[name] = (self.spark.read.schema(schema).parquet(f"{self.path}/{name}"), about["buckets"])
        return self.opened[name]

    def rows(self, name: str, *keys: str | int) -> DataFrame:
        """The rows of some keys."""
        df, buckets = self.table(name)
        there = F.col("bucket").isin(*(bucket(F.lit(k), buckets) for k in keys))  # folded, so only these are listed
        return df.where(there & F.col(KEYS[name]).isin(*keys)).drop("bucket")

    def node(self, node_id: str) -> DataFrame:
        return self.rows("nodes", node_id)

    def node_ids(self) -> DataFrame:
        return self.table("nodes")[0].select("id").orderBy("id")

    def nodes_in_file(self, file: str) -> DataFrame:
        return self.rows("files", file)

    def callers(self, node_id: str) -> DataFrame:
        return self.rows("callers", node_id).select(F.col("source").alias("caller_id"), "edge_type", "confidence")

    def callees(self, node_id: str) -> DataFrame:
        return self.rows("callees", node_id).select(F.col("target").alias("callee_id"), "edge_type", "confidence")

    def at_layer(self, layer: int) -> DataFrame:
        return self.rows("layers", layer).select("id").orderBy("id")

    def tests_of(self, node_id: str, test_layer: int = 4) -> DataFrame:
        """Of the nodes only the buckets of callers are read."""
        into = self.rows("callers", node_id).select(F.col("source").alias("id"), "edge_type")
        nodes, buckets = self.table("nodes")
        asked = [r["b"] for r in into.select(bucket(F.col("id"), buckets).alias("b")).distinct().collect()]
        tests = nodes.where(F.col("bucket").isin(*asked) & (F.col("layer") == test_layer)).select("id")
        found = into.where("edge_type = 'test'").select("id").unionByName(into.select("id").distinct().join(tests, "id", "left_semi"))
        return found.select(F.col("id").alias("test_id")).distinct()

    def nodes_of_test(self, test_id: str, test_layer: int = 4) -> DataFrame:
        out = self.rows("callees", test_id).select(F.col("source").alias("id"), F.col("target").alias("node_id"), "edge_type")
        of_tests = out.join(self.node(test_id).where(F.col("layer") == test_layer), "id", "left_semi")
        return out.where("edge_type = 'test'").select("node_id").unionByName(of_tests.select("node_id")).distinct()

    def dependency_hash(self, node_id: str) -> DataFrame:
        return self.rows("dependency_hashes", node_id).select("id", "dependency_hash")

    def dependency_hashes(self) -> DataFrame:
        return self.table("dependency_hashes")[0].drop("bucket")

    def candidates(self, pattern: str) -> DataFrame:
        """(id) of the nodes that have the rarest trigram of a glob: all that match it, and others."""
        grams = grams_of(pattern)
        if not grams:
            return self.table("nodes")[0].select("id")
        counts = {r["gram"]: r["n"] for r in self.rows("trigram_counts", *grams).collect()}
        return self.rows("trigrams", min(grams, key=lambda g: (counts.get(g, 0), g))).select("id")

    def _among(self, pattern: str) -> Graph:
        """The candidates as nodes of a graph without edges, which searches do not read."""
        return Graph(self.candidates(pattern), self.spark.createDataFrame([], EDGE))

    def search(self, pattern: str, limit: int = 100) -> DataFrame:
        return lookup.search_nodes(self._among(pattern), pattern, limit)

    def suggest(self, text: str, limit: int = 5) -> DataFrame:
        """Whatever kind of likeness finds something, the ids hold the last segment of the text."""
        return lookup.suggest(self._among(text.rsplit("::", 1)[-1].translate(LITERAL)), text, limit)

    def resolve(self, needle: str, limit: int = 100) -> DataFrame:
        return lookup.resolve(self._among(needle), needle, limit)

    def graph(self) -> Graph:
        """The graph itself, for what is more than a lookup."""
        nodes, edges = self.table("nodes")[0].drop("bucket"), self.table("callees")[0].drop("bucket")
        return Graph(nodes.drop("layer", "arch_layer"), edges, nodes.select("id", "layer", "arch_layer"))
