"""The graph that all operators work on: tables of nodes, edges and annotations.

Edges are a multigraph: records that share source and target are all kept. Identifiers are strings;
what stands before the first ``::`` is the module.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, file string, type string, line int, body_hash string, dependency_hash string"
EDGE = "source string, target string, edge_type string, confidence string, source_detail string, conditional boolean"
ANNOTATION = "id string, intent string, layer int, arch_layer string, tags array<string>, intent_body_hash string"
SEMANTICS = (
    "id string, actions array<struct<verb:string,object:string,action_type:string>>, guards array<struct<condition:string,raises:string>>, "
    "side_effects array<struct<effect_type:string,target:string,description:string>>, domain_tags array<string>, library_calls array<string>, sql_operations array<string>"
)

#: The domains of columns, and their order of trust, lowest first.
NODE_TYPES = ("function", "class", "method", "module")
EDGE_TYPES = ("call", "event", "dataflow", "data_flow", "control_flow", "side_effect", "test", "trace", "dynamic")
CONFIDENCE_RANK = {"ai_inferred": 1, "static": 2, "test": 3, "runtime": 4}
TYPE_RANK = {"dynamic": 0, "side_effect": 1, "test": 1, "event": 2, "dataflow": 2, "data_flow": 2, "call": 3, "control_flow": 3, "trace": 4}
ARCH_LAYERS = ("controller", "service", "domain", "repository", "infra")
DEFAULT_LAYER = 3


def module_of(node_id: Column | str) -> Column:
    """What stands before the first ``::``, or the whole id."""
    return F.split_part(F.col(node_id) if isinstance(node_id, str) else node_id, F.lit("::"), F.lit(1))


def last_segment(node_id: Column | str) -> Column:
    return F.element_at(F.split(node_id, "::"), -1)


def rank(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for value, r in ranks.items():
        out = F.when(F.col(column) == value, r).otherwise(out)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, one of this machine, if Spark runs in
    this process alone (tests), and else an error: executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _own[context.applicationId]


_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder for what goes when the application ends."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean_up)
    _written.append((spark, path))
    return path


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed now, once, and read back from a table in the shared folder, which goes when the
    application ends. Its lineage is cut, a lost executor costs nothing before it, and its size is known:
    a checkpoint would keep the guess of the plan before, and over the rounds of an iteration those
    guesses are multiplied until planning takes longer than the work."""
    spark = df.sparkSession
    path = fresh_path(spark, "graphloom-tables")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a growing table up to which it may be sent to all tasks.
FEW_ROWS = 50_000


def by_size(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows as a side of a join: of more than FEW_ROWS it is shuffled. Its compressed files look
    small to the planner, which would send it to all tasks, and so through the driver, up to 10 MB of them."""
    return df if rows <= FEW_ROWS else df.hint("merge")


#: Bytes of input files for each task in which rows are sorted or counted.
SHARE = 8 << 20


def shares(*tables: DataFrame) -> int:
    """Into how many parts to deal rows by a key: one for each SHARE of the files that the tables are read from;
    0 if there are cores enough to leave that to Spark. Spark itself puts up to 64 MB of compressed rows into a
    part, which may be ten times that in the memory of a task."""
    spark = tables[0].sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in {f for t in tables for f in t.inputFiles()}]
    n = -(-sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) // SHARE)
    return n if n > spark.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` shuffled by the keys into n parts, or as it is for 0 of them."""
    return df.repartition(n, *keys) if n else df


def clean_up() -> None:
    """Deletes everything at a :func:`fresh_path`."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


@dataclass(frozen=True)
class Graph:
    """Nodes (id, file, type, ...), edges (source, target, edge_type, confidence), annotations (id,
    layer, arch_layer, ...) or none."""

    nodes: DataFrame
    edges: DataFrame
    annotations: DataFrame | None = None

    def described(self) -> DataFrame:
        """Nodes with the layer and arch_layer of their annotation, by default 3 and empty."""
        if self.annotations is None:
            return self.nodes.withColumns({"layer": F.lit(DEFAULT_LAYER), "arch_layer": F.lit("")})
        own = self.annotations.select("id", F.col("layer").alias("__layer"), F.col("arch_layer").alias("__arch"))
        joined = self.nodes.join(own, "id", "left")
        return joined.withColumns({"layer": F.coalesce("__layer", F.lit(DEFAULT_LAYER)), "arch_layer": F.coalesce("__arch", F.lit(""))}).drop("__layer", "__arch")

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, edges, self.annotations)

    def ends(self, *columns: str) -> DataFrame:
        """Edges with the given node columns of source and target, s_ and t_ before their names;
        edges with an unknown end have none there."""
        attributes = self.described().select("id", *columns)
        s = attributes.select(F.col("id").alias("source"), *(F.col(c).alias("s_" + c) for c in columns))
        t = attributes.select(F.col("id").alias("target"), *(F.col(c).alias("t_" + c) for c in columns))
        return self.edges.join(s, "source", "left").join(t, "target", "left")


def validate(graph: Graph) -> DataFrame:
    """(kind, id) of rows that break the rules: unknown types, repeated ids, unknown edge ends."""
    n, e = graph.nodes, graph.edges
    wrong = n.where(~F.col("type").isin(*NODE_TYPES)).select(F.lit("node_type").alias("kind"), "id")
    repeated = n.groupBy("id").count().where("count > 1").select(F.lit("repeated_id").alias("kind"), "id")
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    unknown = ends.join(n, "id", "left_anti").select(F.lit("unknown_end").alias("kind"), "id")
    types = e.where(~F.col("edge_type").isin(*EDGE_TYPES)).select(F.lit("edge_type").alias("kind"), F.concat_ws(" -> ", "source", "target").alias("id")).distinct()
    return wrong.unionByName(repeated).unionByName(unknown).unionByName(types)
