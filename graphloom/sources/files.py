"""Graphs, rules and annotations as JSON files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import ANNOTATION, EDGE, NODE, SEMANTICS, Graph


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text so that readers see the old file or the whole new one: under another name
    first, which then takes the place of the old."""
    fs, where = file_system(spark, path)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(where), options)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file whole."""
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    doc = spark.read.schema(f"{key} array<struct<{schema}>>").option("multiLine", True).json(path)
    return doc.select(F.explode(key).alias("x")).select("x.*")


def read_graph(spark: SparkSession, nodes: str, edges: str, annotations: str | None = None) -> Graph:
    """Documents with ``nodes``, ``edges`` and annotation ``nodes``."""
    notes = _rows(spark, annotations, "nodes", ANNOTATION) if annotations else None
    return Graph(_rows(spark, nodes, "nodes", NODE), _rows(spark, edges, "edges", EDGE), notes)


def read_semantics(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "nodes", SEMANTICS)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    from graphloom.operators.policy import COLUMNS

    doc = spark.read.schema(f"rules array<struct<{COLUMNS}>>").option("multiLine", True).json(path)
    return doc.select(F.explode("rules").alias("x")).select("x.*")


def write_graph(graph: Graph, path: str) -> None:
    """Nodes and edges as JSON lines, a folder for each."""
    graph.nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.write.mode("overwrite").json(f"{path}/edges")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(file, executed_lines) of a coverage report."""
    doc = spark.read.schema("files map<string, struct<executed_lines: array<int>>>").option("multiLine", True).json(path)
    return doc.select(F.explode("files").alias("file", "c")).select("file", F.col("c.executed_lines").alias("executed_lines"))


def read_imports(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, names) of an import graph."""
    return _rows(spark, path, "edges", "source string, target string, names array<string>")


def read_runtime_edges(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "edges", "source_file string, source_node string, edge_type string, target string, details map<string,string>")


def read_system(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A declared architecture: modules(subsystem, component, module), functions(module, id), links(source,
    target) and constraints(source, target, type, reason)."""
    schema = (
        "subsystems array<struct<name:string, components:array<struct<name:string, module:string, functions:array<string>>>>>, "
        "edges array<struct<source:string, target:string>>, constraints array<struct<source:string, target:string, type:string, reason:string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    parts = doc.select(F.explode("subsystems").alias("s")).select(F.col("s.name").alias("subsystem"), F.explode("s.components").alias("c"))
    return {
        "modules": parts.select("subsystem", F.col("c.name").alias("component"), "c.module"),
        "functions": parts.select("c.module", F.explode("c.functions").alias("id")),
        "links": doc.select(F.explode("edges").alias("x")).select("x.*"),
        "constraints": doc.select(F.explode("constraints").alias("x")).select("x.*"),
    }
