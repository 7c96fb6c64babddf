"""Results as text, JSON, CSV and Mermaid diagrams, and snapshots on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.metrics import degrees


def as_json(df: DataFrame) -> DataFrame:
    """One column, value: each row as JSON with its keys sorted."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def as_text(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def mermaid(graph: Graph, most: int = 50) -> DataFrame:
    """One row: a diagram of the nodes of largest degree, at most ``most``, and the edges between them."""
    top = degrees(graph).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(most).select("id")
    e = graph.edges.select("source", "target", "edge_type").distinct()
    e = e.join(F.broadcast(top.withColumnRenamed("id", "source")), "source").join(F.broadcast(top.withColumnRenamed("id", "target")), "target")
    name = lambda c: F.concat(F.lit("n"), F.substring(F.sha1(c), 1, 8))
    quoted = lambda c: F.regexp_replace(c, '"', "'")
    nodes = top.select(F.lit(0).alias("k"), F.concat(F.lit("  "), name("id"), F.lit('["'), quoted("id"), F.lit('"]')).alias("line"))
    arrows = e.select(F.lit(1).alias("k"), F.concat(F.lit("  "), name("source"), F.lit(" -->|"), "edge_type", F.lit("| "), name("target")).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("k", "line")))  # bounded by the square of ``most``
    return nodes.unionByName(arrows).agg(F.concat(F.lit("graph TD\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("diagram"))


def save_snapshot(graph: Graph, path: str, label: str) -> None:
    """Writes the tables of a graph under a label; a label is written whole or not at all."""
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges), ("annotations", graph.annotations)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}/snapshot={label}")


def load_snapshot(spark: SparkSession, path: str, label: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{path}/{name}/snapshot={label}")
    try:
        notes = read("annotations")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        notes = None
    return Graph(read("nodes"), read("edges"), notes)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot, nodes) of the labels under a path."""
    return spark.read.parquet(f"{path}/nodes").groupBy(F.col("snapshot").cast("string").alias("snapshot")).agg(F.count("*").alias("nodes"))


def append_history(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def rollback(spark: SparkSession, path: str, label: str, as_label: str) -> Graph:
    """Makes an earlier snapshot the newest one, under a label of its own."""
    graph = load_snapshot(spark, path, label)
    save_snapshot(graph, path, as_label)
    return load_snapshot(spark, path, as_label)


def drawing(graph: Graph, most: int = 200) -> DataFrame:
    """One row, value: nodes of largest degree, at most ``most``, and the edges between them, as JSON."""
    top = degrees(graph).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(most)
    shown = top.join(graph.nodes.select("id", "file", "type"), "id")
    e = graph.edges.select("source", "target", "edge_type").distinct()
    e = e.join(F.broadcast(top.select(F.col("id").alias("source"))), "source").join(F.broadcast(top.select(F.col("id").alias("target"))), "target")
    nodes = shown.agg(F.array_sort(F.collect_list(F.struct("id", "file", "type", "fan_in", "fan_out"))).alias("nodes"))
    edges = e.agg(F.array_sort(F.collect_list(F.struct("source", "target", "edge_type"))).alias("edges"))
    return nodes.crossJoin(edges).select(F.to_json(F.struct("nodes", "edges")).alias("value"))  # one row each


def report(graph: Graph, most: int = 200) -> DataFrame:
    """One row, value: a page of HTML with the tables of :func:`drawing`."""
    row = lambda cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.regexp_replace(F.regexp_replace(c.cast("string"), "&", "&amp;"), "<", "&lt;"), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    top = degrees(graph).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(most)
    body = top.agg(F.array_join(F.array_sort(F.collect_list(row([F.col("id"), F.col("fan_in"), F.col("fan_out")]))), "\n").alias("rows"))
    return body.select(F.concat(F.lit("<!DOCTYPE html>\n<table>\n<tr><th>id</th><th>fan-in</th><th>fan-out</th></tr>\n"), "rows", F.lit("\n</table>\n")).alias("value"))


def archive(annotations: DataFrame, graph: Graph, path: str) -> DataFrame:
    """Annotations of nodes that are still there; the others are appended to an archive."""
    gone = annotations.join(graph.nodes.select("id"), "id", "left_anti")
    gone.write.mode("append").parquet(path)
    return annotations.join(graph.nodes.select("id"), "id", "left_semi")


def restore(annotations: DataFrame, graph: Graph, path: str) -> DataFrame:
    """Annotations with those from the archive whose nodes are back and have none."""
    kept = annotations.sparkSession.read.parquet(path).dropDuplicates(["id"])
    back = kept.join(graph.nodes.select("id"), "id", "left_semi").join(annotations.select("id"), "id", "left_anti")
    return annotations.unionByName(back.select(annotations.columns))
