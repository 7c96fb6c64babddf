"""What tests reach: coverage of communities and of the edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, durable

from .traverse import arcs, reach


def test_reach(graph: Graph, test_layer: int = 4) -> DataFrame:
    """(test, node): what each node of the test layer reaches, itself not."""
    tests = graph.described().where(F.col("layer") == test_layer).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    return durable(reach(arcs(graph.edges), tests).where("origin <> node").select(F.col("origin").alias("test"), "node"))


def _evidence(graph: Graph, test_layer: int) -> DataFrame:
    return graph.described().agg((F.count_if(F.col("layer") == test_layer) > 0).alias("evidence"))


def boundary_coverage(graph: Graph, parts: DataFrame, test_layer: int = 4) -> DataFrame:
    """(partition_id, size, tests, status) of communities (id, partition_id): covered, zero_coverage, or
    missing_evidence where the graph has no tests at all."""
    hit = test_reach(graph, test_layer).join(parts, F.col("node") == F.col("id")).groupBy("partition_id").agg(F.countDistinct("test").alias("tests"))
    sizes = parts.groupBy("partition_id").agg(F.count("*").alias("size"))
    out = sizes.join(hit, "partition_id", "left").fillna(0, ["tests"]).crossJoin(F.broadcast(_evidence(graph, test_layer)))  # one row
    status = F.when(~F.col("evidence"), "missing_evidence").when(F.col("tests") > 0, "covered").otherwise("zero_coverage")
    return out.select("partition_id", "size", "tests", status.alias("status"))


def flow_coverage(graph: Graph, parts: DataFrame, test_layer: int = 4) -> DataFrame:
    """(source, target, tests_source, tests_target, status) of distinct edges between communities: covered
    if a test reaches the source, one_sided if only the target is reached, else untested."""
    counts = test_reach(graph, test_layer).groupBy("node").agg(F.countDistinct("test").alias("n"))
    s, t = parts.select(F.col("id").alias("source"), F.col("partition_id").alias("ps")), parts.select(F.col("id").alias("target"), F.col("partition_id").alias("pt"))
    e = graph.edges.select("source", "target").distinct().join(s, "source").join(t, "target").where("ps <> pt")
    e = e.join(counts.select(F.col("node").alias("source"), F.col("n").alias("tests_source")), "source", "left")
    e = e.join(counts.select(F.col("node").alias("target"), F.col("n").alias("tests_target")), "target", "left").fillna(0, ["tests_source", "tests_target"])
    e = e.crossJoin(F.broadcast(_evidence(graph, test_layer)))  # one row
    status = F.when(~F.col("evidence"), "missing_evidence").when(F.col("tests_source") > 0, "covered").when(F.col("tests_target") > 0, "one_sided").otherwise("untested")
    return e.select("source", "target", "tests_source", "tests_target", status.alias("status"))


def test_attribution(graph: Graph, parts: DataFrame, test_layer: int = 4) -> DataFrame:
    """(test, boundaries, kind) of every test: orphan if it reaches no community, ambiguous if several."""
    hit = test_reach(graph, test_layer).join(parts, F.col("node") == F.col("id")).groupBy("test").agg(F.countDistinct("partition_id").alias("boundaries"))
    tests = graph.described().where(F.col("layer") == test_layer).select(F.col("id").alias("test"))
    out = tests.join(hit, "test", "left").fillna(0, ["boundaries"])
    return out.withColumn("kind", F.when(F.col("boundaries") == 0, "orphan").when(F.col("boundaries") > 1, "ambiguous").otherwise("clear"))


def impact_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(test_id, change) between two tables of impacted tests."""
    from .diff import diff

    return diff(old, new, ["test_id"], ["impact_score", "distance"]).where("change <> 'unchanged'")
