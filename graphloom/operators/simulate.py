"""What-if analysis: a change set on the edges, the same operators before and after, and the difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, durable

from .components import cycles, weak_components
from .diff import metric_deltas
from .metrics import hubs
from .policy import layer_violations
from .traverse import arcs, reach

CHANGES = "change string, source string, target string"


def change_set(spark: SparkSession, changes: list[tuple[str, str, str]]) -> DataFrame:
    """Changes (add or remove, source, target)."""
    return spark.createDataFrame(changes, CHANGES)


def apply_changes(graph: Graph, changes: DataFrame, edge_type: str = "call") -> Graph:
    """The graph without the edges of removed pairs and with those of added ones."""
    removed = changes.where("change = 'remove'").select("source", "target")
    added = changes.where("change = 'add'").select("source", "target", F.lit(edge_type).alias("edge_type"), F.lit("static").alias("confidence"))
    kept = graph.edges.join(removed, ["source", "target"], "left_anti").select(graph.edges.columns)
    return graph.with_edges(kept.unionByName(added, allowMissingColumns=True))


def simulate(graph: Graph, changes: DataFrame) -> dict[str, DataFrame]:
    """Metric deltas, new and resolved cycles, new layer violations, and blast radius of a change set."""
    after = apply_changes(graph, changes)
    before_cycles, after_cycles = durable(cycles(graph)), durable(cycles(after))
    touched = changes.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    seeds = touched.select(F.lit("").alias("origin"), "node")
    radius = reach(arcs(after.edges, reverse=True), seeds, 3).select("node").unionByName(touched).agg(F.countDistinct("node").alias("blast_radius"))
    return {
        "metrics": metric_deltas(graph, after),
        "new_cycles": after_cycles.join(before_cycles, "members", "left_anti"),
        "resolved_cycles": before_cycles.join(after_cycles, "members", "left_anti"),
        "new_layer_violations": layer_violations(after).join(layer_violations(graph), ["source", "target"], "left_anti"),
        "blast_radius": radius,
    }


def assess(graph: Graph, changes: DataFrame) -> DataFrame:
    """One row: new_cycles, new_violations, coupling_delta, blast_radius, risk, score."""
    s = simulate(graph, changes)
    m = s["metrics"].where("metric = 'density'").select(F.col("delta").alias("coupling_delta"))
    row = s["new_cycles"].agg(F.count("*").alias("new_cycles")).crossJoin(s["new_layer_violations"].agg(F.count("*").alias("new_violations"))).crossJoin(m).crossJoin(s["blast_radius"])  # one row each
    errors = F.col("new_cycles") + F.col("new_violations")
    risk = F.when(errors > 0, "blocked").when((F.col("coupling_delta") > 0.1) | (F.col("blast_radius") > 50), "high").when(F.col("blast_radius") > 20, "medium").when(F.col("blast_radius") > 5, "low").otherwise("safe")
    score = F.greatest(F.lit(0.0), 1.0 - 0.5 * errors - F.greatest(F.lit(0.0), "coupling_delta") - F.col("blast_radius") / 100.0)
    return row.withColumns({"risk": risk, "score": F.round(score, 6)})


def structural_effects(graph: Graph, changes: DataFrame) -> DataFrame:
    """(kind, subject): connections added and removed, cycles created, layers crossed, regions newly
    joined and hubs touched."""
    after = apply_changes(graph, changes)
    pair = F.concat_ws(" -> ", "source", "target")
    out = changes.select(F.when(F.col("change") == "add", "connection_added").otherwise("connection_removed").alias("kind"), pair.alias("subject"))
    new = cycles(after).join(cycles(graph), "members", "left_anti").select(F.lit("cycle_created").alias("kind"), F.col("members").alias("subject"))
    crossed = layer_violations(after).join(layer_violations(graph), ["source", "target"], "left_anti").select(F.lit("boundary_crossed").alias("kind"), pair.alias("subject"))
    parts = durable(weak_components(graph.nodes, graph.edges))
    added = changes.where("change = 'add'")
    joined = added.join(parts.select(F.col("id").alias("source"), F.col("component").alias("a")), "source").join(parts.select(F.col("id").alias("target"), F.col("component").alias("b")), "target").where("a <> b")
    joined = joined.select(F.lit("region_newly_connected").alias("kind"), pair.alias("subject"))
    ends = changes.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    touched = hubs(graph).join(ends, "id", "left_semi").select(F.lit("hub_touched").alias("kind"), F.col("id").alias("subject"))
    return out.unionByName(new).unionByName(crossed).unionByName(joined).unionByName(touched)


def verdict(assessment: DataFrame) -> DataFrame:
    """Only new cycles reject a change set."""
    return assessment.withColumn("verdict", F.when(F.col("new_cycles") > 0, "reject").otherwise("accept"))


def rank_candidates(graph: Graph, candidates: dict[str, DataFrame]) -> DataFrame:
    """(candidate, risk, score, place) of named change sets, best first."""
    from pyspark.sql import Window

    out = None
    for name, changes in sorted(candidates.items()):
        row = assess(graph, changes).select(F.lit(name).alias("candidate"), "risk", "score")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "candidate")))


def sandbox_score(cycles_: int, layer_violations_: int, edges: int, fan_out: int) -> float:
    return 1 - (0.45 * min(1.0, cycles_ / 5) + 0.35 * min(1.0, layer_violations_ / max(1, edges)) + 0.20 * min(1.0, fan_out / 25))


def patch_problems(graph: Graph, inside: DataFrame, changes: DataFrame) -> DataFrame:
    """(problem, source, target) of a patch to the nodes inside(id): removed edges that others use, added
    edges to a higher layer, added edges that close a cycle of two."""
    removed, added = changes.where("change = 'remove'"), changes.where("change = 'add'")
    e = graph.edges.select("source", "target").distinct()
    outside = removed.join(e, ["source", "target"], "left_semi").join(inside.withColumnRenamed("id", "source"), "source", "left_anti")
    out = outside.select(F.lit("external_breakage").alias("problem"), "source", "target")
    layers = graph.described().select("id", "layer")
    up = added.join(layers.select(F.col("id").alias("source"), F.col("layer").alias("a")), "source").join(layers.select(F.col("id").alias("target"), F.col("layer").alias("b")), "target").where("a < b")
    back = added.join(e.select(F.col("target").alias("source"), F.col("source").alias("target")), ["source", "target"], "left_semi")
    return out.unionByName(up.select(F.lit("layer").alias("problem"), "source", "target")).unionByName(back.select(F.lit("two_cycle").alias("problem"), "source", "target"))
