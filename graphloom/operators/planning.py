"""Declared architectures against graphs, slices for a focus, and what a change touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, module_of

from .metrics import degrees
from .traverse import neighbourhood


def coverage_plan(graph: Graph, modules: DataFrame, functions: DataFrame, links: DataFrame, denied: DataFrame) -> DataFrame:
    """(kind, subject, priority): declared modules(module), functions(id) and links(source, target) between
    modules that the graph lacks, and calls between modules that denied(source, target) excludes."""
    pair = F.concat_ws(" -> ", "source", "target")
    row = lambda df, kind, subject, p: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), F.lit(p).alias("priority"))
    has = graph.nodes.select(module_of("id").alias("module")).distinct()
    calls = graph.edges.select(module_of("source").alias("source"), module_of("target").alias("target")).distinct()
    out = row(modules.join(has, "module", "left_anti"), "missing_module", F.col("module"), 2)
    out = out.unionByName(row(functions.join(graph.nodes, "id", "left_anti"), "missing_function", F.col("id"), 3))
    out = out.unionByName(row(links.join(calls, ["source", "target"], "left_anti"), "missing_link", pair, 2))
    return out.unionByName(row(calls.join(denied, ["source", "target"], "left_semi"), "denied_link", pair, 1))


def focus_slice(graph: Graph, needle: str, hops: int = 1, most: int = 200) -> DataFrame:
    """(id, depth, fan_in, fan_out): nodes of a file, else a node, else nodes whose id holds the text, and
    what is within some hops of them."""
    stage = F.when(F.col("file") == needle, 0).when(F.col("id") == needle, 1).when(F.lower("id").contains(needle.lower()), 2)
    found = graph.nodes.select("id", stage.alias("stage")).where("stage is not null")
    first = found.join(F.broadcast(found.agg(F.min("stage").alias("stage"))), "stage").select("id").orderBy("id").limit(most)
    seeds = [r["id"] for r in first.collect()]  # at most ``most``
    if not seeds:
        return degrees(graph).limit(0).withColumn("depth", F.lit(0)).select("id", "depth", "fan_in", "fan_out")
    near = neighbourhood(graph, seeds, hops, most)
    return near.groupBy("id").agg(F.min("depth").alias("depth")).join(degrees(graph), "id").orderBy("depth", "id")


def scope_slice(graph: Graph, prefix: str) -> DataFrame:
    """(source, target, direction): distinct edges that touch the files with a prefix."""
    e = graph.ends("file").select("source", "target", F.coalesce(F.col("s_file").startswith(prefix), F.lit(False)).alias("s"), F.coalesce(F.col("t_file").startswith(prefix), F.lit(False)).alias("t"))
    kind = F.when(F.col("s") & F.col("t"), "internal").when(F.col("s"), "outbound").otherwise("inbound")
    return e.where("s or t").select("source", "target", kind.alias("direction")).distinct()


def slice_metrics(graph: Graph, inside: DataFrame) -> DataFrame:
    """One row: nodes, edges, max and mean fan-out, and edges to higher layers, of the subgraph inside(id)."""
    e = graph.ends("layer").join(inside.select(F.col("id").alias("source")), "source", "left_semi").join(inside.select(F.col("id").alias("target")), "target", "left_semi")
    fans = e.groupBy("source").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_fan_out"))
    base = e.agg(F.count("*").alias("edges"), F.count_if(F.col("s_layer") < F.col("t_layer")).alias("layer_violations"))
    return inside.agg(F.count("*").alias("nodes")).crossJoin(base).crossJoin(fans).withColumn("mean_fan_out", F.round(F.col("edges") / F.greatest("nodes", F.lit(1)), 6))  # one row each


def touched_partitions(graph: Graph, parts: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(partition_id, nodes): communities with nodes of changed(file), and how many."""
    ids = graph.nodes.join(changed_files.select("file").distinct(), "file", "left_semi").select("id")
    return parts.join(ids, "id", "left_semi").groupBy("partition_id").agg(F.count("*").alias("nodes"))


def layer_changes(old: Graph, new: Graph) -> DataFrame:
    """(id, before, after, safe) of nodes whose layer changed; safe within the layers 3 and 4."""
    a, b = old.described().select("id", F.col("layer").alias("before")), new.described().select("id", F.col("layer").alias("after"))
    return a.join(b, "id").where("before <> after").withColumn("safe", F.col("before").isin(3, 4) & F.col("after").isin(3, 4))


def override_layers(nodes: DataFrame, overrides: list[tuple[str, str, int]]) -> DataFrame:
    """Nodes with the layer of the first override (prefix or contains, text, layer) that fits the file."""
    found = F.coalesce(*(F.when(F.col("file").startswith(text) if how == "prefix" else F.col("file").contains(text), layer) for how, text, layer in overrides), F.col("layer"))
    return nodes.withColumn("layer", found)


def recommendations(history: DataFrame, step: float = 0.05) -> DataFrame:
    """(finding): what the last three rows of history(at, score, god_modules, cycles) suggest."""
    last = history.orderBy(F.desc("at")).limit(3)
    ends = last.agg(*(F.min_by(c, "at").alias("a_" + c) for c in ("score", "god_modules", "cycles")), *(F.max_by(c, "at").alias("b_" + c) for c in ("score", "god_modules", "cycles")))
    rise = lambda c: F.col("b_" + c) - F.col("a_" + c)
    each = F.array_compact(F.array(F.when(rise("score") > step, "score_improving"), F.when(rise("score") < -step, "score_declining"), F.when(rise("god_modules") > 0, "god_modules_rising"), F.when(rise("cycles") > 0, "cycles_rising")))
    return ends.select(F.explode(each).alias("finding"))


def alignment(graph: Graph) -> DataFrame:
    """(id, problem): nodes without an intent, annotations without a node, and changed bodies."""
    from .diff import missing_intents, stale_intents

    gone = stale_intents(graph).select("id", F.when(F.col("reason") == "node_missing", "stale").otherwise("changed").alias("problem"))
    return missing_intents(graph).withColumn("problem", F.lit("missing")).unionByName(gone)
