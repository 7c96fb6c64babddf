"""Traversals as frontier joins over the edge table.

A traversal starts from a table of seeds (origin, node) and keeps, for every origin, the nodes it has
reached. Each round joins the newest nodes with the edges, drops what is known and checkpoints the
rest, so that plans stay short; only the emptiness of the frontier is looked at on the driver. Short
bounded traversals are unrolled into one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, durable

from .lookup import matches, test_pairs

#: Levels of a traversal that are kept as tables of their own before they become one.
COMPACT = 10


def arcs(edges: DataFrame, reverse: bool = False, undirected: bool = False) -> DataFrame:
    """Distinct (at, to) steps."""
    forward = edges.select(F.col("source").alias("at"), F.col("target").alias("to"))
    backward = edges.select(F.col("target").alias("at"), F.col("source").alias("to"))
    if undirected:  # both from one pass, so that the edges are not made twice
        both = F.array(F.struct(F.col("source").alias("at"), F.col("target").alias("to")), F.struct(F.col("target").alias("at"), F.col("source").alias("to")))
        return edges.select(F.inline(both)).distinct()
    return (backward if reverse else forward).distinct()


def seeds_of(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "origin string, node string")


def reach(steps: DataFrame, seeds: DataFrame, depth: int | None = None, halt: DataFrame | None = None) -> DataFrame:
    """(origin, node, depth): nodes that each origin reaches in one step or more, with their least
    number of steps. The origin is among them if it lies on a cycle. Nodes in ``halt(node)`` are
    reached but not left."""

    def step(frontier: DataFrame) -> DataFrame:
        live = frontier if halt is None else frontier.join(halt.select("node").distinct(), "node", "left_anti")
        return live.join(steps, live.node == steps.at).select("origin", F.col("to").alias("node")).distinct()

    if depth is not None and depth <= 3:
        found, frontier = None, seeds
        for d in range(1, depth + 1):
            frontier = step(frontier)
            layer = frontier.withColumn("depth", F.lit(d))
            found = layer if found is None else found.unionByName(layer)
        return found.groupBy("origin", "node").agg(F.min("depth").alias("depth"))
    steps = durable(steps)
    found, frontier, d = None, seeds, 0
    while depth is None or d < depth:
        d += 1
        new = step(frontier)
        if found is not None:
            new = new.join(found, ["origin", "node"], "left_anti")
        frontier = durable(new)
        if frontier.isEmpty():
            break
        layer = frontier.withColumn("depth", F.lit(d))
        found = layer if found is None else found.unionByName(layer)
        if d % COMPACT == 0:  # else a long chain would be as many small tables
            found = durable(found.coalesce(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return found if found is not None else seeds.limit(0).withColumn("depth", F.lit(0))


def callers(graph: Graph, node_id: str, depth: int = 1) -> DataFrame:
    """The nodes that call the node, one row for each edge record; at a greater depth those at most so
    many calls before it, once each and never itself."""
    return _near(graph, node_id, depth, reverse=True)


def callees(graph: Graph, node_id: str, depth: int = 1) -> DataFrame:
    return _near(graph, node_id, depth, reverse=False)


def _near(graph: Graph, node_id: str, depth: int, reverse: bool) -> DataFrame:
    if depth < 1:
        raise ValueError("depth must be at least 1")
    if depth == 1:
        own, other = ("target", "source") if reverse else ("source", "target")
        return graph.edges.where(F.col(own) == node_id).select(F.col(other).alias("id")).orderBy("id")
    seeds = seeds_of(graph.nodes.sparkSession, [node_id])
    found = reach(arcs(graph.edges, reverse), seeds, depth).select(F.col("node").alias("id"))
    return found.where(F.col("id") != node_id).orderBy("id")


def dependencies(graph: Graph, node_id: str, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """Everything the node depends on, never itself, nearest first."""
    found = reach(arcs(graph.edges), seeds_of(graph.nodes.sparkSession, [node_id]), depth)
    found = found.where(F.col("node") != node_id).select(F.col("node").alias("id"), "depth").orderBy("depth", "id")
    return found if limit is None else found.limit(limit)


def dependents(graph: Graph, node_id: str, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """Everything that depends on the node, itself too if it lies on a cycle."""
    found = reach(arcs(graph.edges, reverse=True), seeds_of(graph.nodes.sparkSession, [node_id]), depth)
    found = found.select(F.col("node").alias("id"), "depth").orderBy("depth", "id")
    return found if limit is None else found.limit(limit)


def limited(found: DataFrame, limit: int | None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The first rows of an answer with ``total``, how many there are without the limit, and
    ``truncated``. No limit, or one of 0, keeps all rows."""
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy(*order).limit(limit) if limit else found
    truncated = F.col("total") > limit if limit else F.lit(False)
    return rows.crossJoin(total).withColumn("truncated", truncated)  # one row of totals


def shortest_paths(graph: Graph, seeds: DataFrame, targets: DataFrame, depth: int = 50, nearest: bool = False) -> DataFrame:
    """(origin, node, hops, path): a shortest path from each origin to each target(node) it reaches;
    of several the first in the order of their ids. A target that is the origin has a path of 0. With
    ``nearest`` an origin stops at the distance of its first targets."""
    steps = durable(arcs(graph.edges))
    ends = targets.select("node").distinct()
    frontier = seeds.select("origin", "node", F.array("origin").alias("path"))
    known, d = frontier, 0
    layers = [frontier.withColumn("hops", F.lit(0))]
    while d < depth:
        d += 1
        if nearest:
            frontier = frontier.join(frontier.join(ends, "node", "left_semi").select("origin").distinct(), "origin", "left_anti")
        new = frontier.join(steps, frontier.node == steps.at).select("origin", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"))
        new = new.groupBy("origin", "node").agg(F.min("path").alias("path")).join(known.select("origin", "node"), ["origin", "node"], "left_anti")
        frontier = durable(new)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        layers.append(frontier.withColumn("hops", F.lit(d)))
    found = layers[0]
    for layer in layers[1:]:
        found = found.unionByName(layer)
    return found.join(ends, "node", "left_semi").select("origin", "node", "hops", "path")


def path(graph: Graph, source: str, target: str, depth: int = 50) -> DataFrame:
    spark = graph.nodes.sparkSession
    return shortest_paths(graph, seeds_of(spark, [source]), spark.createDataFrame([(target,)], "node string"), depth or 50)


def pattern_paths(graph: Graph, source_glob: str, target_glob: str, depth: int = 20, max_paths: int = 10) -> DataFrame:
    """For each matching source the path to its nearest matching target, at most ``max_paths``."""
    ids = graph.nodes.select(F.col("id").alias("node"))
    sources = ids.where(matches("node", source_glob)).select(F.col("node").alias("origin"), "node")
    found = shortest_paths(graph, sources, ids.where(matches("node", target_glob)), depth, nearest=True)
    best = found.groupBy("origin").agg(F.min(F.struct("hops", "path")).alias("b"))
    return best.select("origin", "b.hops", "b.path").orderBy("origin").limit(max_paths)


def orphans(graph: Graph, layer: int | None = None) -> DataFrame:
    """Nodes other than modules that no edge touches."""
    touched = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = graph.described() if layer is not None else graph.nodes
    found = nodes.where("type <> 'module'").join(touched, "id", "left_anti")
    return (found if layer is None else found.where(F.col("layer") == layer)).select("id").orderBy("id")


def explain(graph: Graph, node_id: str, hashes: DataFrame | None = None, intents: DataFrame | None = None) -> DataFrame:
    """One row: the node, its first ten callers and callees, and its tests; with ``hashes`` (id,
    dependency_hash) and ``intents`` (id, intent, tags, body_hash) also these, null if unknown, and
    ``stale``: whether the body has changed since the intent was written."""
    node = graph.described().where(F.col("id") == node_id)

    def first(rows: DataFrame, column: str, name: str) -> DataFrame:
        few = rows.select(column).distinct().orderBy(column).limit(10)  # a hub's callers never meet in one row
        return few.agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias(name))

    e = graph.edges
    before = first(e.where(F.col("target") == node_id), "source", "callers")
    after = first(e.where(F.col("source") == node_id), "target", "callees")
    tests = first(test_pairs(graph).where(F.col("node_id") == node_id), "test_id", "tests")
    out = node.crossJoin(before).crossJoin(after).crossJoin(tests)  # one row each
    if hashes is not None:
        out = out.join(hashes.where(F.col("id") == node_id).select("id", "dependency_hash"), "id", "left")
    if intents is not None:
        own = intents.where(F.col("id") == node_id).select("id", "intent", "tags", F.col("body_hash").alias("__written"))
        out = out.join(own, "id", "left").withColumn("stale", F.col("__written") != F.col("body_hash")).drop("__written")
    return out


def blast_radius(graph: Graph, ids: list[str], depth: int = 3) -> DataFrame:
    """How many nodes are among the seeds or at most three calls before one."""
    seeds = seeds_of(graph.nodes.sparkSession, ids)
    found = reach(arcs(graph.edges, reverse=True), seeds, depth).select("node").unionByName(seeds.select("node"))
    return found.agg(F.countDistinct("node").alias("blast_radius"))


def neighbourhood(graph: Graph, ids: list[str], hops: int = 2, most: int = 200) -> DataFrame:
    """Nodes within some hops of the seeds in either direction, nearest first, at most ``most``."""
    seeds = seeds_of(graph.nodes.sparkSession, ids)
    found = reach(arcs(graph.edges, undirected=True), seeds, hops).unionByName(seeds.withColumn("depth", F.lit(0)))
    return found.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth")).orderBy("depth", "id").limit(most)


def impacted_tests(graph: Graph, changed: DataFrame, test_layer: int = 4) -> DataFrame:
    """(test_id, impact_score, distance): tests that reach changed(node) backwards; the search does not
    go on beyond a test. impact_score is the number of changes that reach the test."""
    tests = graph.described().where(F.col("layer") == test_layer).select(F.col("id").alias("node"))
    seeds = changed.select(F.col("node").alias("origin"), "node")
    found = reach(arcs(graph.edges, reverse=True), seeds, halt=tests).join(tests, "node", "left_semi")
    return found.groupBy(F.col("node").alias("test_id")).agg(F.countDistinct("origin").alias("impact_score"), F.min("depth").alias("distance"))


def prioritised(impact: DataFrame) -> DataFrame:
    """Tests in the order to run them: direct ones, then by score, distance and id."""
    return impact.orderBy(F.col("distance") > 1, F.desc("impact_score"), "distance", "test_id")


def invalidated(graph: Graph, changed: DataFrame) -> DataFrame:
    """Changed(node) and all that depends on it."""
    seeds = changed.select(F.lit("").alias("origin"), "node")
    return reach(arcs(graph.edges, reverse=True), seeds).select("node").unionByName(changed.select("node")).distinct()


def deepest_dependency(graph: Graph, roots: int = 50, cap: int = 50) -> DataFrame:
    """The largest least distance from the first roots by id: nodes with callees and no callers."""
    called = graph.edges.select(F.col("target").alias("id")).distinct()
    callers_ = graph.edges.select(F.col("source").alias("id")).distinct()
    first = callers_.join(called, "id", "left_anti").orderBy("id").limit(roots)
    found = reach(arcs(graph.edges), first.select(F.col("id").alias("origin"), F.col("id").alias("node")), cap)
    return found.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


#: The kinds of edges that hold a subsystem together.
BINDING = ("call", "dependency", "depends", "dataflow", "data_flow", "runtime", "http_call", "rpc_call", "event", "event_produce", "event_consume", "queue_task", "frontend_to_backend")


def subsystem_slice(graph: Graph, root: str, hops: int = 2, most: int = 200, density: float = 0.4, parts: DataFrame | None = None, runtime: DataFrame | None = None) -> DataFrame:
    """(id, depth, boundary, external_edges) of the subsystem around a node, nearest first: nodes within
    ``hops`` steps along BINDING edges in any direction, at most ``most``, nearer ones and then smaller ids
    first. With ``parts`` (id, partition_id) steps stay in the root's partition; ``runtime`` (source,
    target) edges between nodes may leave it for a node outside, where only further runtime edges that
    touch the partition go on. Of these nodes those stay that have at least ``density`` of their neighbours
    among them and, unless they are of the root's module, a neighbour that is. Boundary nodes have records
    to nodes that are not in the slice, which are counted, or to another module in it."""
    pair = lambda df: df.select(F.col("source").alias("at"), F.col("target").alias("to")).unionByName(df.select(F.col("target").alias("at"), F.col("source").alias("to")))
    steps = pair(graph.edges.where(F.lower(F.coalesce("edge_type", F.lit("call"))).isin(*BINDING))).where("at <> to")
    scope = None
    if parts is not None:
        own = parts.where(F.col("id") == root).select(F.col("partition_id").alias("own")).limit(1)
        scope = durable(parts.join(F.broadcast(own), F.col("partition_id") == F.col("own")).select(F.col("id").alias("at")).distinct())
        if not scope.isEmpty():  # a root of no partition is not held by any
            steps = steps.join(scope, "at", "left_semi").join(scope.withColumnRenamed("at", "to"), "to", "left_semi").select("at", "to")
        else:
            scope = None
    if runtime is not None:
        known = graph.nodes.select("id").distinct()
        seen = runtime.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi").where("source <> target")
        both = pair(seen)
        if scope is not None:
            held = both.join(scope, "at", "left_semi")
            both = held.unionByName(held.select(F.col("to").alias("at"), F.col("at").alias("to")))
        steps = steps.unionByName(both)
    steps = durable(steps.distinct())
    near = durable(graph.nodes.where(F.col("id") == root).select("id", F.lit(0).alias("depth")).limit(1))
    frontier, n = near, near.count()
    for depth in range(1, hops + 1):
        if n >= most:
            break
        new = frontier.join(steps, frontier.id == steps["at"]).select(F.col("to").alias("id")).distinct().join(near, "id", "left_anti")
        frontier = durable(new.orderBy("id").limit(most - n).withColumn("depth", F.lit(depth)))
        found = frontier.count()
        if not found:
            break
        near, n = near.unionByName(frontier), n + found
    near = durable(near)
    module = lambda c: F.split_part(F.col(c), F.lit("::"), F.lit(1))
    own_module = root.split("::")[0]
    around = steps.join(near.select(F.col("id").alias("at")), "at", "left_semi").join(near.select(F.col("id").alias("to"), F.lit(1).alias("inside")), "to", "left")
    shape = around.groupBy(F.col("at").alias("id")).agg((F.sum(F.coalesce("inside", F.lit(0))) / F.count("*")).alias("share"), F.max((F.col("to") == root) | (module("to") == own_module)).alias("by_root"))
    dense = (F.col("share") >= density) & ((module("id") == own_module) | F.col("by_root"))
    kept = durable(near.join(shape, "id", "left").where((F.col("id") == root) | F.coalesce(dense, F.lit(False))).select("id", "depth"))
    records = graph.edges.select("source", "target") if runtime is None else graph.edges.select("source", "target").unionByName(seen.select("source", "target"))
    ends = pair(records).join(kept.select(F.col("id").alias("at")), "at", "left_semi").join(kept.select(F.col("id").alias("to"), F.lit(True).alias("inside")), "to", "left")
    outside = F.col("inside").isNull()
    counts = ends.groupBy(F.col("at").alias("id")).agg(F.count_if(outside).alias("external_edges"), F.max(outside | (module("at") != module("to"))).alias("boundary"))
    return kept.join(counts, "id", "left").select("id", "depth", F.coalesce("boundary", F.lit(False)).alias("boundary"), F.coalesce("external_edges", F.lit(0)).alias("external_edges")).orderBy("depth", "id")
