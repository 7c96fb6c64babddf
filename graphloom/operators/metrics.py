"""Structural metrics: degrees, coupling, hubs, module and subsystem graphs, smells, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import CONFIDENCE_RANK, TYPE_RANK, Graph, durable, module_of, rank

from .traverse import arcs


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.when(b != 0, a / b).otherwise(0.0), digits)


def degrees(graph: Graph) -> DataFrame:
    """(id, fan_in, fan_out) of every node; edge records count."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    counts = ends.groupBy("x.id").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))
    return graph.nodes.select("id").join(counts, "id", "left").fillna(0, ["fan_in", "fan_out"])


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.5, "high").when(score >= 0.25, "medium").otherwise("low")


def risks(graph: Graph, betweenness: DataFrame | None = None) -> DataFrame:
    """(id, fan_in, fan_out, coupling_score, risk_score, level), weights 0.4 and 0.6 for coupling and
    0.3, 0.3 and 0.4 with betweenness (0 if none is given) for risk, each over its maximum."""
    d = degrees(graph)
    d = d.withColumn("betweenness", F.lit(0.0)) if betweenness is None else d.join(betweenness, "id", "left").fillna(0.0, ["betweenness"])
    top = d.agg(*(F.greatest(F.max(c).cast("double"), F.lit(0.0)).alias("m_" + c) for c in ("fan_in", "fan_out", "betweenness")))
    d = d.crossJoin(F.broadcast(top))  # one row
    share = lambda c: F.when(F.col("m_" + c) > 0, F.col(c) / F.col("m_" + c)).otherwise(0.0)
    d = d.withColumns({"coupling_score": F.round(0.4 * share("fan_in") + 0.6 * share("fan_out"), 6), "risk_score": F.round(0.3 * share("fan_in") + 0.3 * share("fan_out") + 0.4 * share("betweenness"), 6)})
    return d.select("id", "fan_in", "fan_out", "coupling_score", "risk_score", risk_level(F.col("risk_score")).alias("level")).orderBy(F.desc("risk_score"), "id")


def risk_summary(graph: Graph) -> DataFrame:
    r = risks(graph)
    return r.agg(F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"), F.round(F.avg("fan_in"), 6).alias("avg_fan_in"), F.round(F.avg("fan_out"), 6).alias("avg_fan_out"), F.round(F.avg("coupling_score"), 4).alias("avg_coupling"))


def module_coupling(graph: Graph) -> DataFrame:
    """(module, members, crossing, coupling): edge records with one end in the module over its members,
    which are its nodes and the ends of edges."""
    e = graph.edges.select("source", "target", module_of("source").alias("ms"), module_of("target").alias("mt"))
    ids = graph.nodes.select("id").unionByName(e.select(F.explode(F.array("source", "target")).alias("id"))).distinct()
    members = ids.groupBy(module_of("id").alias("module")).agg(F.count("*").alias("members"))
    crossing = e.where("ms <> mt").select(F.explode(F.array("ms", "mt")).alias("module")).groupBy("module").agg(F.count("*").alias("crossing"))
    out = members.join(crossing, "module", "left").fillna(0, ["crossing"])
    return out.withColumn("coupling", ratio(F.col("crossing"), F.greatest("members", F.lit(1))))


def module_pair_coupling(graph: Graph, least: int = 10) -> DataFrame:
    """(file_a, file_b, n, strength): pairs of files with edges either way; strength is their number over
    the outgoing ones of both, 1 for a file that has none."""
    e = graph.ends("file").where("s_file is not null and t_file is not null and s_file <> t_file")
    out = e.groupBy("s_file").agg(F.count("*").alias("n"))
    pairs = e.groupBy(F.least("s_file", "t_file").alias("file_a"), F.greatest("s_file", "t_file").alias("file_b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    a, b = out.select(F.col("s_file").alias("file_a"), F.col("n").alias("oa")), out.select(F.col("s_file").alias("file_b"), F.col("n").alias("ob"))
    pairs = pairs.join(a, "file_a", "left").join(b, "file_b", "left")
    return pairs.select("file_a", "file_b", "n", ratio(F.col("n"), F.coalesce("oa", F.lit(1)) + F.coalesce("ob", F.lit(1))).alias("strength"))


def module_graph(graph: Graph) -> DataFrame:
    """(file, functions, classes, fan_in, fan_out): all nodes, classes, and distinct other files."""
    sizes = graph.nodes.groupBy("file").agg(F.count("*").alias("functions"), F.count_if(F.col("type") == "class").alias("classes"))
    pairs = file_calls(graph).where("s_file <> t_file")
    out = pairs.groupBy(F.col("s_file").alias("file")).agg(F.count("*").alias("fan_out"))
    into = pairs.groupBy(F.col("t_file").alias("file")).agg(F.count("*").alias("fan_in"))
    return sizes.join(into, "file", "left").join(out, "file", "left").fillna(0, ["fan_in", "fan_out"])


def file_calls(graph: Graph) -> DataFrame:
    """(s_file, t_file, call_count) of ordered pairs of files."""
    e = graph.ends("file").where("s_file is not null and t_file is not null")
    return e.groupBy("s_file", "t_file").agg(F.count("*").alias("call_count"))


def subsystem_graph(graph: Graph, subsystem: Column) -> DataFrame:
    """(subsystem, internal, ext_in, ext_out, cohesion) where ``subsystem`` is an expression of ``file``."""
    named = graph.nodes.select("id", subsystem.alias("sub"))
    s, t = named.select(F.col("id").alias("source"), F.col("sub").alias("ss")), named.select(F.col("id").alias("target"), F.col("sub").alias("ts"))
    e = graph.edges.join(s, "source").join(t, "target")
    x = e.select(F.explode(F.when(F.col("ss") == F.col("ts"), F.array(F.struct(F.col("ss").alias("s"), F.lit("i").alias("k")))).otherwise(F.array(F.struct(F.col("ss").alias("s"), F.lit("o").alias("k")), F.struct(F.col("ts").alias("s"), F.lit("n").alias("k"))))).alias("x"))
    counts = x.groupBy(F.col("x.s").alias("subsystem")).agg(*(F.count_if(F.col("x.k") == k).alias(c) for k, c in (("i", "internal"), ("n", "ext_in"), ("o", "ext_out"))))
    out = named.select(F.col("sub").alias("subsystem")).distinct().join(counts, "subsystem", "left").fillna(0)
    return out.withColumn("cohesion", ratio(F.col("internal"), F.col("internal") + F.col("ext_in") + F.col("ext_out")))


def infer_subsystem(path: Column | str) -> Column:
    """The first part of a path with several, else ``root``."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, parts[0]).otherwise("root")


def god_modules(graph: Graph, least: int = 30) -> DataFrame:
    """(file, n) of files with at least ``least`` nodes; pass 31 for more than 30."""
    return graph.nodes.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def multilevel_smells(graph: Graph) -> DataFrame:
    """(smell, subject, value): large functions, modules and subsystems, wide ones and loose ones."""
    functions = degrees(graph).where("fan_out >= 20").select(F.lit("god_function").alias("smell"), F.col("id").alias("subject"), F.col("fan_out").cast("double").alias("value"))
    modules = module_graph(graph)
    god = modules.where("functions >= 30").select(F.lit("god_module").alias("smell"), F.col("file").alias("subject"), F.col("functions").cast("double").alias("value"))
    wide = modules.where("fan_out >= 15").select(F.lit("high_fanout").alias("smell"), F.col("file").alias("subject"), F.col("fan_out").cast("double").alias("value"))
    sizes = graph.nodes.groupBy(infer_subsystem("file").alias("subject")).agg(F.count("*").cast("double").alias("value")).where("value >= 300").select(F.lit("god_subsystem").alias("smell"), "subject", "value")
    loose = subsystem_graph(graph, infer_subsystem("file")).where("cohesion < 0.2 and internal + ext_in + ext_out > 5").select(F.lit("low_cohesion").alias("smell"), F.col("subsystem").alias("subject"), F.col("cohesion").alias("value"))
    return functions.unionByName(god).unionByName(wide).unionByName(sizes).unionByName(loose)


def edge_stats(graph: Graph) -> DataFrame:
    """(edge_type, confidence, n, dynamic, self_referring) for each type, each confidence and all."""
    return graph.edges.cube("edge_type", "confidence").agg(F.count("*").alias("n"), F.count_if(F.col("target").contains("::*")).alias("dynamic"), F.count_if(F.col("source") == F.col("target")).alias("self_referring")).where("edge_type is null or confidence is null")


def layer_stats(graph: Graph, layers: int = 5) -> DataFrame:
    """(layer, n, percent) of every layer, empty ones too."""
    every = graph.nodes.sparkSession.range(layers).select(F.col("id").cast("int").alias("layer"))
    counts = graph.described().groupBy("layer").agg(F.count("*").alias("n"))
    total = graph.nodes.agg(F.count("*").alias("total"))
    out = every.join(counts, "layer", "left").fillna(0, ["n"]).crossJoin(F.broadcast(total))
    return out.select("layer", "n", ratio(100 * F.col("n"), F.col("total"), 4).alias("percent"))


def dedup_edges(graph: Graph) -> DataFrame:
    return graph.edges.dropDuplicates(["source", "target", "edge_type", "confidence"])


def best_edges(graph: Graph) -> DataFrame:
    """For each (source, target) the record of highest confidence, then type; then the first by name."""
    order = F.struct(rank("confidence", CONFIDENCE_RANK).alias("c"), rank("edge_type", TYPE_RANK).alias("t"))
    top = graph.edges.groupBy("source", "target", "edge_type", "confidence").agg(F.count("*").alias("n")).withColumn("o", order)
    w = Window.partitionBy("source", "target").orderBy(F.desc("o"), "edge_type", "confidence")
    return top.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "target", "edge_type", "confidence")


def compress(graph: Graph, by=module_of) -> DataFrame:
    """Edges between modules, or other groups of ids, with the first record by type of each pair."""
    e = graph.edges.select(by("source").alias("source"), by("target").alias("target"), "edge_type", "confidence")
    return e.groupBy("source", "target").agg(F.min(F.struct("edge_type", "confidence")).alias("m")).select("source", "target", "m.edge_type", "m.confidence")


def class_of(node_id: str) -> Column:
    """The class of a method's id, else the module."""
    parts = F.split(node_id, "::")
    return F.when(F.size(parts) >= 3, F.concat_ws("::", parts[0], parts[1])).otherwise(parts[0])


#: Rows (origin, node) that one slice of origins may make on its way, and slices at most.
SLICE_ROWS, SLICES = 200_000_000, 64
#: Rows of one task of a slice, about.
PIECE_ROWS = 500_000


def reach3(graph: Graph) -> DataFrame:
    """(id, reach): distinct other nodes at most three steps ahead.

    What a node calls itself is counted where its arcs lie. Only two more steps are walked, and only through
    nodes that are called and call: those that call the same nodes are one class, known by 128 bits of hashes of
    its targets, and classes walk in place of nodes. A node meets its own targets again only among those that a
    class calls, so only these of them are held against what it reaches. Origins walk in slices by hash, as many
    as keep the rows that their steps can make, which are counted beforehand, near SLICE_ROWS; each slice is
    counted and dropped before the next, so pairs of nodes are never held for all at once."""
    s = durable(graph.edges.select(F.col("source").alias("at"), F.col("target").alias("to")).repartition("at").distinct())
    own = s.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("at") != F.col("to")).alias("direct"), *(F.bit_xor(F.xxhash64("to", F.lit(k))).alias(f"h{k}") for k in (1, 2)))
    between = durable(own.join(s.select(F.col("to").alias("id")).distinct(), "id", "left_semi"))
    key = ["n", "h1", "h2"]
    classes = durable(between.join(between.groupBy(key).agg(F.min("id").alias("class")), key).select("id", "class"))
    walks = durable(s.join(classes.select("class").distinct(), F.col("at") == F.col("class")).select("class", F.col("to").alias("node")))
    ahead = durable(walks.join(classes.select(F.col("id").alias("node"), F.col("class").alias("next")), "node").select("class", "next").distinct())
    again = walks.select(F.col("node").alias("to")).distinct().withColumn("again", F.lit(True))
    met = s.join(classes.withColumnRenamed("id", "to"), "to", "left").join(again, "to", "left").where("class is not null or again")
    met = durable(met.select("at", "class", F.when(F.col("again"), F.col("to")).alias("to")))
    sizes = durable(walks.groupBy("class").agg(F.count("*").alias("one")))
    two = ahead.join(sizes.withColumnRenamed("class", "next"), "next").groupBy("class").agg(F.sum("one").alias("two"))
    most = met.groupBy("class").agg(F.count("*").alias("arcs")).join(sizes, "class").join(two, "class", "left").agg(F.sum(F.col("arcs") * (F.col("one") + F.coalesce("two", F.lit(0))))).head()[0] or 0
    slices = max(1, min(SLICES, -(-int(most) // SLICE_ROWS)))
    # so many pieces that one holds PIECE_ROWS at most: rows pack well, and pieces of equal bytes would hold too many
    pieces = 1 + min(int(most) // slices, 4 * SLICE_ROWS) // PIECE_ROWS
    counted = None
    for k in range(slices):
        mine = met.where(F.pmod(F.xxhash64("at"), F.lit(slices)) == k) if slices > 1 else met
        one = mine.where("class is not null").select("at", "class").repartition(pieces, "at").distinct()
        through = one.join(ahead, "class", "left").select("at", F.explode(F.array("class", "next")).alias("class")).where("class is not null").distinct()
        reached = through.join(walks, "class").select("at", F.col("node").alias("to"), F.lit(0).alias("direct")).distinct()
        known = mine.where("to is not null").select("at", "to", F.lit(1).alias("direct"))
        pairs = reached.unionByName(known).where("at <> to").repartition(pieces, "at").groupBy("at", "to").agg(F.max("direct").alias("direct"))
        part = pairs.groupBy(F.col("at").alias("id")).agg(F.count_if(F.col("direct") == 0).alias("more"))
        part = durable(part) if slices > 1 else part
        counted = part if counted is None else counted.unionByName(part)
    out = graph.nodes.select("id").join(own.select("id", "direct"), "id", "left").join(counted, "id", "left")
    return out.select("id", (F.coalesce("direct", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("reach"))


def hubs(graph: Graph, band: float = 0.1) -> DataFrame:
    """(id, fan_in, fan_out, reach, score): the tenth of nodes with most, those equal to the last too."""
    d = durable(degrees(graph).join(reach3(graph), "id").withColumn("score", F.col("fan_in") + F.col("fan_out") + F.col("reach")))
    scores = d.groupBy("score").agg(F.count("*").alias("n"))
    # the rank of a score is the number of nodes above it; distinct scores are few next to nodes
    above = scores.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    total = d.agg(F.ceil(F.count("*") * F.lit(band)).alias("most"))
    cut = above.crossJoin(F.broadcast(total)).where("above < most and score > 0").agg(F.min("score").alias("least"))
    return d.crossJoin(F.broadcast(cut)).where("score >= least").drop("least").orderBy(F.desc("score"), "id")


def p95(values: DataFrame, column: str) -> DataFrame:
    """One row: the element at floor((n - 1) * 0.95) of the ascending values. Equal values are counted
    before they are ordered."""
    counts = values.groupBy(F.col(column).alias("p95")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("p95").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = values.agg(F.floor((F.count("*") - 1) * 0.95).alias("at"))
    return upto.crossJoin(F.broadcast(total)).where("upto > at").agg(F.min("p95").alias("p95"))


def distribution(values: DataFrame, column: str) -> DataFrame:
    """(value, n): how many have each value."""
    return values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def entropy(values: DataFrame, column: str) -> DataFrame:
    """One row: base-2 entropy of the shares of a non-negative column."""
    x = values.where(F.col(column) > 0)
    total = x.agg(F.sum(column).alias("total"))
    p = F.col(column) / F.col("total")
    return x.crossJoin(F.broadcast(total)).agg(F.round(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)), 6).alias("entropy"))


def architecture_smells(graph: Graph, forbidden: list[tuple[str, str]] = ()) -> DataFrame:
    """(smell, subject, severity): god modules, hotspots, edges to higher layers, services without edges,
    forbidden dependencies and cycles."""
    from .components import cycles
    from .lookup import matches

    row = lambda df, smell, subject, severity: df.select(F.lit(smell).alias("smell"), subject.alias("subject"), severity.alias("severity"))
    warning, error = F.lit("warning"), F.lit("error")
    out = row(god_modules(graph, 31), "god_module", F.col("file"), warning)
    hot = degrees(graph).where("fan_in >= 30")
    out = out.unionByName(row(hot, "fan_in_hotspot", F.col("id"), F.when(F.col("fan_in") >= 45, "error").otherwise("warning")))
    pair = F.concat_ws(" -> ", "source", "target")
    up = graph.ends("layer").where("s_layer < t_layer").select("source", "target").distinct()
    out = out.unionByName(row(up, "cross_layer", pair, error))
    touched = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    lost = graph.described().where("arch_layer = 'service'").join(touched, "id", "left_anti")
    out = out.unionByName(row(lost, "orphan_service", F.col("id"), warning))
    for a, b in forbidden:
        hit = graph.edges.where(matches("source", a) & matches("target", b)).select("source", "target").distinct()
        out = out.unionByName(row(hit, "forbidden_dependency", pair, error))
    return out.unionByName(row(cycles(graph), "dependency_cycle", F.col("members"), error))
