"""Health, scores, patterns, decay and candidates: compositions of the other metrics as one-row tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, durable, module_of

from .components import cycles, strong_components
from .metrics import compress, degrees, distribution, entropy, infer_subsystem, p95, ratio, subsystem_graph
from .policy import layer_violations


def one_row(*rows: DataFrame) -> DataFrame:
    """The columns of several one-row tables side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)


def health(graph: Graph) -> DataFrame:
    """One row: orphans, layer violations, services that none calls, cycles, entropy of fan-in, variances."""
    d = degrees(graph)
    base = d.join(graph.described().select("id", "type", "arch_layer"), "id").agg(
        F.count("*").alias("nodes"),
        F.count_if((F.col("fan_in") + F.col("fan_out") == 0) & (F.col("type") != "module")).alias("orphans"),
        F.count_if((F.col("arch_layer") == "service") & (F.col("fan_in") == 0)).alias("unused_services"),
        F.round(F.coalesce(F.var_pop("fan_in"), F.lit(0.0)), 6).alias("fan_in_variance"),
        F.round(F.coalesce(F.var_pop("fan_out"), F.lit(0.0)), 6).alias("fan_out_variance"),
    )
    up = graph.ends("layer").agg(F.count_if(F.col("s_layer") < F.col("t_layer")).alias("layer_violations"))
    n_cycles = strong_components(graph.edges).agg(F.countDistinct("component").alias("cycles"))
    return one_row(base, up, n_cycles, entropy(d, "fan_in").withColumnRenamed("entropy", "fan_in_entropy"))


def fan_distribution(graph: Graph) -> DataFrame:
    d = degrees(graph)
    return distribution(d, "fan_in").withColumn("metric", F.lit("fan_in")).unionByName(distribution(d, "fan_out").withColumn("metric", F.lit("fan_out")))


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.65, "C").when(score >= 0.5, "D").otherwise("F")


def architecture_score(graph: Graph, drift: float = 0.0) -> DataFrame:
    """One row: cohesion, coupling, layers, cycles, their weighted score and its grade. Coupling is that of
    the node a twentieth from the top, against 50 edges; cycles are counted against 5."""
    e = graph.ends("layer")
    base = e.agg(
        F.count("*").alias("edges"),
        F.count_if(module_of("source") == module_of("target")).alias("internal"),
        F.count_if(F.col("s_layer") < F.col("t_layer")).alias("upward"),
    )
    d = degrees(graph).select((F.col("fan_in") + F.col("fan_out")).alias("coupling")).where("coupling > 0")
    top = d.groupBy("coupling").agg(F.count("*").alias("n"))
    total = d.agg(F.floor(F.count("*") * 0.05).alias("at"))
    from pyspark.sql import Window

    upto = top.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("coupling")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    typical = upto.crossJoin(F.broadcast(total)).where("upto > at").agg(F.coalesce(F.max("coupling"), F.lit(0)).alias("typical"))
    n_cycles = strong_components(graph.edges).agg(F.countDistinct("component").alias("cycles"))
    r = one_row(base, typical, n_cycles)
    most = F.greatest("edges", F.lit(1))
    r = r.select(
        F.round(F.col("internal") / most, 6).alias("cohesion"),
        F.round(1 - F.least(F.lit(1.0), F.col("typical") / 50.0), 6).alias("coupling"),
        F.round(1 - F.least(F.lit(1.0), F.col("upward") / most), 6).alias("layers"),
        F.round(1 - F.least(F.lit(1.0), F.col("cycles") / 5.0), 6).alias("cycles"),
    )
    score = F.round(0.25 * F.col("cohesion") + 0.25 * F.col("coupling") + 0.20 * F.col("layers") + 0.20 * F.col("cycles") + 0.10 * (1.0 - drift), 4)
    return r.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def project_health(counts: DataFrame) -> DataFrame:
    """One row with health_score, from a row of nodes, intents, violations, stale and dead."""
    n = F.greatest("nodes", F.lit(1))
    part = lambda c: F.greatest(F.lit(0.0), 1 - F.col(c) / n)
    coverage = F.when(F.col("nodes") == 0, 1.0).otherwise(F.col("intents") / n)
    return counts.withColumn("health_score", F.round(0.4 * coverage + 0.3 * part("violations") + 0.2 * part("stale") + 0.1 * part("dead"), 3))


def decay(graph: Graph, most_fan: int = 20, most_cycle: int = 3) -> DataFrame:
    """(finding, subject, value): modules that over 20 others call or are called by, cycles of more than 3
    nodes, and the number of module pairs per module."""
    m = compress(graph).where("source <> target").select("source", "target")
    fans = m.groupBy(F.col("source").alias("subject")).agg(F.count("*").alias("n")).unionByName(m.groupBy(F.col("target").alias("subject")).agg(F.count("*").alias("n")))
    god = fans.groupBy("subject").agg(F.max("n").cast("double").alias("value")).where(F.col("value") > most_fan).select(F.lit("god_module").alias("finding"), "subject", "value")
    long = cycles(graph).where(F.col("size") > most_cycle).select(F.lit("large_cycle").alias("finding"), F.col("cycle_id").alias("subject"), F.col("size").cast("double").alias("value"))
    modules = graph.nodes.agg(F.countDistinct(module_of("id")).alias("modules"))
    index = m.agg(F.count("*").alias("pairs")).crossJoin(modules).select(F.lit("coupling_index").alias("finding"), F.lit("").alias("subject"), ratio(F.col("pairs"), F.col("modules")).alias("value"))
    return god.unionByName(long).unionByName(index)


def service_candidates(graph: Graph, least_cohesion: float = 0.8, most_external: float = 0.2) -> DataFrame:
    """(subsystem, size, cohesion, external, api, confidence): groups that could stand alone; api is the
    number of their nodes that others call."""
    sub = infer_subsystem("file")
    g = subsystem_graph(graph, sub)
    sizes = graph.nodes.groupBy(sub.alias("subsystem")).agg(F.count("*").alias("size"))
    s = graph.ends("file").select(infer_subsystem("s_file").alias("a"), infer_subsystem("t_file").alias("b"), "target").where("a <> b")
    api = s.groupBy(F.col("b").alias("subsystem")).agg(F.countDistinct("target").alias("api"))
    r = g.join(sizes, "subsystem").join(api, "subsystem", "left").fillna(0, ["api"])
    r = r.withColumn("external", ratio(F.col("ext_in") + F.col("ext_out"), F.col("size")))
    r = r.where((F.col("size") > 2) & (F.col("cohesion") >= least_cohesion) & (F.col("external") <= most_external) & (F.col("api") > 0))
    return r.select("subsystem", "size", "cohesion", "external", "api", F.round(0.7 * F.col("cohesion") + 0.3 * (1 - F.col("external")), 6).alias("confidence"))


def inversions(graph: Graph, least_fan: int = 1) -> DataFrame:
    """(source, target, fan_in): pairs of modules in which the lower layer calls the higher, and in how many
    modules the target is used."""
    up = layer_violations(graph).select(module_of("source").alias("source"), module_of("target").alias("target")).distinct()
    fan = compress(graph).where("source <> target").groupBy("target").agg(F.count("*").alias("fan_in"))
    return up.join(fan, "target").where(F.col("fan_in") >= least_fan).select("source", "target", "fan_in")


def bidirectional(graph: Graph, by=module_of) -> DataFrame:
    """(a, b): groups that call each other."""
    m = compress(graph, by).where("source < target").select("source", "target")
    back = compress(graph, by).where("source > target").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return m.join(back, ["source", "target"]).select(F.col("source").alias("a"), F.col("target").alias("b"))


#: Tokens in ids by which event-driven parts and other styles are known.
EVENT_TOKENS = r"(?i)(event|handler|listener|subscriber|publisher|dispatch|emit|queue|bus)"
STYLE_TOKENS = {"mvc": r"(?i)(model|view|controller)", "clean": r"(?i)(usecase|entity|gateway|interactor)", "hexagonal": r"(?i)(port|adapter)", "microservice": r"(?i)(service|client|api)"}


def patterns(graph: Graph) -> DataFrame:
    """(pattern, share): layered, the edges that go down or stay; event_driven, the modules named so;
    pipeline, the modules with at most one predecessor and successor; bidirectional, the pairs that call
    each other; and the styles by tokens in modules."""
    m = durable(compress(graph).where("source <> target").select("source", "target"))
    layered = graph.ends("layer").agg(F.lit("layered").alias("pattern"), ratio(F.count_if(F.col("s_layer") >= F.col("t_layer")), F.count("*")).alias("share"))
    modules = graph.nodes.select(module_of("id").alias("module")).distinct()
    named = lambda name, tokens: modules.agg(F.lit(name).alias("pattern"), ratio(F.count_if(F.col("module").rlike(tokens)), F.count("*")).alias("share"))
    outs, ins = m.groupBy(F.col("source").alias("module")).agg(F.count("*").alias("o")), m.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("i"))
    fans = modules.join(outs, "module", "left").join(ins, "module", "left").fillna(0)
    pipeline = fans.agg(F.lit("pipeline").alias("pattern"), ratio(F.count_if((F.col("o") <= 1) & (F.col("i") <= 1) & (F.col("o") + F.col("i") > 0)), F.count("*")).alias("share"))
    both = bidirectional(graph).agg(F.count("*").alias("n")).crossJoin(m.agg(F.countDistinct(F.struct(F.least("source", "target"), F.greatest("source", "target"))).alias("pairs")))
    both = both.select(F.lit("bidirectional").alias("pattern"), ratio(F.col("n"), F.col("pairs")).alias("share"))
    out = layered.unionByName(named("event_driven", EVENT_TOKENS)).unionByName(pipeline).unionByName(both)
    for name, tokens in STYLE_TOKENS.items():
        out = out.unionByName(named(name, tokens))
    return out


def hotspots(graph: Graph, stale: DataFrame, most: int = 10) -> DataFrame:
    """(module, stale): modules with most stale(id) nodes."""
    return stale.groupBy(module_of("id").alias("module")).agg(F.count("*").alias("stale")).orderBy(F.desc("stale"), "module").limit(most)


def wide_nodes(graph: Graph, least: int = 10, most: int = 15) -> DataFrame:
    return degrees(graph).where(F.col("fan_out") > least).select("id", "fan_out").orderBy(F.desc("fan_out"), "id").limit(most)


def hidden_coupling(graph: Graph, least: int = 2) -> DataFrame:
    """(a, b, shared): files that do not call each other and call the same others. A file called by very
    many is taken through its distinct callers."""
    p = durable(graph.ends("file").where("s_file <> t_file").select(F.col("s_file").alias("f"), F.col("t_file").alias("used")).distinct())
    pairs = p.alias("x").join(p.alias("y"), "used").where("x.f < y.f").groupBy(F.col("x.f").alias("a"), F.col("y.f").alias("b")).agg(F.count("*").alias("shared"))
    direct = p.select(F.least("f", "used").alias("a"), F.greatest("f", "used").alias("b")).distinct()
    return pairs.where(F.col("shared") >= least).join(direct, ["a", "b"], "left_anti")
