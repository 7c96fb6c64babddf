"""Rules, locks, drift and intent: policies as semi, anti and theta joins.

Rule tables have the columns id, type, source, target (globs), source_layer, target_layer,
source_arch_layer, target_arch_layer, max_fan_in, max_fan_out. The globs of rules become regular
expressions in the rule table; rules are few, so the rule side is what Spark copies to all tasks as
long as it is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph

from .lookup import glob_regex
from .metrics import degrees
from .traverse import pattern_paths, reach, arcs

COLUMNS = "id string, type string, source string, target string, source_layer int, target_layer int, source_arch_layer string, target_arch_layer string, max_fan_in int, max_fan_out int"


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = [tuple(r.get(n) for n in names) + tuple(glob_regex(r[n]) if r.get(n) else None for n in ("source", "target")) for r in rules]
    return spark.createDataFrame(rows, COLUMNS + ", source_re string, target_re string")


def _scope(side: str, node: str = "n") -> Column:
    """Whether a node is in the scope of one side of a rule; a side without any condition has none."""
    given = [F.col(side + "_re"), F.col(side + "_layer"), F.col(side + "_arch_layer")]
    conditions = [F.regexp_like(F.col(f"{node}.id"), F.col(side + "_re")), F.col(f"{node}.layer") == F.col(side + "_layer"), F.col(f"{node}.arch_layer") == F.col(side + "_arch_layer")]
    fits = F.lit(True)
    for g, c in zip(given, conditions, strict=True):
        fits = fits & (g.isNull() | c)
    return fits & F.coalesce(*(g.cast("string") for g in given)).isNotNull()


def expand(graph: Graph, rules: DataFrame, side: str) -> DataFrame:
    """(rule_id, id): nodes in the scope of one side of each rule."""
    r = rules.select(F.col("id").alias("rule_id"), side + "_re", side + "_layer", side + "_arch_layer")
    return graph.described().alias("n").join(r, _scope(side)).select("rule_id", "n.id")


def forbidden_calls(graph: Graph, rules: DataFrame) -> DataFrame:
    """(rule_id, source, target): distinct edges that a forbidden_call or layer_boundary rule names."""
    some = rules.where("type in ('forbidden_call', 'layer_boundary')")
    s = expand(graph, some, "source").withColumnRenamed("id", "source")
    t = expand(graph, some, "target").withColumnRenamed("id", "target")
    e = graph.edges.select("source", "target").distinct()
    return e.join(s, "source").join(t, ["rule_id", "target"]).select("rule_id", "source", "target")


def missing_calls(graph: Graph, rules: DataFrame) -> DataFrame:
    """(rule_id, source): nodes of a required_call rule that call none of its targets."""
    some = rules.where("type = 'required_call'")
    s = expand(graph, some, "source").withColumnRenamed("id", "source")
    t = expand(graph, some, "target").withColumnRenamed("id", "target")
    met = graph.edges.select("source", "target").distinct().join(s, "source").join(t, ["rule_id", "target"]).select("rule_id", "source").distinct()
    return s.join(met, ["rule_id", "source"], "left_anti")


def required_pairs_missing(graph: Graph, rules: DataFrame) -> DataFrame:
    """(rule_id, source, target): every pair that a required_call rule asks for and no edge has. The pairs
    are those that the rule itself lists."""
    some = rules.where("type = 'required_call'")
    pairs = expand(graph, some, "source").withColumnRenamed("id", "source").join(expand(graph, some, "target").withColumnRenamed("id", "target"), "rule_id").where("source <> target")
    return pairs.join(graph.edges.select("source", "target").distinct(), ["source", "target"], "left_anti").select("rule_id", "source", "target")


def forbidden_paths(graph: Graph, rules: list[dict], depth: int = 20) -> DataFrame:
    """(rule_id, origin, hops, path): paths that forbidden_path rules exclude, five for a rule."""
    out = None
    for r in rules:
        if r["type"] == "forbidden_path":
            found = pattern_paths(graph, r["source"], r["target"], depth, 5).select(F.lit(r["id"]).alias("rule_id"), "origin", "hops", F.array_join("path", " -> ").alias("path"))
            out = found if out is None else out.unionByName(found)
    return out


def fan_violations(graph: Graph, rules: DataFrame) -> DataFrame:
    """(rule_id, id, metric, value, most): nodes over the fan limits of dependency_limit rules."""
    some = rules.where("type = 'dependency_limit'")
    d = degrees(graph).join(expand(graph, some, "source"), "id").join(some.select(F.col("id").alias("rule_id"), "max_fan_in", "max_fan_out"), "rule_id")
    each = F.explode(F.array(F.struct(F.lit("fan_in").alias("metric"), F.col("fan_in").alias("value"), F.col("max_fan_in").alias("most")), F.struct(F.lit("fan_out").alias("metric"), F.col("fan_out").alias("value"), F.col("max_fan_out").alias("most"))))
    return d.select("rule_id", "id", each.alias("x")).select("rule_id", "id", "x.*").where("value > most")


def dangling_rules(graph: Graph, rules: DataFrame) -> DataFrame:
    """(rule_id, side): sides of rules that name something and match no node."""
    out = None
    for side in ("source", "target"):
        named = rules.where(F.coalesce(F.col(side), F.col(side + "_layer").cast("string"), F.col(side + "_arch_layer")).isNotNull()).select(F.col("id").alias("rule_id"))
        lost = named.join(expand(graph, rules, side).select("rule_id").distinct(), "rule_id", "left_anti").withColumn("side", F.lit(side))
        out = lost if out is None else out.unionByName(lost)
    return out


def conflicting_rules(rules: DataFrame) -> DataFrame:
    """(a, b): a required and a forbidden rule with equal sides."""
    a, b = rules.where("type = 'required_call'").alias("a"), rules.where("type = 'forbidden_call'").alias("b")
    same = F.lit(True)
    for c in ("source", "target", "source_layer", "target_layer", "source_arch_layer", "target_arch_layer"):
        same = same & F.col("a." + c).eqNullSafe(F.col("b." + c))
    return a.join(b, same).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def circular_rules(rules: DataFrame) -> DataFrame:
    """(a, b): two required rules that are each other's reverse."""
    a, b = rules.where("type = 'required_call'").alias("a"), rules.where("type = 'required_call'").alias("b")
    return a.join(b, (F.col("a.source") == F.col("b.target")) & (F.col("a.target") == F.col("b.source")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def rule_status(graph: Graph, rules: DataFrame) -> DataFrame:
    """(rule_id, type, violations, status): satisfied, violated, or dangling."""
    bad = forbidden_calls(graph, rules).select("rule_id").unionByName(missing_calls(graph, rules).select("rule_id")).unionByName(fan_violations(graph, rules).select("rule_id"))
    counts = bad.groupBy("rule_id").agg(F.count("*").alias("violations"))
    lost = dangling_rules(graph, rules).select("rule_id").distinct().withColumn("lost", F.lit(True))
    out = rules.select(F.col("id").alias("rule_id"), "type").join(counts, "rule_id", "left").join(lost, "rule_id", "left").fillna(0, ["violations"])
    return out.select("rule_id", "type", "violations", F.when(F.col("lost"), "dangling").when(F.col("violations") > 0, "violated").otherwise("satisfied").alias("status"))


def layer_violations(graph: Graph) -> DataFrame:
    """(source, target, s_layer, t_layer): distinct edges from a lower to a higher layer."""
    return graph.ends("layer").where("s_layer < t_layer").select("source", "target", "s_layer", "t_layer").distinct()


def transitive_layer_violations(graph: Graph, depth: int = 3) -> DataFrame:
    """(origin, node): pairs within some hops that lead from a lower to a higher layer."""
    seeds = graph.nodes.select(F.col("id").alias("origin"), F.col("id").alias("node"))
    own = graph.described().select(F.col("id").alias("origin"), F.col("layer").alias("lo"))
    found = reach(arcs(graph.edges), seeds, depth).join(own, "origin").join(own.select(F.col("origin").alias("node"), F.col("lo").alias("ln")), "node")
    return found.where("lo < ln").select("origin", "node")


def dependency_drift(graph: Graph, declared: DataFrame) -> DataFrame:
    """(source, target, finding): pairs of files that call each other undeclared, and declared(source,
    target) ones that do not."""
    actual = graph.ends("file").where("s_file is not null and t_file is not null and s_file <> t_file").select(F.col("s_file").alias("source"), F.col("t_file").alias("target")).distinct()
    a = actual.join(declared, ["source", "target"], "left_anti").withColumn("finding", F.lit("undeclared"))
    return a.unionByName(declared.select("source", "target").distinct().join(actual, ["source", "target"], "left_anti").withColumn("finding", F.lit("missing")))


def module_drift(graph: Graph, declared: DataFrame) -> DataFrame:
    """(module, finding): files that are not declared(module), and declared ones without nodes."""
    actual = graph.nodes.select(F.col("file").alias("module")).distinct()
    a = actual.join(declared, "module", "left_anti").withColumn("finding", F.lit("undeclared"))
    return a.unionByName(declared.select("module").distinct().join(actual, "module", "left_anti").withColumn("finding", F.lit("missing")))


def drift_score(findings: DataFrame, checks: int) -> DataFrame:
    return findings.agg(F.round(F.count("*") / max(1, checks), 6).alias("drift_score"))


def intent_violations(graph: Graph, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(source, target, from_layer, to_layer): distinct edges between declared layers (layer, prefix of
    files) that no rule (from_layer, to_layer) allows. A file is in the first layer by name that fits."""
    files = graph.nodes.select("file").distinct()
    own = files.join(layers, F.col("file").startswith(F.col("prefix"))).groupBy("file").agg(F.min("layer").alias("declared"))
    e = graph.ends("file").join(own.select(F.col("file").alias("s_file"), F.col("declared").alias("from_layer")), "s_file").join(own.select(F.col("file").alias("t_file"), F.col("declared").alias("to_layer")), "t_file")
    return e.where("from_layer <> to_layer").select("source", "target", "from_layer", "to_layer").distinct().join(allowed, ["from_layer", "to_layer"], "left_anti").select("source", "target", "from_layer", "to_layer")


def lock_check(graph: Graph, locked: DataFrame) -> DataFrame:
    """(source, target): pairs of modules that call each other and are not in the locked(source, target)."""
    from .metrics import compress

    return compress(graph).where("source <> target").select("source", "target").join(locked, ["source", "target"], "left_anti")


def lock_report(graph: Graph, modules: DataFrame, links: DataFrame, constraints: DataFrame, strict: bool = False) -> DataFrame:
    """(violation_type, severity, module, subsystem, other) of a graph against a declared architecture:
    modules (subsystem, module), links (source, target) between subsystems that are allowed, constraints
    (source, target, type). Undeclared modules are files that are not declared and lie in no folder of a
    declared one, an error if ``strict``; forbidden dependencies are pairs of files whose subsystems a
    forbidden constraint names, errors; boundary violations are pairs of subsystems that call each other
    without a link, given with the first pair of files. A module declared twice is of the first subsystem."""
    own = modules.groupBy("module").agg(F.min("subsystem").alias("subsystem"))
    files = graph.nodes.select(F.col("file").alias("module")).where("module is not null").distinct()
    folders = own.where(F.col("module").contains("/")).select(F.regexp_extract("module", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    parts = F.split("module", "/")
    above = F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    known = files.select("module", F.explode(above).alias("folder")).join(folders, "folder", "left_semi").select("module").distinct()
    none = F.lit(None).cast("string")
    out = files.join(own, "module", "left_anti").join(known, "module", "left_anti").select(F.lit("undeclared_module").alias("violation_type"), F.lit("error" if strict else "warning").alias("severity"), "module", none.alias("subsystem"), none.alias("other"))
    pairs = graph.ends("file").where("s_file <> t_file").select("s_file", "t_file").distinct()
    a, b = own.select(F.col("module").alias("s_file"), F.col("subsystem").alias("sa")), own.select(F.col("module").alias("t_file"), F.col("subsystem").alias("sb"))
    across = pairs.join(a, "s_file").join(b, "t_file").where("sa <> sb")
    denied = constraints.where("type = 'forbidden'").select(F.col("source").alias("sa"), F.col("target").alias("sb"))
    forbidden = across.join(denied, ["sa", "sb"]).select(F.lit("forbidden_dependency").alias("violation_type"), F.lit("error").alias("severity"), F.col("s_file").alias("module"), F.col("sa").alias("subsystem"), F.col("t_file").alias("other"))
    open_ = across.join(links.select(F.col("source").alias("sa"), F.col("target").alias("sb")), ["sa", "sb"], "left_anti").groupBy("sa", "sb").agg(F.min(F.struct("s_file", "t_file")).alias("first"))
    boundary = open_.select(F.lit("boundary_violation").alias("violation_type"), F.lit("warning").alias("severity"), F.col("first.s_file").alias("module"), F.col("sa").alias("subsystem"), F.col("sb").alias("other"))
    return out.unionByName(forbidden).unionByName(boundary)


def orphan_classes(graph: Graph) -> DataFrame:
    """(id, classification) of nodes without edges: entry_point, disconnected, new_code or dead_code."""
    from .traverse import orphans

    n = graph.nodes.join(orphans(graph), "id", "left_semi")
    notes = graph.annotations
    has = lambda c: F.col(c) if notes is not None and c in notes.columns else F.lit(None).cast("string")
    n = n.select("id", "type", "body_hash") if notes is None else n.select("id", "type", "body_hash").join(notes.select("id", has("intent").alias("intent"), has("intent_body_hash").alias("ibh")), "id", "left")
    if notes is None:
        n = n.withColumns({"intent": F.lit(None).cast("string"), "ibh": F.lit(None).cast("string")})
    entry = F.lower("id").rlike(r"(^|::)(test_|conftest|__main__)|::(main|cli|app)$")
    kind = F.when(entry, "entry_point").when(F.col("type") == "class", "disconnected").when(F.coalesce("intent", F.lit("")) != "", "disconnected").when(F.col("ibh") != F.col("body_hash"), "new_code").otherwise("dead_code")
    return n.select("id", kind.alias("classification"))


def dead_code(graph: Graph, imported: DataFrame, configured: DataFrame, tested: DataFrame) -> DataFrame:
    """Nodes without an incoming edge, import(id), configuration reference(id) and test(id)."""
    called = graph.edges.select(F.col("target").alias("id"))
    out = graph.nodes.where("type <> 'module'")
    for known in (called, imported, configured, tested):
        out = out.join(known.select("id").distinct(), "id", "left_anti")
    return out.select("id")


def coverage_gaps(graph: Graph, test_layer: int = 4) -> DataFrame:
    """(id, gap): nodes that no test calls, no_test, or that tests reach through others, indirect_only."""
    from .lookup import test_pairs

    direct = test_pairs(graph, test_layer).select(F.col("node_id").alias("id")).distinct()
    tests = graph.described().where(F.col("layer") == test_layer).select(F.lit("").alias("origin"), F.col("id").alias("node"))
    reached = reach(arcs(graph.edges), tests).select(F.col("node").alias("id"), F.lit(True).alias("reached"))
    n = graph.described().where(F.col("layer") != test_layer).where("type <> 'module'").join(direct, "id", "left_anti").join(reached, "id", "left")
    return n.select("id", F.when(F.col("reached"), "indirect_only").otherwise("no_test").alias("gap"))


#: Priority of tasks by kind of finding.
PRIORITY = {"layer_violation": 1, "cycle": 1, "forbidden_call": 1, "dead_code": 3, "missing_intent": 2, "no_test": 2}


def tasks(findings: DataFrame) -> DataFrame:
    """(kind, n, priority, first) of findings (kind, id), most urgent first."""
    p = F.lit(4)
    for kind, value in PRIORITY.items():
        p = F.when(F.col("kind") == kind, value).otherwise(p)
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("priority", p).orderBy("priority", "kind")
