"""Tables of semantic nodes: their rules, summaries and changes, and the edges they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import action_of, behaviour_hash, contract_name, domains_of, effect_rows, sql_operations_of
from graphloom.graph import Graph, last_segment, module_of


def describe(sources: DataFrame) -> DataFrame:
    """Semantics of sources (id, file, body): actions by the name, and effects, tags and SQL by the text."""
    name = last_segment("id")
    return sources.select(
        "id",
        F.array(F.struct(name.alias("verb"), F.lit("").alias("object"), action_of(name).alias("action_type"))).alias("actions"),
        F.transform(F.regexp_extract_all("body", F.lit(r"if\s+([^:\n]+):\s*(?:raise|return)"), F.lit(1)), lambda c: F.struct(c.alias("condition"), F.lit("").alias("raises"))).alias("guards"),
        effect_rows("body").alias("side_effects"),
        domains_of(F.concat_ws(" ", name, "file")).alias("domain_tags"),
        F.array().cast("array<string>").alias("library_calls"),
        sql_operations_of("body").alias("sql_operations"),
    )


def _has(effect: str):
    return F.exists("side_effects", lambda e: e["effect_type"] == effect)


def rule_findings(semantics: DataFrame) -> DataFrame:
    """(rule, id, severity): database writes without guards, network calls without a guard that raises,
    file writes without logging."""
    raises = F.exists("guards", lambda g: F.coalesce(g["raises"], F.lit("")) != "")
    rules = (
        ("db-write-no-guard", "warning", _has("database_write") & (F.size("guards") == 0)),
        ("network-no-error-handling", "info", _has("network_call") & ~raises),
        ("file-write-no-logging", "info", _has("file_write") & ~_has("logging")),
    )
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in rules)))
    return semantics.select("id", F.explode(found).alias("f")).select("f.rule", "id", "f.severity")


def summary(semantics: DataFrame) -> DataFrame:
    """(kind, value, n): how often each action, effect and tag occurs, an effect by each of its names."""
    tagged = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    every = F.concat(tagged("action", F.transform("actions", lambda a: a["action_type"])), tagged("effect", F.transform("side_effects", lambda e: e["effect_type"])), tagged("tag", F.col("domain_tags")))
    return semantics.select(F.explode(every).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def with_hash(semantics: DataFrame) -> DataFrame:
    tag = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    parts = [tag("a:", F.transform("actions", lambda a: a["action_type"])), tag("e:", F.transform("side_effects", lambda e: e["effect_type"])), tag("g:", F.transform("guards", lambda g: g["condition"])), tag("t:", F.col("domain_tags"))]
    return semantics.withColumn("behavior_hash", behaviour_hash(*parts))


def behaviour_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) of nodes whose behaviour is added, removed or modified."""
    from .diff import diff

    return diff(with_hash(old), with_hash(new), ["id"], ["behavior_hash"]).where("change <> 'unchanged'")


def context_flows(graph: Graph, semantics: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Edges that semantics imply and the graph lacks: control flow to the objects of actions, side effects
    to their targets, data flow to outputs(id, output); names without a module are of the node's own."""
    to = lambda name: F.when(name.contains("::"), name).otherwise(F.concat(module_of("id"), F.lit("::"), name))
    row = lambda df, name, kind: df.where(F.coalesce(name, F.lit("")) != "").select(F.col("id").alias("source"), to(name).alias("target"), F.lit(kind).alias("edge_type"), F.lit("ai_inferred").alias("confidence"))
    acts = row(semantics.select("id", F.explode("actions").alias("x")), F.col("x.object"), "control_flow")
    effects = row(semantics.select("id", F.explode("side_effects").alias("x")), F.coalesce(F.nullif("x.target", F.lit("")), F.col("x.effect_type")), "side_effect")
    out = acts.unionByName(effects)
    if outputs is not None:
        out = out.unionByName(row(outputs, F.col("output"), "data_flow"))
    return out.distinct().join(graph.edges.select(out.columns), out.columns, "left_anti")


def contract_links(types: DataFrame, models: DataFrame) -> DataFrame:
    """(source, target, contract): frontend types(id, name) and backend models(id, name) of one contract."""
    a = types.select(F.col("id").alias("source"), contract_name("name").alias("contract"))
    b = models.select(F.col("id").alias("target"), contract_name("name").alias("contract"))
    return a.join(b, "contract").select("source", "target", "contract")


def repository_links(outbound: DataFrame, apis: DataFrame) -> DataFrame:
    """(source, target, routes): repositories that call routes(repo, route) of another: routes that end with
    one of its apis(repo, route) or hold it. Routes meet on the last part of an api's path."""
    parts = F.explode(F.array_distinct(F.filter(F.split("route", "/"), lambda p: p != "")))
    last = F.element_at(F.filter(F.split("route", "/"), lambda p: p != ""), -1)
    o = outbound.select(F.col("repo").alias("source"), F.col("route").alias("called"), F.col("route")).select("source", "called", parts.alias("part"))
    a = apis.select(F.col("repo").alias("target"), F.col("route").alias("api"), "route").select("target", "api", last.alias("part"))
    hit = o.join(a, "part").where((F.col("source") != F.col("target")) & F.col("called").contains(F.col("api")))
    return hit.groupBy("source", "target").agg(F.array_join(F.slice(F.array_sort(F.collect_set("called")), 1, 20), ",").alias("routes"))


#: Folder names that hold services.
SERVICE_FOLDERS = r"(?i)^(?:services|apps|packages)/([^/]+)/"


def service_boundaries(graph: Graph) -> DataFrame:
    """(service, n): folders below a folder of services, with their nodes."""
    name = F.regexp_extract("file", SERVICE_FOLDERS, 1)
    return graph.nodes.select(name.alias("service")).where("service <> ''").groupBy("service").agg(F.count("*").alias("n"))


def libraries(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(source, library, category): imports(source, target) of known(prefix, library, category) packages, the
    longest prefix first."""
    top = F.split_part(F.regexp_replace("target", "/", "."), F.lit("."), F.lit(1))
    j = imports.withColumn("top", top).join(known.withColumn("top", F.split_part("prefix", F.lit("."), F.lit(1))), "top").where(F.regexp_replace("target", "/", ".").startswith(F.col("prefix")))
    w = Window.partitionBy("source", "target").orderBy(F.desc(F.length("prefix")), "library")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "library", "category").distinct()
