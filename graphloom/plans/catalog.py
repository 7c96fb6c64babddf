"""Registered queries over the driver's tables, and the SQL that each must agree with.

Four graphs are used: sales, a layered multigraph that grows with the data; partners, cyclic and sparse,
which grows too; trade, dense and cyclic with parallel edges; ring, sparse and cyclic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import Graph, durable, fresh_path, validate
from graphloom.operators import cas, communities, components, diff, evidence, governance, history, lookup, metrics, planned, planning, policy, score, search, semantics, simulate, traverse
from graphloom.sources import views
from graphloom.sources.files import file_system
from graphloom.streaming import events
from graphloom.streaming.state import KeyedState

from . import catalog_tables, formats, index, oracle
from .expressions import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can say it, its oracle."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return register


_indexes: dict[tuple, index.Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of the sales graph over some tables, one for each session and state of them. A table of it is
    written when a query first reads it."""
    fs, folder = file_system(spark, sf_dir)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(folder)))
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _indexes:
        _indexes[key] = index.Index(spark, fresh_path(spark, "graphloom-index"), SALES(spark, sf_dir))
    return _indexes[key]


def by_index(name: str, run: Callable[[index.Index], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, sf_dir: run(index_of(spark, sf_dir)))


def by_file(view):
    """The view with ids that begin with the file, so that files are the modules."""

    def run(spark, sf_dir):
        g = view(spark, sf_dir)
        names = g.nodes.select("id", F.concat("file", F.lit("::"), F.replace("id", F.lit("::"), F.lit(""))).alias("name")).hint("merge")  # they grow with the data: not through the driver
        end = lambda c: names.select(F.col("id").alias(c), F.col("name").alias(c + "_name"))
        e = g.edges.join(end("source"), "source").join(end("target"), "target").drop("source", "target").withColumnsRenamed({"source_name": "source", "target_name": "target"})
        return Graph(g.nodes.join(names, "id").withColumn("id", F.col("name")).drop("name"), e)

    return run


def on(view, run: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(view(spark, sf_dir))


def add(name: str, view, run: Callable[[Graph], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(on(view, run))


SALES, TRADE, RING, PARTNERS = views.sales, views.trade, views.ring, views.partners
START, MIDDLE = "orders::5", "nation::3"
NATION = "r1::NATION_1"

# ---- lookups, searches, filters

add("node_degree_topk", SALES, lambda g: metrics.degrees(g).withColumn("degree", F.col("fan_in") + F.col("fan_out")).orderBy(F.desc("degree"), "id").limit(20),
    oracle.sales(" SELECT *, fan_in + fan_out AS degree FROM deg ORDER BY degree DESC, id LIMIT 20", oracle.DEGREES))
add("node_degrees", SALES, metrics.degrees, oracle.sales(" SELECT * FROM deg", oracle.DEGREES))
by_index("get_node", lambda i: i.node(MIDDLE).select("id", "file", "type", "line", "layer", "arch_layer"),
    oracle.sales(f" SELECT id, file, type, line, layer, arch_layer FROM nodes WHERE id = '{MIDDLE}'"))
by_index("nodes_in_file", lambda i: i.nodes_in_file("nation").select("id", "layer"), oracle.sales(" SELECT id, layer FROM nodes WHERE file = 'nation'"))
by_index("get_callers", lambda i: i.callers("supplier::3"), oracle.sales(" SELECT source AS caller_id, edge_type, confidence FROM edges WHERE target = 'supplier::3'"))
by_index("get_callees", lambda i: i.callees(START), oracle.sales(f" SELECT target AS callee_id, edge_type, confidence FROM edges WHERE source = '{START}'"))
by_index("nodes_at_layer", lambda i: i.at_layer(1), oracle.sales(" SELECT id FROM nodes WHERE layer = 1"))
add("nodes_in_arch_layer", SALES, lambda g: lookup.nodes_in_arch_layer(g, "domain").select("id"), oracle.sales(" SELECT id FROM nodes WHERE arch_layer = 'domain'"))
by_index("tests_of_node", lambda i: i.tests_of("part::7"), oracle.sales(" SELECT DISTINCT source AS test_id FROM edges WHERE target = 'part::7'"))
by_index("nodes_of_test", lambda i: i.nodes_of_test(START), oracle.sales(f" SELECT DISTINCT target AS node_id FROM edges WHERE source = '{START}'"))
by_index("node_search_ilike", lambda i: i.search("NATION::*1"), oracle.sales(" SELECT id FROM nodes WHERE id ILIKE 'nation::%1' ORDER BY id LIMIT 100"))
by_index("node_search_contains", lambda i: i.search("TION::1"), oracle.sales(" SELECT id FROM nodes WHERE id ILIKE '%tion::1%' ORDER BY id LIMIT 100"))
by_index("node_suggest", lambda i: i.suggest("Part::1"), oracle.sales(" SELECT id FROM nodes WHERE starts_with(lower(id), 'part::1') ORDER BY id LIMIT 5"))
by_index("node_resolve", lambda i: i.resolve("24"), oracle.sales(" SELECT id FROM nodes WHERE ends_with(id, '::24') ORDER BY id LIMIT 100"))
by_index("node_search_rare", lambda i: i.search("customer::*77*"), oracle.sales(" SELECT id FROM nodes WHERE id ILIKE 'customer::%77%' ORDER BY id LIMIT 100"))
by_index("node_suggest_middle", lambda i: i.suggest("tion::2"), oracle.sales(" SELECT id FROM nodes WHERE contains(id, 'tion::2') ORDER BY id LIMIT 5"))
by_index("node_suggest_segment", lambda i: i.suggest("supply::119"), oracle.sales(" SELECT id FROM nodes WHERE contains(split_part(id, '::', 2), '119') ORDER BY id LIMIT 5"))
by_index("node_resolve_exact", lambda i: i.resolve("nation::3"), oracle.sales(" SELECT id FROM nodes WHERE id = 'nation::3'"))
by_index("node_resolve_part", lambda i: i.resolve("omer::12"), oracle.sales(" SELECT id FROM nodes WHERE contains(id, 'omer::12') ORDER BY id LIMIT 100"))
by_index("trigram_counts", lambda i: i.table("trigram_counts")[0].where(~F.col("gram").rlike("[0-9]")).select("gram", "n"), oracle.sales("""
 SELECT g AS gram, count(*)::BIGINT AS n FROM (SELECT DISTINCT id, id[k:k + 2] AS g FROM (SELECT id, unnest(range(1, length(id) - 1)) AS k FROM nodes)) WHERE NOT regexp_matches(g, '[0-9]') GROUP BY g"""))
by_index("all_node_ids", lambda i: i.node_ids(), oracle.sales(" SELECT id FROM nodes"))
add("modifiable_nodes", SALES, lambda g: lookup.modifiable(g).groupBy("layer", "modifiable").agg(F.count("*").alias("n")),
    oracle.sales(" SELECT layer, layer IN (3, 4) AS modifiable, count(*)::BIGINT AS n FROM nodes GROUP BY ALL"))
add("glob_filter", SALES, lambda g: g.nodes.where(lookup.matches("id", "[no]*::[!1-3]?")).select("id"), oracle.sales(" SELECT id FROM nodes WHERE regexp_full_match(id, '[no].*::[^1-3].')"))


@query("filter_pipeline", oracle.sales("""
 SELECT CASE WHEN edge_type = 'event' THEN 'events' WHEN s.layer < 2 OR t.layer < 2 THEN 'trace' END AS filter, count(*)::BIGINT AS removed
 FROM edges e LEFT JOIN nodes s ON s.id = source LEFT JOIN nodes t ON t.id = target GROUP BY 1 HAVING filter IS NOT NULL"""))  # fmt: skip
def filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SALES(spark, sf_dir)
    return lookup.filter_edges(g, [("dunder", lookup.dunder_edges()), ("logging", lookup.logging_edges()), ("events", F.col("edge_type") == "event"), ("trace", lookup.low_layer_edges(2)), ("harness", lookup.harness_edges())])[1]


add("graph_validation", SALES, lambda g: validate(g).groupBy("kind").agg(F.count("*").alias("n")), "SELECT NULL::VARCHAR AS kind, 0::BIGINT AS n WHERE false")



@query("index_lookups", oracle.sales(f"""
 SELECT 'node' AS lookup, id AS found, layer::BIGINT AS n FROM nodes WHERE id = '{MIDDLE}'
 UNION ALL SELECT 'callers', source, count(*) FROM edges WHERE target = 'supplier::3' GROUP BY source
 UNION ALL SELECT 'callees', target, count(*) FROM edges WHERE source = '{START}' GROUP BY target
 UNION ALL SELECT 'layer', id, 1 FROM nodes WHERE layer = 1
 UNION ALL SELECT 'tests', source, 1 FROM (SELECT DISTINCT source FROM edges WHERE target = 'part::7')
 UNION ALL SELECT 'tested', target, 1 FROM (SELECT DISTINCT target FROM edges WHERE source = '{START}')"""))  # fmt: skip
def index_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lookups in a written index find."""
    i = index_of(spark, sf_dir)
    kind = lambda name, df, column, n=F.lit(1): df.select(F.lit(name).alias("lookup"), F.col(column).alias("found"), n.cast("long").alias("n"))
    out = kind("node", i.node(MIDDLE), "id", F.col("layer"))
    for name, df, column in (("callers", i.callers("supplier::3"), "caller_id"), ("callees", i.callees(START), "callee_id")):
        out = out.unionByName(df.groupBy(F.lit(name).alias("lookup"), F.col(column).alias("found")).agg(F.count("*").alias("n")))
    return out.unionByName(kind("layer", i.at_layer(1), "id")).unionByName(kind("tests", i.tests_of("part::7"), "test_id")).unionByName(kind("tested", i.nodes_of_test(START), "node_id"))


# ---- traversals

add("callers_depth1", SALES, lambda g: traverse.callers(g, "supplier::3"), oracle.sales(" SELECT source AS id FROM edges WHERE target = 'supplier::3'"))
add("callees_depth2", TRADE, lambda g: traverse.callees(g, NATION, 2), oracle.trade(f" SELECT DISTINCT node AS id FROM walk WHERE node <> '{NATION}'", oracle.reach(NATION, depth=2)))
add("dependencies_closure", SALES, lambda g: traverse.dependencies(g, START).select("id"),
    "WITH RECURSIVE " + oracle.SALES + ", " + oracle.reach(START) + f" SELECT node AS id FROM walk WHERE node <> '{START}'")
add("dependents_closure", SALES, lambda g: traverse.dependents(g, "region::0").select("id"),
    "WITH RECURSIVE " + oracle.SALES + ", " + oracle.reach("region::0", True) + " SELECT node AS id FROM walk")
add("dependencies_on_cycle", RING, lambda g: traverse.dependencies(g, NATION).select("id"), oracle.ring(f" SELECT node AS id FROM walk WHERE node <> '{NATION}'", oracle.reach(NATION)))
add("dependents_on_cycle", RING, lambda g: traverse.dependents(g, "r2::NATION_17").select("id"), oracle.ring(" SELECT node AS id FROM walk", oracle.reach("r2::NATION_17", True)))
add("shortest_path_len", RING, lambda g: traverse.path(g, "r0::NATION_0", "r2::NATION_17").select("hops", F.array_join("path", ",").alias("path")),
    oracle.ring(""", best AS (SELECT min(d) AS hops FROM walk WHERE node = 'r2::NATION_17')
 SELECT hops::INT AS hops, min(path) AS path FROM walk JOIN best ON d = hops WHERE node = 'r2::NATION_17' GROUP BY hops""",
    "walk(node, d, path) AS (SELECT 'r0::NATION_0', 0, 'r0::NATION_0' UNION ALL SELECT e.target, d + 1, path || ',' || e.target FROM walk w JOIN edges e ON e.source = w.node WHERE d < 9)"))
add("pattern_paths", RING, lambda g: traverse.pattern_paths(g, "r0::*", "r4::*").select("origin", "hops"),
    oracle.ring(" SELECT o AS origin, min(d)::INT AS hops FROM walk WHERE node LIKE 'r4::%' GROUP BY o ORDER BY o LIMIT 10",
    "walk(o, node, d) AS (SELECT id, id, 0 FROM nodes WHERE id LIKE 'r0::%' UNION SELECT o, e.target, d + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE d < 20)"))
add("orphan_nodes", SALES, traverse.orphans, oracle.sales(" SELECT id FROM nodes WHERE type <> 'module' AND id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)"))
add("orphan_nodes_ring", RING, traverse.orphans, oracle.ring(" SELECT id FROM nodes WHERE type <> 'module' AND id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)"))
add("explain_node", SALES, lambda g: traverse.explain(g, MIDDLE).select("id", "layer", "callers", "callees"), oracle.sales(f"""
 SELECT id, layer, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM edges WHERE target = '{MIDDLE}' ORDER BY source LIMIT 10)) AS callers,
  (SELECT string_agg(target, ',' ORDER BY target) FROM (SELECT DISTINCT target FROM edges WHERE source = '{MIDDLE}' ORDER BY target LIMIT 10)) AS callees FROM nodes WHERE id = '{MIDDLE}'"""))  # fmt: skip
add("blast_radius", SALES, lambda g: traverse.blast_radius(g, ["nation::3", "region::1"]), "WITH RECURSIVE " + oracle.SALES + """,
 walk(node, d) AS (SELECT unnest(['nation::3', 'region::1']), 0 UNION SELECT e.source, d + 1 FROM walk w JOIN edges e ON e.target = w.node WHERE d < 3)
 SELECT count(DISTINCT node)::BIGINT AS blast_radius FROM walk""")  # fmt: skip
add("neighbourhood", TRADE, lambda g: traverse.neighbourhood(g, [NATION], 1), oracle.trade(f""" SELECT id, min(d)::INT AS depth FROM (
 SELECT '{NATION}' AS id, 0 AS d UNION ALL SELECT source, 1 FROM edges WHERE target = '{NATION}' UNION ALL SELECT target, 1 FROM edges WHERE source = '{NATION}') GROUP BY id"""))  # fmt: skip
add("test_impact", SALES, lambda g: traverse.prioritised(traverse.impacted_tests(g, g.nodes.where("id in ('nation::3', 'part::7', 'supplier::2')").select(F.col("id").alias("node")))), "WITH RECURSIVE " + oracle.SALES + """,
 walk(o, node, d) AS (SELECT target, source, 1 FROM edges WHERE target IN ('nation::3', 'part::7', 'supplier::2')
  UNION SELECT o, e.source, d + 1 FROM walk w JOIN edges e ON e.target = w.node WHERE w.node NOT LIKE 'orders::%')
 SELECT node AS test_id, count(DISTINCT o)::BIGINT AS impact_score, min(d)::INT AS distance FROM walk WHERE node LIKE 'orders::%' GROUP BY node""")  # fmt: skip
add("invalidation_set", RING, lambda g: traverse.invalidated(g, g.nodes.where("line = 9").select(F.col("id").alias("node"))), oracle.ring(
    " SELECT node FROM walk", "walk(node) AS (SELECT id FROM nodes WHERE line = 9 UNION SELECT e.source FROM walk w JOIN edges e ON e.target = w.node)"))
add("deepest_dependency", SALES, lambda g: traverse.deepest_dependency(g, 50), "WITH RECURSIVE " + oracle.SALES + """,
 first AS (SELECT DISTINCT source AS id FROM edges WHERE source NOT IN (SELECT target FROM edges) ORDER BY id LIMIT 50),
 walk(o, node, d) AS (SELECT id, target, 1 FROM first JOIN edges ON source = id UNION SELECT o, e.target, d + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE d < 50)
 SELECT coalesce(max(m), 0)::INT AS max_depth FROM (SELECT min(d) AS m FROM walk GROUP BY o, node)""")  # fmt: skip
add("dependents_limited", SALES, lambda g: traverse.limited(traverse.dependents(g, "nation::3").select("id"), 25), "WITH RECURSIVE " + oracle.SALES + ", " + oracle.reach("nation::3", True) + """
 SELECT node AS id, (SELECT count(*) FROM walk)::BIGINT AS total, (SELECT count(*) FROM walk) > 25 AS truncated FROM walk ORDER BY node LIMIT 25""")  # fmt: skip
add("callees_limited", SALES, lambda g: traverse.limited(traverse.callees(g, START), 2), oracle.sales(f"""
 SELECT target AS id, (SELECT count(*) FROM edges WHERE source = '{START}')::BIGINT AS total, (SELECT count(*) FROM edges WHERE source = '{START}') > 2 AS truncated FROM edges WHERE source = '{START}' ORDER BY target LIMIT 2"""))  # fmt: skip
add("dependents_in_row", PARTNERS, lambda g: traverse.dependents(g, "supplier::4").select("id"), oracle.partners(" SELECT node AS id FROM walk", oracle.reach("supplier::4", True)))
add("dependencies_depth2_partners", PARTNERS, lambda g: traverse.dependencies(g, "customer::1", 2).select("id"), oracle.partners(" SELECT DISTINCT node AS id FROM walk WHERE node <> 'customer::1'", oracle.reach("customer::1", depth=2)))
add("path_in_row", PARTNERS, lambda g: traverse.path(g, "customer::1", "supplier::6").select("hops", F.array_join("path", ",").alias("path")),
    oracle.partners(" SELECT d::INT AS hops, min(path) AS path FROM walk WHERE node = 'supplier::6' GROUP BY d ORDER BY d LIMIT 1",
    "walk(node, d, path) AS (SELECT 'customer::1', 0, 'customer::1' UNION ALL SELECT e.target, d + 1, path || ',' || e.target FROM walk w JOIN edges e ON e.source = w.node WHERE d < 9)"))
add("invalidation_partners", PARTNERS, lambda g: traverse.invalidated(g, g.nodes.where("id like 'supplier::%' and line % 8 = 3").select(F.col("id").alias("node"))), oracle.partners(
    " SELECT node FROM walk", "walk(node) AS (SELECT id FROM nodes WHERE id LIKE 'supplier::%' AND line % 8 = 3 UNION SELECT e.source FROM walk w JOIN edges e ON e.target = w.node)"))
SLICE_ROOT = "suppliers1::supplier12"
add("subsystem_slice", by_file(PARTNERS), lambda g: traverse.subsystem_slice(g, SLICE_ROOT), oracle.sliced(SLICE_ROOT))
add("subsystem_slice_partition", by_file(PARTNERS), lambda g: traverse.subsystem_slice(g, SLICE_ROOT, 3, 200, 0.2, g.nodes.select("id", F.col("file").alias("partition_id")),
    g.edges.where("target = 'suppliers1::supplier15'").select("source", "target")), oracle.sliced(SLICE_ROOT, 3, 0.2, True))

# ---- boolean and SELECT queries

add("boolean_and", TRADE, lambda g: Engine(g).run(f'callers("{NATION}") AND callees("{NATION}")'), oracle.trade(f" SELECT source AS id FROM edges WHERE target = '{NATION}' INTERSECT SELECT target FROM edges WHERE source = '{NATION}'"))
add("boolean_or", SALES, lambda g: Engine(g).run('callers("nation::3") OR callees("nation::3")'), oracle.sales(" SELECT source AS id FROM edges WHERE target = 'nation::3' UNION SELECT target FROM edges WHERE source = 'nation::3'"))
add("boolean_not", SALES, lambda g: Engine(g).run('(callers("nation::3") NOT callers("nation::4")) AND search("*1*")'), oracle.sales(""" SELECT id FROM (SELECT source AS id FROM edges WHERE target = 'nation::3' EXCEPT SELECT source FROM edges WHERE target = 'nation::4')
 WHERE id IN (SELECT id FROM nodes WHERE id LIKE '%1%' ORDER BY id LIMIT 100)"""))  # fmt: skip
add("select_nodes", SALES, lambda g: Engine(g).run("SELECT nodes WHERE layer=2 AND fan_in>=10 AND arch_layer=domain"), oracle.sales(" SELECT id FROM deg JOIN nodes USING (id) WHERE layer = 2 AND fan_in >= 10", oracle.DEGREES))
add("select_modules_in_layer", TRADE, lambda g: Engine(g).run('SELECT modules WHERE in_layer("service")'), oracle.trade(" SELECT id FROM nodes WHERE arch_layer = 'service'"))
add("select_services_depends_on", RING, lambda g: Engine(g).run("SELECT services WHERE depends_on(NATION_17)"), oracle.ring(" SELECT id FROM nodes JOIN walk ON id = node WHERE arch_layer = 'service'", oracle.reach("r2::NATION_17", True)))
add("select_violations", TRADE, lambda g: Engine(g).run("SELECT violations WHERE layer=1"), oracle.trade(" SELECT DISTINCT source || ' -> ' || target AS id FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.layer = 1 AND t.layer > 1"))
add("select_cycles", RING, lambda g: Engine(g).run("SELECT cycles"), oracle.ring(" SELECT string_agg(id, ' -> ' ORDER BY id) || ' -> ' || component AS id FROM scc GROUP BY component", oracle.SCC))
add("select_subsystems", TRADE, lambda g: Engine(g).run("SELECT subsystems WHERE cohesion>=0"), "SELECT 'root' AS id")

# ---- aggregations

add("edge_stats_sets", SALES, metrics.edge_stats, oracle.sales(""" SELECT edge_type, confidence, count(*)::BIGINT AS n, 0::BIGINT AS dynamic, count(*) FILTER (source = target)::BIGINT AS self_referring
 FROM edges GROUP BY GROUPING SETS ((edge_type), (confidence), ())"""))  # fmt: skip
add("layer_stats", SALES, metrics.layer_stats, oracle.sales(" SELECT layer::INT AS layer, count(*)::BIGINT AS n, round(100 * count(*) / (SELECT count(*) FROM nodes), 4) AS percent FROM nodes GROUP BY layer"))
add("module_coupling", TRADE, metrics.module_coupling, oracle.trade(""" SELECT n.file AS module, count(*)::BIGINT AS members, coalesce(any_value(c), 0)::BIGINT AS crossing, round(coalesce(any_value(c), 0) / count(*), 6) AS coupling
 FROM nodes n LEFT JOIN (SELECT m, count(*) AS c FROM (SELECT unnest([split_part(source, '::', 1), split_part(target, '::', 1)]) AS m FROM edges WHERE split_part(source, '::', 1) <> split_part(target, '::', 1)) GROUP BY m) x ON x.m = n.file GROUP BY n.file"""))  # fmt: skip
add("module_pair_coupling", TRADE, metrics.module_pair_coupling, oracle.trade(""", x AS (SELECT split_part(source, '::', 1) AS a, split_part(target, '::', 1) AS b FROM edges WHERE split_part(source, '::', 1) <> split_part(target, '::', 1)),
 o AS (SELECT a, count(*) AS c FROM x GROUP BY a), p AS (SELECT least(a, b) AS file_a, greatest(a, b) AS file_b, count(*)::BIGINT AS n FROM x GROUP BY ALL HAVING count(*) >= 10)
 SELECT file_a, file_b, n, round(n / (coalesce(y.c, 1) + coalesce(z.c, 1)), 6) AS strength FROM p LEFT JOIN o y ON y.a = file_a LEFT JOIN o z ON z.a = file_b"""))  # fmt: skip
add("module_graph_l2", SALES, metrics.module_graph, oracle.sales(""", x AS (SELECT DISTINCT split_part(source, '::', 1) AS a, split_part(target, '::', 1) AS b FROM edges WHERE split_part(source, '::', 1) <> split_part(target, '::', 1))
 SELECT file, count(*)::BIGINT AS functions, count(*) FILTER (type = 'class')::BIGINT AS classes, (SELECT count(*) FROM x WHERE b = file)::BIGINT AS fan_in, (SELECT count(*) FROM x WHERE a = file)::BIGINT AS fan_out FROM nodes GROUP BY file"""))  # fmt: skip
add("file_calls", SALES, metrics.file_calls, oracle.sales(" SELECT split_part(source, '::', 1) AS s_file, split_part(target, '::', 1) AS t_file, count(*)::BIGINT AS call_count FROM edges GROUP BY ALL"))
add("subsystem_graph_l3", TRADE, lambda g: metrics.subsystem_graph(g, F.col("file")), oracle.trade(""", x AS (SELECT split_part(source, '::', 1) AS a, split_part(target, '::', 1) AS b FROM edges),
 c AS (SELECT s AS subsystem, count(*) FILTER (a = b)::BIGINT AS internal, count(*) FILTER (a <> b AND b = s)::BIGINT AS ext_in, count(*) FILTER (a <> b AND a = s)::BIGINT AS ext_out FROM x, (SELECT DISTINCT file AS s FROM nodes) WHERE a = s OR b = s GROUP BY s)
 SELECT f.file AS subsystem, coalesce(internal, 0)::BIGINT AS internal, coalesce(ext_in, 0)::BIGINT AS ext_in, coalesce(ext_out, 0)::BIGINT AS ext_out, coalesce(round(internal / (internal + ext_in + ext_out), 6), 0) AS cohesion
 FROM (SELECT DISTINCT file FROM nodes) f LEFT JOIN c ON c.subsystem = f.file"""))  # fmt: skip
add("god_modules", SALES, metrics.god_modules, oracle.sales(" SELECT file, count(*)::BIGINT AS n FROM nodes GROUP BY file HAVING count(*) >= 30"))
add("compress_to_module", SALES, metrics.compress, oracle.sales(""" SELECT source, target, arg_min(edge_type, (edge_type, confidence)) AS edge_type, arg_min(confidence, (edge_type, confidence)) AS confidence
 FROM (SELECT split_part(source, '::', 1) AS source, split_part(target, '::', 1) AS target, edge_type, confidence FROM edges) GROUP BY source, target"""))  # fmt: skip
add("dedup_edges", SALES, lambda g: metrics.dedup_edges(g).groupBy("edge_type", "confidence").agg(F.count("*").alias("n")), oracle.sales(" SELECT edge_type, confidence, count(*)::BIGINT AS n FROM (SELECT DISTINCT * FROM edges) GROUP BY ALL"))
add("best_edge", SALES, metrics.best_edges, oracle.sales(""" SELECT source, target, edge_type, confidence FROM (SELECT DISTINCT * FROM edges)
 QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY CASE confidence WHEN 'runtime' THEN 4 WHEN 'test' THEN 3 ELSE 2 END DESC, CASE edge_type WHEN 'call' THEN 3 WHEN 'control_flow' THEN 3 ELSE 2 END DESC, edge_type, confidence) = 1"""))  # fmt: skip
add("risk_scores", SALES, metrics.risks, oracle.sales(""", m AS (SELECT max(fan_in) AS mi, max(fan_out) AS mo FROM deg), r AS (SELECT id, fan_in, fan_out, round(0.4::DOUBLE * (fan_in / mi) + 0.6::DOUBLE * (fan_out / mo), 6) AS coupling_score, round(0.3::DOUBLE * (fan_in / mi) + 0.3::DOUBLE * (fan_out / mo), 6) AS risk_score FROM deg, m)
 SELECT *, CASE WHEN risk_score >= 0.8 THEN 'critical' WHEN risk_score >= 0.5 THEN 'high' WHEN risk_score >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM r""", oracle.DEGREES))  # fmt: skip
add("risk_summary", SALES, lambda g: metrics.risk_summary(g).select("max_fan_in", "max_fan_out", "avg_fan_in", "avg_fan_out"), oracle.sales(" SELECT max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out, round(avg(fan_in), 6) AS avg_fan_in, round(avg(fan_out), 6) AS avg_fan_out FROM deg", oracle.DEGREES))
add("p95_fan_in", SALES, lambda g: metrics.p95(metrics.degrees(g), "fan_in"), oracle.sales(" SELECT fan_in AS p95 FROM (SELECT fan_in, row_number() OVER (ORDER BY fan_in) AS r, count(*) OVER () AS n FROM deg) WHERE r = floor((n - 1) * 0.95) + 1", oracle.DEGREES))
add("fan_entropy", SALES, lambda g: metrics.entropy(metrics.degrees(g), "fan_in"), oracle.sales(" SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT fan_in / sum(fan_in) OVER () AS p FROM deg WHERE fan_in > 0)", oracle.DEGREES))
add("fan_distribution", SALES, score.fan_distribution, oracle.sales(" SELECT fan_in AS value, count(*)::BIGINT AS n, 'fan_in' AS metric FROM deg GROUP BY fan_in UNION ALL SELECT fan_out, count(*), 'fan_out' FROM deg GROUP BY fan_out", oracle.DEGREES))
add("multilevel_smells", SALES, metrics.multilevel_smells, oracle.sales(""" SELECT 'god_function' AS smell, id AS subject, fan_out::DOUBLE AS value FROM deg WHERE fan_out >= 20
 UNION ALL SELECT 'god_module', file, count(*)::DOUBLE FROM nodes GROUP BY file HAVING count(*) >= 30
 UNION ALL SELECT 'god_subsystem', 'root', count(*)::DOUBLE FROM nodes HAVING count(*) >= 300""", oracle.DEGREES))  # fmt: skip
add("architecture_smells", RING, metrics.architecture_smells, oracle.ring(""" SELECT 'cross_layer' AS smell, source || ' -> ' || target AS subject, 'error' AS severity FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.layer < t.layer
 UNION SELECT 'orphan_service', id, 'warning' FROM nodes WHERE arch_layer = 'service' AND id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)
 UNION SELECT 'dependency_cycle', string_agg(id, ' -> ' ORDER BY id), 'error' FROM scc GROUP BY component""", oracle.SCC))  # fmt: skip
add("bidirectional_pairs", TRADE, score.bidirectional, oracle.trade(" SELECT DISTINCT split_part(e.source, '::', 1) AS a, split_part(e.target, '::', 1) AS b FROM edges e JOIN edges f ON split_part(e.source, '::', 1) = split_part(f.target, '::', 1) AND split_part(e.target, '::', 1) = split_part(f.source, '::', 1) WHERE split_part(e.source, '::', 1) < split_part(e.target, '::', 1)"))
add("hubs_top_band", RING, metrics.hubs, oracle.ring(""", h AS (SELECT deg.*, (SELECT count(DISTINCT node) FROM walk WHERE o = deg.id AND node <> o)::BIGINT AS reach FROM deg),
 s AS (SELECT *, fan_in + fan_out + reach AS score, rank() OVER (ORDER BY fan_in + fan_out + reach DESC) AS r FROM h)
 SELECT id, fan_in, fan_out, reach, score FROM s WHERE r <= (SELECT ceil(count(*) * 0.1) FROM nodes) AND score > 0""", oracle.DEGREES,
    "walk(o, node, d) AS (SELECT source, target, 1 FROM edges UNION SELECT o, e.target, d + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE d < 3)"))
add("hubs_sales", SALES, metrics.hubs, oracle.sales(""", d AS (SELECT DISTINCT source, target FROM edges), w AS (SELECT source AS o, target AS node FROM d
 UNION SELECT a.source, b.target FROM d a JOIN d b ON b.source = a.target UNION SELECT a.source, c.target FROM d a JOIN d b ON b.source = a.target JOIN d c ON c.source = b.target),
 r AS (SELECT deg.*, count(node)::BIGINT AS reach FROM deg LEFT JOIN w ON o = id AND node <> id GROUP BY ALL)
 SELECT *, fan_in + fan_out + reach AS score FROM r QUALIFY rank() OVER (ORDER BY fan_in + fan_out + reach DESC) <= (SELECT ceil(count(*) * 0.1) FROM nodes)""", oracle.DEGREES))  # fmt: skip
add("bounded_reach3", SALES, metrics.reach3, oracle.sales(""", s AS (SELECT DISTINCT source, target FROM edges), w AS (SELECT source AS o, target AS node FROM s
 UNION SELECT a.source, b.target FROM s a JOIN s b ON b.source = a.target UNION SELECT a.source, c.target FROM s a JOIN s b ON b.source = a.target JOIN s c ON c.source = b.target)
 SELECT id, count(node)::BIGINT AS reach FROM nodes LEFT JOIN w ON o = id AND node <> id GROUP BY id"""))  # fmt: skip

# ---- components

add("wcc", RING, lambda g: components.weak_components(g.nodes, g.edges), oracle.ring(" SELECT id, least(id, coalesce(min(b), id)) AS component FROM nodes LEFT JOIN w ON a = id GROUP BY id",
    "both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)", "w(a, b) AS (SELECT a, b FROM both_ways UNION SELECT w.a, x.b FROM w JOIN both_ways x ON x.a = w.b)"))
add("wcc_sales", SALES, lambda g: components.weak_components(g.nodes, g.edges).groupBy("component").agg(F.count("*").alias("n")), "WITH RECURSIVE " + oracle.SALES + """,
 u AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), w(id) AS (SELECT min(id) FROM nodes UNION SELECT b FROM w JOIN u ON a = id)
 SELECT (SELECT min(id) FROM nodes) AS component, count(*)::BIGINT AS n FROM w UNION ALL SELECT id, 1 FROM nodes WHERE id NOT IN (SELECT id FROM w)""")  # fmt: skip
add("scc_components", RING, lambda g: components.strong_components(g.edges), oracle.ring(" SELECT id, component FROM scc", oracle.SCC))
add("scc_trade", TRADE, lambda g: components.strong_components(g.edges), oracle.trade(" SELECT id, component FROM scc", oracle.SCC.replace("FROM edges UNION", "FROM (SELECT DISTINCT source, target FROM edges) UNION").replace("JOIN edges e", "JOIN (SELECT DISTINCT source, target FROM edges) e")))
add("cycles", RING, components.cycles, oracle.ring(""" SELECT component AS cycle_id, count(*)::BIGINT AS size, string_agg(id, ' -> ' ORDER BY id) AS members,
 (SELECT count(*) FROM edges JOIN scc x ON x.id = source JOIN scc y ON y.id = target WHERE x.component = s.component AND y.component = s.component)::BIGINT AS evidence FROM scc s GROUP BY component""", oracle.SCC))  # fmt: skip
add("scc_partners", PARTNERS, lambda g: components.strong_components(g.edges), oracle.partners(" SELECT id, component FROM scc", oracle.SCC))
add("cycles_partners", PARTNERS, lambda g: components.cycles(g).select("cycle_id", "size", "evidence"), oracle.partners(""" SELECT component AS cycle_id, count(*)::BIGINT AS size,
 (SELECT count(*) FROM edges JOIN scc x ON x.id = source JOIN scc y ON y.id = target WHERE x.component = s.component AND y.component = s.component)::BIGINT AS evidence FROM scc s GROUP BY component""", oracle.SCC))  # fmt: skip
add("wcc_partners", PARTNERS, lambda g: components.weak_components(g.nodes, g.edges), oracle.partners(" SELECT id, least(id, coalesce(min(b), id)) AS component FROM nodes LEFT JOIN w ON a = id GROUP BY id",
    "w(a, b) AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges UNION SELECT w.a, e.b FROM w JOIN (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges) e ON e.a = w.b)"))
add("bridges_partners", PARTNERS, lambda g: components.bridges(g).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")), oracle.partners("""
 SELECT least(source, target) AS a, greatest(source, target) AS b FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target
 WHERE (source LIKE 'customer::%' AND s.line <> t.line * 15 + t.line % 15) OR (source LIKE 'supplier::%' AND target LIKE 'supplier::%' AND t.line = s.line + 1
  AND (s.line % 8 NOT IN (2, 3, 4) OR 'supplier::' || (s.line // 8 * 8 + 5) NOT IN (SELECT id FROM nodes)))"""))  # fmt: skip
add("levels_partners", PARTNERS, lambda g: components.topological_levels(g.edges), oracle.partners(""" SELECT id, max(l)::INT AS level FROM lv JOIN grp USING (g) GROUP BY id""",
    oracle.SCC, """grp AS (SELECT id, coalesce(component, id) AS g FROM nodes LEFT JOIN scc USING (id)), calls AS (SELECT DISTINCT a.g AS ga, b.g AS gb FROM edges JOIN grp a ON a.id = source JOIN grp b ON b.id = target WHERE a.g <> b.g),
 lv(g, l) AS (SELECT g, 0 FROM grp UNION SELECT ga, l + 1 FROM lv JOIN calls ON gb = lv.g)"""))  # fmt: skip
add("bounded_cycles", RING, lambda g: components.bounded_cycles(g, ["r0::NATION_0", "r2::NATION_17", "r2::NATION_12"]), oracle.ring(" SELECT o AS origin, min(d)::INT AS length FROM walk WHERE o = node GROUP BY o",
    "walk(o, node, d) AS (SELECT source, target, 1 FROM edges WHERE source IN ('r0::NATION_0', 'r2::NATION_17', 'r2::NATION_12') UNION SELECT o, e.target, d + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE d < 10)"))
add("bridges", RING, components.bridges, oracle.ring(""" SELECT e.source, e.target FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.k = e.k AND w.b = e.target) GROUP BY ALL HAVING count(*) = 1""",
    "e AS (SELECT *, row_number() OVER (ORDER BY source, target) AS k FROM edges)", "u AS (SELECT k, source AS a, target AS b FROM e UNION ALL SELECT k, target, source FROM e)",
    "w(k, b) AS (SELECT k, source FROM e UNION SELECT w.k, u.b FROM w JOIN u ON u.a = w.b AND u.k <> w.k)"))
add("lpa_labels", by_file(PARTNERS), communities.propagate_labels, oracle.labels(oracle.partners, " SELECT id, name AS label FROM settled"))
add("lpa_labels_ring", RING, communities.propagate_labels, oracle.labels(oracle.ring, " SELECT id, name AS label FROM settled"))
add("lpa_partitions", RING, communities.partitions, oracle.labels(oracle.ring, " SELECT id, partition_id FROM partition", oracle.PARTITION))
add("lpa_partitions_partners", by_file(PARTNERS), communities.partitions, oracle.labels(oracle.partners, " SELECT id, partition_id FROM partition", oracle.PARTITION))
add("community_overview", RING, lambda g: communities.community_overview(g, communities.partitions(g)).withColumn("type_counts", F.to_json("type_counts")), oracle.labels(oracle.ring, oracle.OVERVIEW, oracle.PARTITION))
add("community_overview_partners", by_file(PARTNERS), lambda g: communities.community_overview(g, communities.partitions(g)).withColumn("type_counts", F.to_json("type_counts")), oracle.labels(oracle.partners, oracle.OVERVIEW, oracle.PARTITION))
add("community_links", TRADE, lambda g: communities.community_links(g, g.nodes.select("id", F.col("file").alias("partition_id"))), oracle.trade(""", x AS (SELECT least(split_part(source, '::', 1), split_part(target, '::', 1)) AS a, greatest(split_part(source, '::', 1), split_part(target, '::', 1)) AS b, count(*)::BIGINT AS n FROM edges GROUP BY ALL)
 SELECT x.a AS source_community, x.b AS target_community, x.n AS edge_count, round(x.n / (coalesce(i.n, 0) + coalesce(j.n, 0) + x.n), 6) AS coupling_score FROM x LEFT JOIN x i ON i.a = x.a AND i.b = x.a LEFT JOIN x j ON j.a = x.b AND j.b = x.b WHERE x.a <> x.b"""))  # fmt: skip
add("betweenness", RING, lambda g: components.betweenness(g).select("id", F.round("betweenness", 6).alias("betweenness")))
add("modularity_subsystems", TRADE, communities.subsystems_by_modularity, oracle.modularity(oracle.trade, " SELECT file, subsystem FROM owner"))
add("modularity_partners", PARTNERS, communities.subsystems_by_modularity, oracle.modularity(oracle.partners, " SELECT file, subsystem FROM owner"))
add("subsystem_report", PARTNERS, lambda g: communities.subsystem_report(g, communities.subsystems_by_modularity(g)), oracle.modularity(oracle.partners, oracle.REPORT))
add("subsystem_couplings", PARTNERS, lambda g: communities.subsystem_couplings(g, g.nodes.select("file", F.col("file").alias("subsystem")).distinct()), oracle.partners("""
 SELECT least(s.file, t.file) AS subsystem_a, greatest(s.file, t.file) AS subsystem_b, count(*)::BIGINT AS edge_count, round(count(*) / sum(count(*)) OVER (), 6) AS coupling_strength
 FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.file <> t.file GROUP BY ALL"""))
add("betweenness", RING, lambda g: components.betweenness(g).select("id", F.round("betweenness", 6).alias("betweenness")))
add("modularity_subsystems", TRADE, communities.subsystems_by_modularity, oracle.modularity(oracle.trade, " SELECT file, subsystem FROM owner"))
add("modularity_partners", PARTNERS, communities.subsystems_by_modularity, oracle.modularity(oracle.partners, " SELECT file, subsystem FROM owner"))
add("subsystem_report", PARTNERS, lambda g: communities.subsystem_report(g, communities.subsystems_by_modularity(g)), oracle.modularity(oracle.partners, oracle.REPORT))
add("subsystem_couplings", PARTNERS, lambda g: communities.subsystem_couplings(g, communities.subsystems_by_modularity(g)), oracle.modularity(oracle.partners, """, across AS (
 SELECT least(x.subsystem, y.subsystem) AS subsystem_a, greatest(x.subsystem, y.subsystem) AS subsystem_b, sum(w) AS w FROM weight JOIN owner x ON x.file = a JOIN owner y ON y.file = b WHERE x.subsystem <> y.subsystem GROUP BY ALL)
 SELECT subsystem_a, subsystem_b, w::BIGINT AS edge_count, round(w / (SELECT sum(w) FROM weight), 6) AS coupling_strength FROM across"""))
add("topological_levels", SALES, lambda g: components.topological_levels(g.edges).groupBy("level").agg(F.count("*").alias("n")), oracle.sales(""" SELECT CASE split_part(id, '::', 1) WHEN 'region' THEN 0 WHEN 'part' THEN 0 WHEN 'nation' THEN 1 WHEN 'orders' THEN 3 ELSE 2 END AS level, count(*)::BIGINT AS n
 FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) GROUP BY level"""))  # fmt: skip

# ---- snapshots, hashes

CUT_A, CUT_B = "1995-01-01", "1996-01-01"


def snapshot(spark: SparkSession, sf_dir: str, before: str) -> Graph:
    return SALES(spark, sf_dir, F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))


def two(run) -> Query:
    return lambda spark, sf_dir: run(snapshot(spark, sf_dir, CUT_A), snapshot(spark, sf_dir, CUT_B))


query("snapshot_diff_nodes", oracle.sales(f""" SELECT CASE WHEN o_orderkey IS NULL OR o_orderdate < '{CUT_A}' THEN 'unchanged' ELSE 'added' END AS change, count(*)::BIGINT AS n
 FROM nodes LEFT JOIN orders ON id = 'orders::' || o_orderkey WHERE o_orderkey IS NULL OR o_orderdate < '{CUT_B}' GROUP BY change"""))(two(lambda a, b: diff.diff_nodes(a, b).groupBy("change").agg(F.count("*").alias("n"))))  # fmt: skip
query("snapshot_diff_edges", oracle.sales(f""" SELECT CASE WHEN o_orderkey IS NULL OR o_orderdate < '{CUT_A}' THEN 'unchanged' ELSE 'added' END AS change, count(DISTINCT (source, target))::BIGINT AS n
 FROM edges LEFT JOIN orders ON source = 'orders::' || o_orderkey WHERE o_orderkey IS NULL OR o_orderdate < '{CUT_B}' GROUP BY change"""))(two(lambda a, b: diff.diff_edges(a, b).groupBy("change").agg(F.count("*").alias("n"))))  # fmt: skip
query("snapshot_diff_multigraph", oracle.sales(f""" SELECT edge_type, count(*)::BIGINT AS records FROM edges JOIN orders ON source = 'orders::' || o_orderkey
 WHERE o_orderdate >= '{CUT_A}' AND o_orderdate < '{CUT_B}' GROUP BY edge_type"""))(two(lambda a, b: diff.diff_multigraph(a, b).groupBy("edge_type").agg(F.sum("delta").alias("records"))))  # fmt: skip
query("metric_deltas", oracle.sales(f""", side AS (SELECT * FROM (VALUES ('before', '{CUT_A}'), ('after', '{CUT_B}')) v(side, cut)),
 n AS (SELECT side, count(*) AS node_count FROM nodes LEFT JOIN orders ON id = 'orders::' || o_orderkey, side WHERE o_orderkey IS NULL OR o_orderdate < cut::TIMESTAMP GROUP BY side),
 e AS (SELECT side, count(*) AS edge_count FROM edges LEFT JOIN orders ON source = 'orders::' || o_orderkey, side WHERE o_orderkey IS NULL OR o_orderdate < cut::TIMESTAMP GROUP BY side)
 SELECT metric, max(v) FILTER (side = 'before') AS before, max(v) FILTER (side = 'after') AS after FROM (SELECT side, 'node_count' AS metric, node_count::DOUBLE AS v FROM n UNION ALL SELECT side, 'edge_count', edge_count::DOUBLE FROM e) GROUP BY metric"""))(
    two(lambda a, b: diff.metric_deltas(a, b).where("metric in ('node_count', 'edge_count')").select("metric", "before", "after")))
query("incremental_equals_full", "SELECT 'edges' AS \"table\", 0::BIGINT AS only_old, 0::BIGINT AS only_new UNION ALL SELECT 'nodes', 0, 0")(
    two(lambda a, b: diff.snapshot_diff({"nodes": (m := diff.apply_delta(a, b)).nodes, "edges": m.edges}, {"nodes": b.nodes, "edges": b.edges})))
add("consistency_check", SALES, diff.consistency, "SELECT unnest(['unknown_edge_end', 'stale_annotation', 'repeated_id']) AS problem, 0::BIGINT AS n")
add("cas_hashes", SALES, lambda g: cas.dependency_hashes(g), oracle.sales(""", d AS (SELECT DISTINCT source, target FROM edges), b AS (SELECT id, sha256(id || '|' || body) AS h FROM nodes),
 l0 AS (SELECT id, sha256(h) AS x FROM b WHERE id LIKE 'region::%' OR id LIKE 'part::%'),
 l1 AS (SELECT b.id, sha256(any_value(b.h) || ':' || string_agg(x, ':' ORDER BY x)) AS x FROM b JOIN d ON d.source = b.id JOIN l0 ON l0.id = d.target WHERE b.id LIKE 'nation::%' GROUP BY b.id),
 l2 AS (SELECT b.id, sha256(any_value(b.h) || ':' || string_agg(x, ':' ORDER BY x)) AS x FROM b JOIN d ON d.source = b.id JOIN l1 ON l1.id = d.target WHERE b.id NOT LIKE 'orders::%' GROUP BY b.id),
 l AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2),
 l3 AS (SELECT b.id, sha256(any_value(b.h) || ':' || string_agg(x, ':' ORDER BY x)) AS x FROM b JOIN d ON d.source = b.id JOIN l ON l.id = d.target WHERE b.id LIKE 'orders::%' GROUP BY b.id)
 SELECT id, x AS dependency_hash FROM l UNION ALL SELECT id, x FROM l3"""))  # fmt: skip
add("cas_cyclic", RING, cas.dependency_hashes)
add("cas_rehash_equals_full", RING, lambda g: cas.verify(g, cas.rehash(g, cas.dependency_hashes(g), g.nodes.where("line = 9").select(F.col("id").alias("node")))), "SELECT '' AS id, '' AS stored, '' AS computed WHERE false")

# ---- policies

RULES = [
    {"id": "f1", "type": "forbidden_call", "source": "r0::*", "target": "r3::*"},
    {"id": "f2", "type": "layer_boundary", "source_layer": 4, "target_layer": 2},
    {"id": "q1", "type": "required_call", "source": "r1::*", "target": "r0::*"},
    {"id": "d1", "type": "dependency_limit", "source": "r2::*", "max_fan_out": 1, "max_fan_in": 1},
    {"id": "x1", "type": "forbidden_call", "source": "nowhere::*", "target": "r1::*"},
    {"id": "p1", "type": "forbidden_path", "source": "r0::*", "target": "r2::*17"},
]


def ruled(run) -> Query:
    return lambda spark, sf_dir: run(RING(spark, sf_dir), policy.rules_table(spark, RULES))


query("forbidden_edges", oracle.ring(""" SELECT 'f1' AS rule_id, source, target FROM edges WHERE source LIKE 'r0::%' AND target LIKE 'r3::%'
 UNION SELECT 'f2', source, target FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.layer = 4 AND t.layer = 2"""))(ruled(policy.forbidden_calls))  # fmt: skip
query("required_missing", oracle.ring(" SELECT 'q1' AS rule_id, id AS source FROM nodes WHERE id LIKE 'r1::%' AND id NOT IN (SELECT source FROM edges WHERE target LIKE 'r0::%')"))(ruled(policy.missing_calls))
query("required_pairs_missing", oracle.ring(" SELECT 'q1' AS rule_id, s.id AS source, t.id AS target FROM nodes s, nodes t WHERE s.id LIKE 'r1::%' AND t.id LIKE 'r0::%' AND NOT EXISTS (SELECT 1 FROM edges WHERE source = s.id AND target = t.id)"))(ruled(policy.required_pairs_missing))
query("dependency_limit", oracle.ring(""" SELECT 'd1' AS rule_id, id, 'fan_in' AS metric, fan_in AS value, 1 AS most FROM deg WHERE id LIKE 'r2::%' AND fan_in > 1
 UNION ALL SELECT 'd1', id, 'fan_out', fan_out, 1 FROM deg WHERE id LIKE 'r2::%' AND fan_out > 1""", oracle.DEGREES))(ruled(policy.fan_violations))  # fmt: skip
query("dangling_rules", "SELECT 'x1' AS rule_id, 'source' AS side")(ruled(policy.dangling_rules))
query("rule_status", oracle.ring(""", bad AS (SELECT 'f1' AS rule_id FROM edges WHERE source LIKE 'r0::%' AND target LIKE 'r3::%' UNION ALL SELECT 'f2' FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.layer = 4 AND t.layer = 2
 UNION ALL SELECT 'q1' FROM nodes WHERE id LIKE 'r1::%' AND id NOT IN (SELECT source FROM edges WHERE target LIKE 'r0::%') UNION ALL SELECT 'd1' FROM deg WHERE id LIKE 'r2::%' AND fan_in > 1 UNION ALL SELECT 'd1' FROM deg WHERE id LIKE 'r2::%' AND fan_out > 1),
 rule AS (SELECT * FROM (VALUES ('f1', 'forbidden_call'), ('f2', 'layer_boundary'), ('q1', 'required_call'), ('d1', 'dependency_limit'), ('x1', 'forbidden_call'), ('p1', 'forbidden_path')) v(rule_id, type))
 SELECT rule.rule_id, type, count(bad.rule_id)::BIGINT AS violations, CASE WHEN rule.rule_id = 'x1' THEN 'dangling' WHEN count(bad.rule_id) > 0 THEN 'violated' ELSE 'satisfied' END AS status FROM rule LEFT JOIN bad ON bad.rule_id = rule.rule_id GROUP BY rule.rule_id, type""", oracle.DEGREES))(ruled(policy.rule_status))  # fmt: skip
add("forbidden_paths", RING, lambda g: policy.forbidden_paths(g, RULES).select("rule_id", "origin", "hops"), oracle.ring(" SELECT 'p1' AS rule_id, o AS origin, min(d)::INT AS hops FROM walk WHERE node LIKE 'r2::%17' GROUP BY o ORDER BY o LIMIT 5",
    "walk(o, node, d) AS (SELECT id, id, 0 FROM nodes WHERE id LIKE 'r0::%' UNION SELECT o, e.target, d + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE d < 20)"))
add("layer_violations", TRADE, policy.layer_violations, oracle.trade(" SELECT DISTINCT source, target, s.layer AS s_layer, t.layer AS t_layer FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.layer < t.layer"))


@query("dependency_drift", oracle.sales(""", d AS (SELECT * FROM (VALUES ('orders', 'customer'), ('orders', 'part'), ('part', 'supplier')) v(source, target)), a AS (SELECT DISTINCT split_part(source, '::', 1) AS source, split_part(target, '::', 1) AS target FROM edges)
 SELECT *, 'undeclared' AS finding FROM (SELECT * FROM a EXCEPT SELECT * FROM d) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM d EXCEPT SELECT * FROM a)"""))  # fmt: skip
def dependency_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("orders", "customer"), ("orders", "part"), ("part", "supplier")], "source string, target string")
    return policy.dependency_drift(SALES(spark, sf_dir), declared)


@query("module_drift", "SELECT unnest(['customer', 'nation', 'region', 'supplier']) AS module, 'undeclared' AS finding UNION ALL SELECT 'invoice', 'missing'")
def module_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.module_drift(SALES(spark, sf_dir), spark.createDataFrame([("orders",), ("part",), ("invoice",)], "module string"))


@query("intent_violations", oracle.sales(" SELECT source, target, 'mid' AS from_layer, 'low' AS to_layer FROM (SELECT DISTINCT source, target FROM edges WHERE source LIKE 'customer%' AND target LIKE 'nation%')"))
def intent_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = spark.createDataFrame([("top", "orders"), ("mid", "customer"), ("low", "nation"), ("low", "region")], "layer string, prefix string")
    return policy.intent_violations(SALES(spark, sf_dir), layers, spark.createDataFrame([("top", "mid")], "from_layer string, to_layer string"))


add("coverage_gaps", RING, lambda g: policy.coverage_gaps(g, 4), oracle.ring(""", t AS (SELECT id FROM nodes WHERE layer = 4), direct AS (SELECT target AS id FROM edges WHERE source IN (SELECT id FROM t))
 SELECT id, CASE WHEN id IN (SELECT node FROM walk) THEN 'indirect_only' ELSE 'no_test' END AS gap FROM nodes WHERE layer <> 4 AND id NOT IN (SELECT id FROM direct)""",
    "walk(node) AS (SELECT target FROM edges JOIN nodes ON id = source WHERE layer = 4 UNION SELECT e.target FROM walk w JOIN edges e ON e.source = w.node)"))
add("orphan_classes", RING, policy.orphan_classes, oracle.ring(" SELECT id, 'dead_code' AS classification FROM nodes WHERE id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)"))
add("lock_check", SALES, lambda g: policy.lock_check(g, metrics.compress(g).where("source <> 'orders'").select("source", "target")), "SELECT 'orders' AS source, unnest(['customer', 'part', 'supplier']) AS target")

# ---- scores and what-if

add("health", RING, score.health, oracle.ring(""" SELECT count(*)::BIGINT AS nodes, count(*) FILTER (fan_in + fan_out = 0)::BIGINT AS orphans, count(*) FILTER (arch_layer = 'service' AND fan_in = 0)::BIGINT AS unused_services,
 round(var_pop(fan_in), 6) AS fan_in_variance, round(var_pop(fan_out), 6) AS fan_out_variance, (SELECT count(*) FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.layer < t.layer)::BIGINT AS layer_violations,
 (SELECT count(DISTINCT component) FROM scc)::BIGINT AS cycles, (SELECT round(-sum(p * log2(p)), 6) FROM (SELECT fan_in / sum(fan_in) OVER () AS p FROM deg WHERE fan_in > 0)) AS fan_in_entropy FROM deg JOIN nodes USING (id)""", oracle.DEGREES, oracle.SCC))  # fmt: skip
add("architecture_score", RING, score.architecture_score, oracle.ring(""", e AS (SELECT count(*) AS n, count(*) FILTER (s.file = t.file) AS inside, count(*) FILTER (s.layer < t.layer) AS up, (SELECT count(DISTINCT component) FROM scc) AS c,
  (SELECT coalesce(max(k), 0) FROM (SELECT fan_in + fan_out AS k, row_number() OVER (ORDER BY fan_in + fan_out DESC) AS r, count(*) OVER () AS m FROM deg WHERE fan_in + fan_out > 0) WHERE r = floor(m * 0.05) + 1) AS typical
  FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target),
 p AS (SELECT round(inside / n, 6) AS cohesion, round(1 - least(1.0::DOUBLE, typical / 50), 6) AS coupling, round(1 - least(1.0::DOUBLE, up / n), 6) AS layers, round(1 - least(1.0::DOUBLE, c / 5), 6) AS cycles FROM e),
 x AS (SELECT *, round(0.25::DOUBLE * cohesion + 0.25::DOUBLE * coupling + 0.2::DOUBLE * layers + 0.2::DOUBLE * cycles + 0.1::DOUBLE, 4) AS score FROM p)
 SELECT *, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.65 THEN 'C' WHEN score >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM x""", oracle.DEGREES, oracle.SCC))  # fmt: skip
add("architecture_score_sales", SALES, score.architecture_score)
add("decay", RING, score.decay)
add("service_candidates", SALES, score.service_candidates)
add("inversions", TRADE, score.inversions, oracle.trade(""", m AS (SELECT DISTINCT split_part(source, '::', 1) AS source, split_part(target, '::', 1) AS target FROM edges)
 SELECT source, target, (SELECT count(*) FROM m x WHERE x.target = m.target AND x.source <> x.target)::BIGINT AS fan_in FROM m WHERE source < target"""))  # fmt: skip
add("patterns", RING, score.patterns)
add("wide_nodes", TRADE, score.wide_nodes, oracle.trade(" SELECT id, fan_out FROM deg WHERE fan_out > 10 ORDER BY fan_out DESC, id LIMIT 15", oracle.DEGREES))
add("hidden_coupling", SALES, score.hidden_coupling, "SELECT NULL::VARCHAR AS a, NULL::VARCHAR AS b, 0::BIGINT AS shared WHERE false")


def changed(run) -> Query:
    return lambda spark, sf_dir: run(RING(spark, sf_dir), simulate.change_set(spark, [("add", "r3::NATION_13", "r0::NATION_0"), ("remove", "r0::NATION_0", "r1::NATION_1")]))


query("simulate_metrics", oracle.ring(""", e AS (SELECT 'before' AS side, source, target FROM edges UNION ALL SELECT 'after', source, target FROM edges WHERE NOT (source = 'r0::NATION_0' AND target = 'r1::NATION_1') UNION ALL SELECT 'after', 'r3::NATION_13', 'r0::NATION_0'),
 m AS (SELECT side, 'edge_count' AS metric, count(*)::DOUBLE AS v FROM e GROUP BY side UNION ALL SELECT side, 'node_count', 25 FROM e GROUP BY side UNION ALL SELECT side, 'density', round(count(*) / 600, 6) FROM e GROUP BY side
  UNION ALL SELECT side, 'max_fan_in', max(c) FROM (SELECT side, count(*)::DOUBLE AS c FROM e GROUP BY side, target) GROUP BY side UNION ALL SELECT side, 'max_fan_out', max(c) FROM (SELECT side, count(*)::DOUBLE AS c FROM e GROUP BY side, source) GROUP BY side)
 SELECT metric, max(v) FILTER (side = 'before') AS before, max(v) FILTER (side = 'after') AS after, round(max(v) FILTER (side = 'after') - max(v) FILTER (side = 'before'), 6) AS delta, false AS regression FROM m GROUP BY metric"""))(
    changed(lambda g, c: simulate.simulate(g, c)["metrics"]))
query("simulate_assess")(changed(simulate.assess))
query("structural_effects")(changed(simulate.structural_effects))
query("simulate_edges_delta", oracle.ring(" SELECT count(*)::BIGINT AS n FROM edges WHERE NOT (source = 'r0::NATION_0' AND target = 'r1::NATION_1')").replace("count(*)::BIGINT", "(count(*) + 1)::BIGINT"))(
    changed(lambda g, c: simulate.apply_changes(g, c).edges.agg(F.count("*").alias("n"))))

PLAN = [
    ("rename_node", "supplier::4", "supplier::four"), ("remove_node", "supplier::2"), ("add_node", "supplier::2"), ("add_edge", "supplier::2", "supplier::four"), ("add_edge", "supplier::four", "customer::0"),
    ("remove_edge", "supplier::6", "supplier::7"), ("add_edge", "supplier::9", "supplier::3", "event"), ("remove_node", "customer::9"), ("rename_node", "supplier::four", "supplier::04"),
]
PLANNED = """planned AS (
  SELECT replace('/' || source || '/', '/supplier::4/', '/supplier::04/') AS s, replace('/' || target || '/', '/supplier::4/', '/supplier::04/') AS t FROM edges
  WHERE source NOT IN ('supplier::2', 'customer::9') AND target NOT IN ('supplier::2', 'customer::9') AND NOT (source = 'supplier::6' AND target = 'supplier::7' AND edge_type = 'call')
  UNION ALL VALUES ('/supplier::2/', '/supplier::04/'), ('/supplier::04/', '/customer::0/'), ('/supplier::9/', '/supplier::3/')
), wire AS (SELECT s[2:-2] AS source, t[2:-2] AS target FROM planned)"""


def laid_over(run) -> Query:
    return on(PARTNERS, lambda g: run(planned.planned(g, planned.change_list(g.nodes.sparkSession, PLAN))))


query("planned_edges", oracle.partners(" SELECT source, target, count(*)::BIGINT AS n FROM wire GROUP BY ALL", PLANNED))(laid_over(lambda g: g.edges.groupBy("source", "target").agg(F.count("*").alias("n"))))
query("planned_nodes", oracle.partners(" SELECT replace(id || '/', 'supplier::4/', 'supplier::04/').replace('/', '') AS id FROM nodes WHERE id <> 'customer::9'"))(laid_over(lambda g: g.nodes.select("id")))
query("planned_dependents", oracle.partners(" SELECT node AS id FROM walk WHERE node <> 'supplier::04'", PLANNED, "walk(node) AS (SELECT source FROM wire WHERE target = 'supplier::04' UNION SELECT w.source FROM walk JOIN wire w ON w.target = walk.node)"))(
    laid_over(lambda g: traverse.dependents(g, "supplier::04").select("id").where("id <> 'supplier::04'")))



def partner_moves(g: Graph) -> DataFrame:
    """Changes of the partners graph: edges back within a row go, the end of a row calls its beginning, some
    customers call a supplier further on."""
    name = lambda kind, key: F.concat(F.lit(kind + "::"), key.cast("string"))
    n, at = g.nodes.select("id", "line"), F.col("line")
    s, c = n.where("id like 'supplier%'"), n.where("id like 'customer%' and line % 150 = 0")
    parts = [
        s.where("line % 8 = 5").select(F.concat(F.lit("cut "), at).alias("candidate"), F.lit("remove").alias("change"), name("supplier", at).alias("source"), name("supplier", at - 3).alias("target")),
        s.where("line % 8 = 7").select(F.concat(F.lit("wrap "), at), F.lit("add"), name("supplier", at), name("supplier", at - 7)),
        c.select(F.concat(F.lit("far "), at), F.lit("add"), name("customer", at), name("supplier", F.expr("line div 15 + 9"))),
    ]
    return parts[0].union(parts[1]).union(parts[2])


add("candidate_metrics", PARTNERS, lambda g: search.scored(search.evaluate(g, partner_moves(g))), oracle.partners(""", counted AS (
  SELECT candidate, count(*) AS n, count(*) FILTER (s.file IS DISTINCT FROM t.file) AS outside FROM wire LEFT JOIN nodes s ON s.id = source LEFT JOIN nodes t ON t.id = target GROUP BY candidate
), fan AS (SELECT candidate, max(k) AS k FROM (SELECT candidate, source, count(*) AS k FROM wire GROUP BY ALL) GROUP BY candidate
), now AS (SELECT count(*) AS n, count(*) FILTER (s.file <> t.file) AS outside, (SELECT max(k) FROM (SELECT count(*) AS k FROM edges GROUP BY source)) AS k FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target
), x AS (
  SELECT m.candidate, c.n::BIGINT AS edges, round(c.outside / c.n, 6) AS coupling, round(now.outside / now.n, 6) AS coupling_before,
    (SELECT count(*) FROM nodes s, nodes t WHERE m.change = 'add' AND s.id = m.source AND t.id = m.target AND s.layer < t.layer)::BIGINT AS violations_added, f.k::BIGINT AS max_fan_out, now.k::BIGINT AS max_fan_out_before,
    (m.change = 'add' AND EXISTS (SELECT 1 FROM walk w WHERE w.candidate = m.candidate AND o = m.target AND node = m.source))::BIGINT AS cycles_closed,
    (m.change = 'remove' AND EXISTS (SELECT 1 FROM walk w WHERE w.candidate = '' AND o = m.target AND node = m.source)
      AND NOT (EXISTS (SELECT 1 FROM walk w WHERE w.candidate = m.candidate AND o = m.target AND node = m.source) AND EXISTS (SELECT 1 FROM walk w WHERE w.candidate = m.candidate AND o = m.source AND node = m.target)))::BIGINT AS cycles_opened
  FROM move m JOIN counted c USING (candidate) JOIN fan f USING (candidate), now
)
SELECT *, cycles_closed = 0 AS safe, round(CASE WHEN cycles_closed = 0 THEN least(1.0::DOUBLE, CASE WHEN coupling > 0 THEN 0.25::DOUBLE * greatest(0, least(1, 0.5 + 5 * (coupling_before - coupling))) ELSE 0.125 END
  + 0.15::DOUBLE * greatest(0, least(1, (max_fan_out_before - max_fan_out) / 5)) + CASE WHEN violations_added = 0 THEN 0.1::DOUBLE ELSE 0 END + 0.05::DOUBLE + 0.1::DOUBLE * cycles_opened) ELSE -1 END, 6)::DOUBLE AS score FROM x""",
    """move AS (
  SELECT 'cut ' || s_suppkey AS candidate, 'remove' AS change, 'supplier::' || s_suppkey AS source, 'supplier::' || (s_suppkey - 3) AS target FROM supplier WHERE s_suppkey % 8 = 5
  UNION ALL SELECT 'wrap ' || s_suppkey, 'add', 'supplier::' || s_suppkey, 'supplier::' || (s_suppkey - 7) FROM supplier WHERE s_suppkey % 8 = 7
  UNION ALL SELECT 'far ' || c_custkey, 'add', 'customer::' || c_custkey, 'supplier::' || (c_custkey // 15 + 9) FROM customer WHERE c_custkey % 150 = 0
), wire AS (
  SELECT m.candidate, e.source, e.target FROM move m, edges e WHERE NOT (m.change = 'remove' AND e.source = m.source AND e.target = m.target) UNION ALL SELECT candidate, source, target FROM move WHERE change = 'add'
  UNION ALL SELECT '', source, target FROM edges
), ask AS (SELECT candidate, source AS o FROM move UNION SELECT candidate, target FROM move UNION SELECT '', target FROM move WHERE change = 'remove'
), walk(candidate, o, node) AS (SELECT a.candidate, a.o, w.target FROM ask a JOIN wire w ON w.candidate = a.candidate AND w.source = a.o UNION SELECT k.candidate, k.o, w.target FROM walk k JOIN wire w ON w.candidate = k.candidate AND w.source = k.node)"""))  # fmt: skip
add("arch_search", PARTNERS, lambda g: search.search(g, partner_moves(g), 3, 2).select("round", "place", "candidate", "score", "cycles_opened"))


def rated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates: prices, sizes and keys stand for what is predicted of them."""
    p = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(
        k.alias("candidate"), (k * 7919 % 101 / 100.0).alias("predicted_score"), (k * 104729 % 61 / 100.0).alias("predicted_coupling"), (k * 15485863 % 9).cast("int").alias("predicted_cycles"),
        (k * 32452843 % 40).cast("int").alias("predicted_max_fan_out"), (k % 4).cast("int").alias("predicted_god_modules"),
    )
    return search.objectives(rows, spark.createDataFrame([(0.4, 0.5, 8)], "score double, coupling double, cycles int"))


RATED = """WITH p AS (SELECT p_partkey AS candidate, p_partkey::HUGEINT AS k FROM part), x AS (
 SELECT candidate, round(least(1, (k * 7919 % 101)::DOUBLE / 100), 6) AS modularity, round(greatest(0, least(1, (0.5::DOUBLE - (k * 104729 % 61)::DOUBLE / 100) / 0.5)), 6) AS coupling_reduction,
  round(greatest(0, (8 - (k * 15485863 % 9)::DOUBLE) / 8), 6) AS cycle_reduction, round(greatest(0, 1::DOUBLE - (k * 32452843 % 40)::DOUBLE / 50 - (k % 4)::DOUBLE * 0.1::DOUBLE), 6) AS maintainability FROM p
), r AS (SELECT *, round(0.4::DOUBLE * modularity + 0.3::DOUBLE * coupling_reduction + 0.2::DOUBLE * cycle_reduction + 0.1::DOUBLE * maintainability, 6) AS objective_score FROM x)"""
query("objective_scores", RATED + " SELECT candidate, modularity, coupling_reduction, cycle_reduction, maintainability, objective_score FROM r WHERE modularity >= 0.4::DOUBLE * 0.98")(
    lambda spark, d: search.without_degrading(rated_parts(spark, d), 0.4).select("candidate", *search.OBJECTIVES, "objective_score"))
query("objective_front", RATED + """ SELECT candidate FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.modularity >= r.modularity AND o.coupling_reduction >= r.coupling_reduction AND o.cycle_reduction >= r.cycle_reduction
 AND o.maintainability >= r.maintainability AND (o.modularity > r.modularity OR o.coupling_reduction > r.coupling_reduction OR o.cycle_reduction > r.cycle_reduction OR o.maintainability > r.maintainability))""")(
    lambda spark, d: search.non_dominated(rated_parts(spark, d)).select("candidate"))

# ---- events, documents, pages

query("event_transitions", """SELECT event_type AS source, nxt AS target, count(*)::BIGINT AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY ALL""")(
    lambda spark, d: views.flow(spark, d).edges.groupBy("source", "target").agg(F.count("*").alias("n")))
query("event_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")(lambda spark, d: events.tumbling(views.table(spark, d, "events")))
query("event_sliding", """SELECT start, count(*)::BIGINT AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS start FROM events) GROUP BY start""")(
    lambda spark, d: events.sliding(views.table(spark, d, "events")).select("start", "n"))
query("event_sessions", """WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL 1 DAY)::INT, 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")(
    lambda spark, d: events.sessions(views.table(spark, d, "events")))
query("interaction_patterns", oracle.sales(" SELECT split_part(source, '::', 1) AS source_kind, split_part(target, '::', 1) AS target_kind, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM edges), 6) AS share FROM edges GROUP BY ALL"))(
    lambda spark, d: history.interactions(SALES(spark, d).edges))
query("document_domains", "SELECT domain, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{k}' END" for k, w in text.DOMAINS.items()) + "], lambda x: x IS NOT NULL)) AS domain FROM documents) GROUP BY domain")(
    lambda spark, d: views.table(spark, d, "documents").select(F.lower("text").alias("low")).select(F.explode(text.domains_in("low")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n")))
query("page_hosts", "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*)::BIGINT AS n FROM pages GROUP BY host")(
    lambda spark, d: views.table(spark, d, "pages").groupBy(text.host_of("url").alias("host")).agg(F.count("*").alias("n")))
query("web_links", """SELECT edge_type, count(*)::BIGINT AS n, count(DISTINCT target)::BIGINT AS targets FROM (SELECT 'call' AS edge_type, regexp_extract(url, '^https?://([^/?#]+)', 1) AS target FROM pages
 UNION ALL SELECT 'dataflow', unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages) GROUP BY edge_type""")(
    lambda spark, d: views.web(spark, d).edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets")))
query("score_trend", """WITH h AS (SELECT date_trunc('month', o_orderdate) AS at, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS score FROM orders GROUP BY 1), t AS (SELECT at, score, score - lag(score) OVER (ORDER BY at) AS delta FROM h)
 SELECT at, score, round(delta, 6) AS delta, CASE WHEN delta > 0.05 THEN 'improving' WHEN delta < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM t""".replace(" at", " \"at\"").replace("SELECT at", "SELECT \"at\""))(
    lambda spark, d: history.score_trend(views.table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("at")).agg(F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 6).alias("score"))))

# ---- evidence, governance, semantics, planning


def filed(run) -> Query:
    """Over the ring graph with its files as communities."""
    return lambda spark, d: (lambda g: run(g, g.nodes.select("id", F.col("file").alias("partition_id"))))(RING(spark, d))


TEST_WALK = "walk(o, node) AS (SELECT source, target FROM edges JOIN nodes ON id = source WHERE layer = 4 UNION SELECT o, e.target FROM walk w JOIN edges e ON e.source = w.node)"
query("boundary_coverage", oracle.ring(""" SELECT file AS partition_id, count(DISTINCT id)::BIGINT AS size, count(DISTINCT o)::BIGINT AS tests, CASE WHEN count(o) > 0 THEN 'covered' ELSE 'zero_coverage' END AS status
 FROM nodes LEFT JOIN walk ON node = id AND o <> node GROUP BY file""", TEST_WALK))(filed(evidence.boundary_coverage))  # fmt: skip
query("flow_coverage", oracle.ring(""", c AS (SELECT node, count(DISTINCT o)::BIGINT AS n FROM walk WHERE o <> node GROUP BY node)
 SELECT source, target, coalesce(x.n, 0)::BIGINT AS tests_source, coalesce(y.n, 0)::BIGINT AS tests_target, CASE WHEN x.n > 0 THEN 'covered' WHEN y.n > 0 THEN 'one_sided' ELSE 'untested' END AS status
 FROM edges LEFT JOIN c x ON x.node = source LEFT JOIN c y ON y.node = target WHERE split_part(source, '::', 1) <> split_part(target, '::', 1)""", TEST_WALK))(filed(evidence.flow_coverage))  # fmt: skip
query("test_attribution", oracle.ring(""" SELECT id AS test, count(DISTINCT split_part(node, '::', 1))::BIGINT AS boundaries, CASE count(DISTINCT split_part(node, '::', 1)) WHEN 0 THEN 'orphan' WHEN 1 THEN 'clear' ELSE 'ambiguous' END AS kind
 FROM nodes LEFT JOIN walk ON o = id AND node <> id WHERE layer = 4 GROUP BY id""", TEST_WALK))(filed(evidence.test_attribution))  # fmt: skip

POLICIES = [
    {"id": "large", "kind": "no_large_modules", "threshold": 24},
    {"id": "size", "kind": "max_subsystem_size", "threshold": 100},
    {"id": "coupling", "kind": "coupling_limit", "threshold": 0.3},
    {"id": "dep", "kind": "forbidden_subsystem_dep", "target": "orders->part; nation->part"},
    {"id": "only", "kind": "allowed_subsystem_deps", "target": "orders->part; orders->customer; orders->supplier; customer->nation"},
    {"id": "cycle", "kind": "forbidden_subsystem_cycle"},
    {"id": "plan", "kind": "no_apply_without_plan", "operation": "apply"},
]
add("policies", SALES, lambda g: governance.evaluate(g, g.nodes.select("id", F.col("file").alias("subsystem")), POLICIES), oracle.sales(""", f AS (SELECT file, count(*) AS n FROM nodes GROUP BY file),
 x AS (SELECT split_part(source, '::', 1) AS a, split_part(target, '::', 1) AS b, count(*) AS n FROM edges GROUP BY ALL)
 SELECT 'large' AS policy_id, file AS subject, n::VARCHAR AS detail FROM f WHERE n > 24 UNION ALL SELECT 'size', file, n::VARCHAR FROM f WHERE n > 100 UNION ALL SELECT 'coupling', 'coupling', '1.0'
 UNION ALL SELECT 'dep', a || '->' || b, n::VARCHAR FROM x WHERE a = 'orders' AND b = 'part' UNION ALL SELECT 'only', a || '->' || b, n::VARCHAR FROM x WHERE a IN ('nation', 'supplier') UNION ALL SELECT 'plan', 'apply', 'no plan'"""))  # fmt: skip
add("scope_slice", SALES, lambda g: planning.scope_slice(g, "nation").groupBy("direction").agg(F.count("*").alias("n")), oracle.sales(""" SELECT CASE WHEN source LIKE 'nation%' THEN 'outbound' ELSE 'inbound' END AS direction, count(DISTINCT (source, target))::BIGINT AS n
 FROM edges WHERE source LIKE 'nation%' OR target LIKE 'nation%' GROUP BY 1"""))  # fmt: skip
add("focus_slice", RING, lambda g: planning.focus_slice(g, "nation_17"), oracle.ring(""" SELECT id, min(d)::INT AS depth, any_value(fan_in) AS fan_in, any_value(fan_out) AS fan_out FROM deg JOIN (SELECT 'r2::NATION_17' AS x, 0 AS d
 UNION ALL SELECT source, 1 FROM edges WHERE target = 'r2::NATION_17' UNION ALL SELECT target, 1 FROM edges WHERE source = 'r2::NATION_17') ON x = id GROUP BY id""", oracle.DEGREES))  # fmt: skip
add("slice_metrics", RING, lambda g: planning.slice_metrics(g, g.nodes.where("file in ('r0', 'r1')").select("id")), oracle.ring(""", e AS (SELECT * FROM edges WHERE source[1:2] IN ('r0', 'r1') AND target[1:2] IN ('r0', 'r1')),
 n AS (SELECT count(*)::BIGINT AS nodes FROM nodes WHERE file IN ('r0', 'r1'))
 SELECT nodes, (SELECT count(*) FROM e)::BIGINT AS edges, (SELECT count(*) FROM e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.layer < t.layer)::BIGINT AS layer_violations,
  (SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM e GROUP BY source))::BIGINT AS max_fan_out, round((SELECT count(*) FROM e) / nodes, 6) AS mean_fan_out FROM n"""))  # fmt: skip
query("touched_partitions", "SELECT 'r1' AS partition_id, count(*)::BIGINT AS nodes FROM nation WHERE n_regionkey = 1")(
    filed(lambda g, parts: planning.touched_partitions(g, parts, g.nodes.where("file = 'r1'").select("file"))))


@query("coverage_plan", oracle.sales(""" SELECT 'missing_module' AS kind, 'invoice' AS subject, 2 AS priority UNION ALL SELECT 'missing_function', 'nation::99', 3 UNION ALL SELECT 'missing_link', 'part -> nation', 2 UNION ALL SELECT 'denied_link', 'orders -> part', 1"""))
def coverage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    pairs = "source string, target string"
    return planning.coverage_plan(SALES(spark, sf_dir), table([("orders",), ("invoice",)], "module string"), table([("nation::1",), ("nation::99",)], "id string"), table([("orders", "part"), ("part", "nation")], pairs), table([("orders", "part"), ("part", "orders")], pairs))


def described_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources, for what semantics tell of texts."""
    d = views.table(spark, sf_dir, "documents")
    return semantics.describe(d.select(F.concat(F.col("source"), F.lit("::get_"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("file"), F.col("text").alias("body")))


query("semantic_summary", """WITH p AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{name}', '{p.replace(chr(39), chr(39) * 2)}')" for p, k, name in text.EFFECTS) + """) v(value, name, re))
 SELECT 'action' AS kind, 'read' AS value, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'effect', value, count(*)::BIGINT FROM (SELECT DISTINCT doc_id, value, name FROM documents, p WHERE regexp_matches(text, re)) GROUP BY value""")(
    lambda spark, d: semantics.summary(described_documents(spark, d)).where("kind <> 'tag'"))
query("effect_rows", """WITH s AS (SELECT o_orderkey AS k, ['x.execute(q)', 'requests.get(u); httpx.post(u)', 'with open(p) as f: f.read()', 'logger.info(1); logging.debug(2)', 'y.publish(m)', 'return 1', 'os.environ["A"]'][1 + o_custkey % 7] AS body FROM orders)
 SELECT effect_type, target, description, count(*)::BIGINT AS n FROM s JOIN (VALUES (0, 'database_write', '.execute(', 'SQL execute'), (1, 'network_call', 'requests.get', 'HTTP request'), (2, 'file_write', 'open(', 'File open'), (2, 'file_read', '.read(', 'File read'),
 (3, 'logging', 'logger.', 'Logging'), (4, 'message_publish', '.publish', 'Message publish'), (6, 'environment_read', 'os.environ', 'Env var access')) v(i, effect_type, target, description)
 ON body = ['x.execute(q)', 'requests.get(u); httpx.post(u)', 'with open(p) as f: f.read()', 'logger.info(1); logging.debug(2)', 'y.publish(m)', 'return 1', 'os.environ["A"]'][1 + i] GROUP BY ALL""")(
    lambda spark, d: views.table(spark, d, "orders").select(F.explode(text.effect_rows(F.element_at(F.array(*map(F.lit, ("x.execute(q)", "requests.get(u); httpx.post(u)", "with open(p) as f: f.read()", "logger.info(1); logging.debug(2)", "y.publish(m)", "return 1", 'os.environ["A"]'))), (F.col("o_custkey") % 7 + 1).cast("int")))).alias("e"))
    .select("e.*").groupBy("effect_type", "target", "description").agg(F.count("*").alias("n")))

add("mermaid", RING, formats.mermaid)
add("json_rows", RING, lambda g: formats.as_json(g.edges), oracle.ring(""" SELECT '{"confidence":"static","edge_type":"call","source":"' || source || '","target":"' || target || '"}' AS value FROM edges"""))


@query("latest_events", "SELECT user_id, arg_max(event_id, ts * 1000000000::HUGEINT + event_id) AS event_id FROM (SELECT user_id, event_id, epoch_us(ts)::HUGEINT AS ts FROM events) GROUP BY user_id")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, from a state that takes the events in by twelve batches of time."""
    e = views.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    first, last = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).head()
    state = KeyedState(spark, fresh_path(spark, "graphloom-state"), ["user_id"], "at", buckets=4)
    if first is None:
        return e.select("user_id", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    batch = F.least(F.floor((at - first) * 12 / (last - first + 1)), F.lit(11))
    rows = durable(e.select("user_id", "event_id", F.struct(at.alias("t"), "event_id").alias("at"), batch.alias("batch")))
    for number in range(12):
        state.write(rows.where(F.col("batch") == number).drop("batch"), number)
    return state.read().select("user_id", "event_id")


catalog_tables.register(query, on, by_file)
