"""Queries of operators that work on tables beside a graph: noisy edges, merges, renames, annotations,
histories, experiments, semantics. They read the driver's tables whole, and each has SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, validate
from graphloom.operators import diff, history, lookup, planning, policy, score, semantics
from graphloom.sources import views

from . import oracle
from .expressions import Engine


def register(query, on, by_file) -> None:
    """Registers the queries with the catalog's own functions."""
    partners, table = views.partners, views.table

    # ---- edges that are noise

    targets = ("logging.info", "os.path.join", "part::__eq__", "Part::__init__", "tests::conftest_data", "x::json.loads", "parts::print")

    def noisy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        line = table(spark, sf_dir, "lineitem")
        target = F.concat(F.lit("part::"), F.col("l_partkey").cast("string"))
        for k, name in enumerate(targets):
            target = F.when(F.col("l_partkey") % 8 == k, name).otherwise(target)
        edges = line.select(views.node_id("orders", "l_orderkey").alias("source"), target.alias("target"), F.lit("call").alias("edge_type"), F.lit("static").alias("confidence"))
        nodes = table(spark, sf_dir, "orders").select(views.node_id("orders", "o_orderkey").alias("id"), F.lit("orders").alias("file"), F.lit("function").alias("type"))
        filters = [("dataclass", lookup.dataclass_edges(["Part"])), ("dunder", lookup.dunder_edges()), ("logging", lookup.logging_edges()), ("stdlib", lookup.stdlib_edges()), ("harness", lookup.harness_edges())]
        return lookup.filter_edges(Graph(nodes, edges), filters)

    query("edge_filters", """SELECT ['logging', 'stdlib', 'dunder', 'dataclass', 'harness', 'stdlib', 'logging'][1 + l_partkey % 8] AS filter, count(*)::BIGINT AS removed FROM lineitem WHERE l_partkey % 8 < 7 GROUP BY 1""")(lambda s, d: noisy(s, d)[1])
    query("edge_filters_kept", "SELECT 'part::' || l_partkey AS target, count(*)::BIGINT AS n FROM lineitem WHERE l_partkey % 8 = 7 GROUP BY l_partkey")(lambda s, d: noisy(s, d)[0].groupBy("target").agg(F.count("*").alias("n")))

    # ---- merges, deltas, renames

    def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = views.sales(spark, sf_dir).edges
        return diff.merge_edges(e.where("edge_type <> 'event'"), e.where("confidence <> 'static'"), e).groupBy("edge_type", "confidence").agg(F.count("*").alias("n"))

    query("merged_edges", oracle.sales(" SELECT edge_type, confidence, count(DISTINCT source || '>' || target)::BIGINT AS n FROM edges GROUP BY ALL"))(merged)

    def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = partners(spark, sf_dir).nodes
        new = n.where("line % 10 = 1").withColumn("body_hash", F.lit("new"))
        return diff.merge_nodes(n, n.where("line % 10 in (1, 2)").select("id"), new).select("id", (F.col("body_hash") == "new").alias("fresh"))

    query("merged_nodes", oracle.partners(" SELECT id, line % 10 = 1 AS fresh FROM nodes WHERE line % 10 <> 2"))(merged_nodes)
    query("affected_files", oracle.partners(""" SELECT DISTINCT file FROM (SELECT s.file FROM edges JOIN nodes s ON s.id = source WHERE split_part(target, '::', 2) IN (SELECT split_part(id, '::', 2) FROM nodes WHERE file = 'suppliers1')
 UNION ALL SELECT 'suppliers1')"""))(on(partners, lambda g: diff.affected_files(g, g.nodes.where("file = 'suppliers1'").select("file").distinct())))

    def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.col("doc_id")
        docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.concat(F.sha1(F.coalesce("text", F.lit(""))), F.lit("/"), k.cast("string")).alias("own"))
        old = docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("d/"), k.cast("string")).alias("path"), F.col("own").alias("content_hash"))
        new = docs.where("doc_id % 3 <> 1 or doc_id % 5 = 0").select(
            F.concat(F.when(k % 5 == 0, "moved/").otherwise("d/"), k.cast("string")).alias("path"), F.when(k % 7 == 0, F.concat("own", F.lit("+"))).otherwise(F.col("own")).alias("content_hash")
        )
        return diff.changed_paths(old, new).groupBy("change", (F.col("old_path").isNotNull()).alias("from")).agg(F.count("*").alias("n"), F.min("path").alias("first"))

    query("changed_paths", """WITH d AS (SELECT doc_id AS k FROM documents WHERE doc_id IS NOT NULL), x AS (
 SELECT k, k % 3 <> 0 AS was, k % 3 <> 1 OR k % 5 = 0 AS is_, k % 5 = 0 AS moved, k % 7 = 0 AS edited FROM d
), c AS (
 SELECT 'moved/' || k AS path, CASE WHEN was AND NOT edited THEN 'renamed' ELSE 'added' END AS change FROM x WHERE is_ AND moved
 UNION ALL SELECT 'd/' || k, 'added' FROM x WHERE is_ AND NOT moved AND NOT was
 UNION ALL SELECT 'd/' || k, 'modified' FROM x WHERE is_ AND NOT moved AND was AND edited
 UNION ALL SELECT 'd/' || k, 'removed' FROM x WHERE was AND (NOT is_ OR moved AND edited))
SELECT change, change = 'renamed' AS "from", count(*)::BIGINT AS n, min(path) AS first FROM c GROUP BY change""")(changed_paths)

    def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = partners(spark, sf_dir).edges
        s = table(spark, sf_dir, "supplier").select("s_suppkey")
        predicted = s.select(views.node_id("supplier", "s_suppkey").alias("source"), F.concat(F.lit("supplier::"), (F.col("s_suppkey") + 1).cast("string")).alias("target"))
        return diff.reconcile(predicted, e.where("source like 'supplier%' and target like 'supplier%'"))

    query("reconcile", oracle.partners(""" SELECT coalesce(p.source, a.source) AS source, coalesce(p.target, a.target) AS target, CASE WHEN a.source IS NULL THEN 'missing' WHEN p.source IS NULL THEN 'unexpected' ELSE 'matched' END AS status
 FROM (SELECT 'supplier::' || s_suppkey AS source, 'supplier::' || (s_suppkey + 1) AS target FROM supplier) p
 FULL JOIN (SELECT DISTINCT source, target FROM edges WHERE starts_with(source, 's') AND starts_with(target, 's')) a ON p.source = a.source AND p.target = a.target"""))(reconciled)

    def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer").select(views.node_id("nation", "c_nationkey").alias("id"), F.col("c_mktsegment").alias("file"), F.col("c_custkey").cast("int").alias("line"))
        return diff.number_collisions(c)

    query("number_collisions", """SELECT 'nation::' || c_nationkey || CASE WHEN r > 1 THEN '[' || r || ']' ELSE '' END AS id, c_mktsegment AS file, c_custkey::INT AS line
 FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS r FROM customer)""")(collisions)

    # ---- annotations and layers

    def intended(spark: SparkSession, sf_dir: str) -> Graph:
        g = partners(spark, sf_dir)
        line = F.col("line")
        notes = g.nodes.where("line % 6 <> 5").select(F.when(line % 11 == 3, F.concat(F.lit("gone::"), "id")).otherwise(F.col("id")).alias("id"), F.when(line % 4 == 0, F.lit(" ")).otherwise("serve").alias("intent"), F.when(line % 5 == 0, F.lit("old")).otherwise(F.col("body_hash")).alias("intent_body_hash"))
        return Graph(g.nodes, g.edges, notes)

    note = "note AS (SELECT id AS node, CASE WHEN line % 11 = 3 THEN 'gone::' || id ELSE id END AS id, line % 4 = 0 AS blank, line % 5 = 0 AS old FROM nodes WHERE line % 6 <> 5)"
    query("missing_intents", oracle.partners(" SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM note WHERE NOT blank)", note))(on(intended, diff.missing_intents))
    query("stale_intents", oracle.partners(" SELECT id, CASE WHEN starts_with(id, 'gone') THEN 'node_missing' ELSE 'body_changed' END AS reason FROM note WHERE starts_with(id, 'gone') OR old", note))(on(intended, diff.stale_intents))
    query("alignment", oracle.partners(""" SELECT id, 'missing' AS problem FROM nodes WHERE id NOT IN (SELECT id FROM note WHERE NOT blank)
 UNION ALL SELECT id, CASE WHEN starts_with(id, 'gone') THEN 'stale' ELSE 'changed' END FROM note WHERE starts_with(id, 'gone') OR old""", note))(on(intended, planning.alignment))

    def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = partners(spark, sf_dir).nodes
        line, tags = F.col("line"), F.array(F.col("file"))
        old = n.where("line % 3 <> 0").select("id", F.lit("old").alias("intent"), F.lit(2).alias("layer"), F.lit("service").alias("arch_layer"), tags.alias("tags"), (line % 4).alias("intent_version"))
        new = n.where("line % 2 = 0").select("id", F.lit("new").alias("intent"), F.lit(3).alias("layer"), F.when(line % 8 == 0, "domain").otherwise("").alias("arch_layer"), tags.alias("tags"))
        return diff.upsert_annotations(old, new).select("id", "intent", "layer", "arch_layer", "intent_version")

    query("upsert_annotations", oracle.partners(""" SELECT id, CASE WHEN line % 2 = 0 THEN 'new' ELSE 'old' END AS intent, CASE WHEN line % 2 = 0 THEN 3 ELSE 2 END AS layer,
 CASE WHEN line % 8 = 0 THEN 'domain' WHEN line % 3 <> 0 THEN 'service' ELSE '' END AS arch_layer, (CASE WHEN line % 3 <> 0 THEN line % 4 ELSE 0 END + (line % 2 = 0)::INT)::INT AS intent_version
 FROM nodes WHERE line % 2 = 0 OR line % 3 <> 0"""))(upserted)

    def relayered(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = partners(spark, sf_dir)
        over = planning.override_layers(g.described(), [("prefix", "suppliers1", 4), ("contains", "ers2", 4), ("prefix", "customers3", 1)]).select("id", "layer", "arch_layer")
        return planning.layer_changes(g, Graph(g.nodes, g.edges, over))

    query("layer_changes", oracle.partners(""" SELECT id, layer AS before, after, layer IN (3, 4) AND after IN (3, 4) AS safe FROM (SELECT *, CASE WHEN starts_with(file, 'suppliers1') OR contains(file, 'ers2') THEN 4 WHEN starts_with(file, 'customers3') THEN 1 ELSE layer END AS after FROM nodes)
 WHERE after <> layer"""))(relayered)
    query("transitive_layers", oracle.partners(""" SELECT DISTINCT o AS origin, node FROM walk JOIN nodes s ON s.id = o JOIN nodes t ON t.id = node WHERE s.layer < t.layer""",
        "walk(o, node, d) AS (SELECT source, target, 1 FROM edges UNION SELECT w.o, e.target, w.d + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE w.d < 3)"))(on(partners, lambda g: policy.transitive_layer_violations(g, 3)))
    query("target_delta", oracle.partners(""" SELECT 'node' AS kind, 'supplier::' || (s_suppkey + 1000000) AS subject, 'to_add' AS change FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'node', id, 'to_remove' FROM nodes WHERE starts_with(id, 's') AND line % 4 = 0
 UNION ALL SELECT DISTINCT 'edge', source || ' -> ' || target, 'to_remove' FROM edges WHERE edge_type = 'event'"""))(
        on(partners, lambda g: history.target_delta(g.nodes.withColumn("id", F.when(F.col("id").startswith("s") & (F.col("line") % 4 == 0), F.concat(F.lit("supplier::"), (F.col("line") + 1_000_000).cast("string"))).otherwise(F.col("id"))), g.nodes, g.edges.where("edge_type <> 'event'"), g.edges)))

    def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = partners(spark, sf_dir)
        k = F.regexp_extract("file", "([0-9]+)$", 1).cast("int")
        declared = g.nodes.select("file").distinct().where(k % 5 != 4).select(F.concat(F.substring("file", 1, 1), (k % 3).cast("string")).alias("subsystem"), F.col("file").alias("module"))
        links = spark.createDataFrame([("c0", "s0"), ("s0", "c0"), ("c1", "s1")], "source string, target string")
        denied = spark.createDataFrame([("s1", "c1", "forbidden"), ("c2", "s2", "forbidden"), ("c0", "s0", "required")], "source string, target string, type string")
        return policy.lock_report(g, declared, links, denied)

    query("lock_report", oracle.partners(""" SELECT 'undeclared_module' AS violation_type, 'warning' AS severity, file AS module, NULL::VARCHAR AS subsystem, NULL::VARCHAR AS other FROM f WHERE sub IS NULL
 UNION ALL SELECT 'forbidden_dependency', 'error', a, sa, b FROM p WHERE (sa, sb) IN (('s1', 'c1'), ('c2', 's2'))
 UNION ALL SELECT 'boundary_violation', 'warning', min(a), sa, sb FROM p WHERE (sa, sb) NOT IN (('c0', 's0'), ('s0', 'c0'), ('c1', 's1')) GROUP BY sa, sb""",
        "f AS (SELECT file, CASE WHEN regexp_extract(file, '[0-9]+$')::INT % 5 <> 4 THEN file[1] || regexp_extract(file, '[0-9]+$')::INT % 3 END AS sub FROM nodes GROUP BY file)",
        "p AS (SELECT DISTINCT x.file AS a, y.file AS b, x.sub AS sa, y.sub AS sb FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target JOIN f x ON x.file = s.file JOIN f y ON y.file = t.file WHERE x.sub <> y.sub)"))(locked)

    # ---- graphs that break the rules

    def broken(spark: SparkSession, sf_dir: str) -> Graph:
        g = partners(spark, sf_dir)
        line = F.col("line")
        nodes = g.nodes.withColumn("type", F.when(line % 7 == 0, "thing").otherwise(F.col("type")))
        nodes = nodes.unionByName(nodes.where("line % 11 = 0")).where("line % 13 <> 5")
        edges = g.edges.withColumn("edge_type", F.when(F.col("source").like("%9"), "wish").otherwise(F.col("edge_type")))
        return Graph(nodes, edges, g.nodes.select("id", F.lit(3).alias("layer"), F.lit("").alias("arch_layer")))

    rest = "n AS (SELECT *, line % 7 = 0 AS odd FROM nodes WHERE line % 13 <> 5), lost AS (SELECT DISTINCT x FROM (SELECT source AS x FROM edges UNION SELECT target FROM edges) WHERE x NOT IN (SELECT id FROM n))"
    query("graph_validation_broken", oracle.partners(""" SELECT kind, count(*)::BIGINT AS n FROM (SELECT 'node_type' AS kind FROM n, range(CASE WHEN line % 11 = 0 THEN 2 ELSE 1 END) WHERE odd UNION ALL SELECT 'repeated_id' FROM n WHERE line % 11 = 0
 UNION ALL SELECT 'unknown_end' FROM lost UNION ALL SELECT 'edge_type' FROM (SELECT DISTINCT source, target FROM edges WHERE ends_with(source, '9'))) GROUP BY kind""", rest))(on(broken, lambda g: validate(g).groupBy("kind").agg(F.count("*").alias("n"))))
    query("consistency_broken", oracle.partners(""" SELECT 'unknown_edge_end' AS problem, count(*)::BIGINT AS n FROM lost UNION ALL SELECT 'stale_annotation', count(*) FROM nodes WHERE line % 13 = 5 UNION ALL SELECT 'repeated_id', count(*) FROM n WHERE line % 11 = 0""", rest))(on(broken, diff.consistency))

    def segments(spark: SparkSession, sf_dir: str) -> Graph:
        """Customers by segment and nation call suppliers by nation."""
        c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
        nodes = c.select(views.node_id("customer", "c_custkey").alias("id"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("file"))
        nodes = nodes.unionByName(s.select(views.node_id("supplier", "s_suppkey").alias("id"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("file")))
        edges = c.select(views.node_id("customer", "c_custkey").alias("source"), F.concat(F.lit("supplier::"), F.expr("cast(c_custkey div 15 as string)")).alias("target"))
        edges = edges.withColumns({"edge_type": F.lit("call"), "confidence": F.lit("static")})
        return Graph(nodes.withColumns({"type": F.lit("function"), "line": F.lit(0), "body_hash": F.lit("")}), edges)

    query("hidden_coupling_segments", """WITH p AS (SELECT DISTINCT c_mktsegment || '-' || c_nationkey AS f, s_nationkey AS used FROM customer JOIN supplier ON s_suppkey = c_custkey // 15)
 SELECT x.f AS a, y.f AS b, count(*)::BIGINT AS shared FROM p x JOIN p y ON x.used = y.used AND x.f < y.f GROUP BY ALL HAVING count(*) >= 4""")(on(segments, lambda g: score.hidden_coupling(g, 4)))
    query("touched_partitions_partners", oracle.partners(" SELECT 'row ' || (line // 40) AS partition_id, count(*)::BIGINT AS nodes FROM nodes WHERE file IN ('suppliers1', 'customers2', 'customers3') GROUP BY 1"))(
        on(partners, lambda g: planning.touched_partitions(g, g.nodes.select("id", F.concat(F.lit("row "), F.expr("cast(line div 40 as string)")).alias("partition_id")), g.nodes.where("file in ('suppliers1', 'customers2', 'customers3')").select("file"))))
    query("module_drift_partners", oracle.partners(""" SELECT file AS module, 'undeclared' AS finding FROM nodes WHERE regexp_extract(file, '[0-9]+$')::INT % 3 = 0 GROUP BY file UNION ALL SELECT DISTINCT 'old-' || file, 'missing' FROM nodes WHERE regexp_extract(file, '[0-9]+$')::INT % 3 = 1"""))(
        on(partners, lambda g: policy.module_drift(g, g.nodes.select("file", (F.regexp_extract("file", "([0-9]+)$", 1).cast("int") % 3).alias("k")).distinct().where("k > 0").select(F.explode(F.when(F.col("k") == 1, F.array("file", F.concat(F.lit("old-"), "file"))).otherwise(F.array("file"))).alias("module")))))
    query("decay_partners", oracle.partners(""" SELECT 'large_cycle' AS finding, component AS subject, count(*)::DOUBLE AS value FROM scc GROUP BY component HAVING count(*) > 3
 UNION ALL SELECT 'coupling_index', '', round((SELECT count(DISTINCT s.file || '>' || t.file) FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.file <> t.file) / (SELECT count(DISTINCT file) FROM nodes), 6)
 UNION ALL SELECT 'god_module', f, max(n)::DOUBLE FROM (SELECT s.file AS f, count(DISTINCT t.file) AS n FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.file <> t.file GROUP BY 1
  UNION ALL SELECT t.file, count(DISTINCT s.file) FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.file <> t.file GROUP BY 1) GROUP BY f HAVING max(n) > 20""", oracle.SCC))(
        lambda s, d: score.decay(by_file(partners)(s, d)).withColumn("subject", F.when(F.col("finding") == "large_cycle", F.regexp_replace(F.regexp_replace("subject", "^.*::", ""), "^(customer|supplier)", "$1::")).otherwise(F.col("subject"))))

    # ---- histories and experiments

    def by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events")
        return e.groupBy(F.to_date("ts").cast("string").alias("at")).agg(F.countDistinct("event_type").alias("nodes"), F.count("*").alias("edges"))

    query("converged", """WITH h AS (SELECT ts::DATE::VARCHAR AS "at", count(DISTINCT event_type) AS nodes, count(*) AS edges FROM events GROUP BY 1)
 SELECT "at", count(*) OVER w = 3 AND min(nodes) OVER w = max(nodes) OVER w AND max(edges) OVER w - min(edges) OVER w <= 0.05::DOUBLE * min(edges) OVER w AS converged FROM h WINDOW w AS (ORDER BY "at" ROWS 2 PRECEDING)""")(lambda s, d: history.converged(by_day(s, d)))
    query("mined_tags", """WITH o AS (SELECT *, floor(o_totalprice)::BIGINT % 100 AS c FROM orders), t AS (SELECT o_orderkey, o_orderstatus, c, unnest([o_orderstatus, o_orderpriority]) AS tag FROM o)
 SELECT tag, count(*)::BIGINT AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS success, round(sum(c)::DOUBLE / count(*), 6) AS avg_delta, array_to_string(list_sort(list(DISTINCT o_orderkey))[1:5], ',') AS examples FROM t GROUP BY tag HAVING count(*) >= 2""")(
        lambda s, d: history.mined_tags(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), (F.col("o_orderstatus") == "F").alias("merged"), (F.floor("o_totalprice") % 100).alias("delta")))
        .withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",")))
    query("strategy_effect", """SELECT l_returnflag AS strategy, count(*)::BIGINT AS n, round(0.5::DOUBLE * avg((l_linestatus = 'F')::INT) + 0.5::DOUBLE * least(1, greatest(0, coalesce(avg(l_linenumber) FILTER (l_linenumber NOT IN (3, 4)), 3) / 100 - 0.03 + 0.5)), 6) AS effect FROM lineitem GROUP BY l_returnflag""")(
        lambda s, d: history.strategy_effect(table(s, d, "lineitem").select(F.col("l_returnflag").alias("strategy"), (F.col("l_linestatus") == "F").alias("success"), F.when(F.col("l_linenumber") == 4, 0.0).otherwise(F.col("l_linenumber") / 100.0 - 0.03).alias("delta"))))
    query("proposal_feedback", """WITH p AS (SELECT o_orderpriority AS task, o_orderstatus = 'F' AS yes, o_orderstatus = 'P' AS no, o_custkey % 3 > 0 AS bad FROM orders UNION ALL SELECT 'all', o_orderstatus = 'F', o_orderstatus = 'P', o_custkey % 3 > 0 FROM orders)
 SELECT task, count(*)::BIGINT AS n, count(*) FILTER (yes)::BIGINT AS accepted, count(*) FILTER (no)::BIGINT AS rejected, round(avg((no OR bad)::INT), 6) AS adverse, round(avg((no OR bad)::INT), 6) >= 0.5 AS bump FROM p GROUP BY task""")(
        lambda s, d: history.proposal_feedback(table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "rejected").otherwise("open").alias("status"), (F.col("o_custkey") % 3).alias("violations"), F.array("o_orderpriority", F.lit("all")).alias("tasks"))))
    query("calibration", """WITH p AS (SELECT l_returnflag AS action, l_linenumber - 4 AS e, l_suppkey % 5 - 2 AS a FROM lineitem WHERE l_linenumber <> 1)
 SELECT action, count(*)::BIGINT AS n, round(avg((sign(e) = sign(a))::INT), 6) AS accuracy, round(avg(abs(e - a)), 6) AS mae FROM p GROUP BY action""")(
        lambda s, d: history.calibration(table(s, d, "lineitem").select(F.col("l_returnflag").alias("action"), (F.col("l_linenumber") - 4).alias("expected"), F.when(F.col("l_linenumber") != 1, F.col("l_suppkey") % 5 - 2).alias("actual"))))

    def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = table(spark, sf_dir, "orders")
        count = lambda rows: rows.groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").cast("double").alias("value"))
        limits = o.select(F.col("o_orderpriority").alias("metric")).distinct().select("metric", (F.substring("metric", 1, 1).cast("double") * 3).alias("most"), F.col("metric").like("%I%").alias("inverted"))
        return history.metric_gate(count(o.where("o_custkey % 2 = 0")), count(o.where("o_custkey % 2 = 1")), limits)

    query("metric_gate", """WITH c AS (SELECT o_orderpriority AS metric, count(*) FILTER (o_custkey % 2 = 0)::DOUBLE AS before, count(*) FILTER (o_custkey % 2 = 1)::DOUBLE AS after FROM orders GROUP BY 1)
 SELECT metric, before, after, after - before AS delta, CASE WHEN contains(metric, 'I') THEN before - after ELSE after - before END <= 3 * metric[1]::INT AS passed FROM c""")(gate)

    bodies = ("x.execute(q)", "if a: raise E\nx.execute(q)", "requests.get(u)", "open(p)", "open(p); logger.info(1)", "return 1")

    def described(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
        at = ((F.col("o_custkey") + shift * (F.col("o_orderkey") % 2)) % len(bodies) + 1).cast("int")
        o = table(spark, sf_dir, "orders").select(views.node_id("orders", "o_orderkey").alias("id"), F.lit("orders").alias("file"), F.element_at(F.array(*map(F.lit, bodies)), at).alias("body"))
        return semantics.describe(o)

    query("semantic_rules", """SELECT ['db-write-no-guard', 'network-no-error-handling', 'file-write-no-logging'][i] AS rule, ['warning', 'info', 'info'][i] AS severity, count(*)::BIGINT AS n
 FROM (SELECT CASE o_custkey % 6 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS i FROM orders) WHERE i IS NOT NULL GROUP BY i""")(lambda s, d: semantics.rule_findings(described(s, d)).groupBy("rule", "severity").agg(F.count("*").alias("n")))
    query("behaviour_changes", "SELECT 'orders::' || o_orderkey AS id, 'modified' AS change FROM orders WHERE o_orderkey % 2 = 1")(lambda s, d: semantics.behaviour_changes(described(s, d), described(s, d, 1)).select("id", "change"))

    # ---- semantics and imports in the query language

    def meaning(spark: SparkSession, sf_dir: str) -> Engine:
        g = partners(spark, sf_dir)
        line = F.col("line")
        every = lambda n, value: F.filter(F.array(value), lambda _: line % n == 0)
        fields = lambda **values: F.struct(*(F.lit(v).alias(k) for k, v in values.items()))
        known = g.nodes.select(
            "id", every(2, fields(verb="get", object="row", action_type="read")).alias("actions"), every(3, fields(condition="x", raises="E")).alias("guards"),
            every(5, fields(effect_type="database", target="t")).alias("side_effects"), every(7, F.lit("billing")).alias("domain_tags"), every(11, F.lit("requests")).alias("library_calls"), every(13, F.lit("SELECT")).alias("sql_operations"),
        )
        return Engine(g, semantics=known, imports=g.edges.where("edge_type = 'call'").select("source", "target"))

    asked = {"effects": "line % 5 = 0", "pure": "line % 5 <> 0", "guards": "line % 3 = 0", "unguarded": "line % 3 <> 0", "risky": "line % 5 = 0 AND line % 3 <> 0", "sql": "line % 13 = 0", "library": "line % 11 = 0", "domain": "line % 7 = 0", "actions": "line % 2 = 0"}
    texts = {k: f"{k}(billing)" if k == "domain" else f"{k}(read)" if k == "actions" else f"{k}()" for k in asked}
    for name, condition in asked.items():
        query(f"semantic_{name}", oracle.partners(f" SELECT id FROM nodes WHERE {condition}"))(lambda s, d, t=texts[name]: meaning(s, d).run(t))
    query("semantic_combined", oracle.partners(" SELECT id FROM nodes WHERE (line % 5 = 0 OR line % 7 = 0) AND NOT line % 3 = 0"))(lambda s, d: meaning(s, d).run("(effects() OR domain(billing)) AND NOT guards()"))
    query("imports_closure", oracle.partners(" SELECT DISTINCT node AS id FROM walk", "walk(node) AS (SELECT target FROM edges WHERE source = 'supplier::1' AND edge_type = 'call' UNION SELECT e.target FROM walk w JOIN edges e ON e.source = w.node WHERE e.edge_type = 'call')"))(lambda s, d: meaning(s, d).run('imports("supplier::1")'))
