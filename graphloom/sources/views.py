"""Graphs over the sales tables: entities as nodes and their references as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, dealt, shares

#: Entity: key column, attribute hashed as the body, node type, layer, arch_layer.
ENTITIES = {
    "region": ("r_regionkey", "r_name", "module", 0, "infra"),
    "nation": ("n_nationkey", "n_name", "class", 1, "repository"),
    "customer": ("c_custkey", "c_mktsegment", "function", 2, "domain"),
    "supplier": ("s_suppkey", "s_name", "function", 2, "domain"),
    "part": ("p_partkey", "p_brand", "function", 3, "service"),
    "orders": ("o_orderkey", "o_orderstatus", "method", 4, "controller"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(entity: str, key: str) -> Column:
    return F.concat(F.lit(entity + "::"), F.col(key).cast("string"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sales_nodes(spark: SparkSession, sf_dir: str, orders: Column | None = None) -> DataFrame:
    parts = []
    for entity, (key, body, kind, layer, arch) in ENTITIES.items():
        rows = table(spark, sf_dir, entity)
        if entity == "orders" and orders is not None:
            rows = rows.where(orders)
        at = node_id(entity, key)
        parts.append(rows.select(at.alias("id"), F.lit(entity).alias("file"), F.lit(kind).alias("type"), F.col(key).cast("int").alias("line"), F.sha2(F.concat_ws("|", at, body), 256).alias("body_hash"), F.lit(layer).alias("layer"), F.lit(arch).alias("arch_layer")))
    return _union(parts)


def _edges(rows: DataFrame, source: Column, target: Column, kind: str, confidence: Column | None = None) -> DataFrame:
    return rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), (F.lit("static") if confidence is None else confidence).alias("confidence"))


def sales_edges(spark: SparkSession, sf_dir: str, orders: Column | None = None) -> DataFrame:
    """Orders call customers and use parts and suppliers, one record for each line item; customers and
    suppliers call nations, nations regions."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if orders is not None:
        o, n = o.where(orders), shares(l)
        # the planner moves this join before a shuffle of line items; they follow the orders if these are in no fewer parts than its setting
        n = n and max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
        l = l.join(dealt(o.select(F.col("o_orderkey").alias("l_orderkey")), n, "l_orderkey"), "l_orderkey", "left_semi")
    seen = F.when(F.col("l_returnflag") == "R", "runtime").when(F.col("l_returnflag") == "A", "test").otherwise("static")
    return _union([
        _edges(o, node_id("orders", "o_orderkey"), node_id("customer", "o_custkey"), "call"),
        _edges(table(spark, sf_dir, "customer"), node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"), "call"),
        _edges(table(spark, sf_dir, "supplier"), node_id("supplier", "s_suppkey"), node_id("nation", "s_nationkey"), "call"),
        _edges(table(spark, sf_dir, "nation"), node_id("nation", "n_nationkey"), node_id("region", "n_regionkey"), "control_flow"),
        _edges(l, node_id("orders", "l_orderkey"), node_id("part", "l_partkey"), "dataflow", seen),
        _edges(l, node_id("orders", "l_orderkey"), node_id("supplier", "l_suppkey"), "event", seen),
    ])


def sales(spark: SparkSession, sf_dir: str, orders: Column | None = None) -> Graph:
    """The layered multigraph; ``orders`` restricts it to some orders."""
    nodes = sales_nodes(spark, sf_dir, orders)
    notes = nodes.select("id", "layer", "arch_layer")
    return Graph(nodes.drop("layer", "arch_layer"), sales_edges(spark, sf_dir, orders), notes)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; an edge from the supplier's to the customer's nation for each line item. Cyclic, with
    parallel edges and self-loops. The region is the file and decides the layer."""
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("::"), F.col("n_name")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file"), F.lit("function").alias("type"), F.col("n_nationkey").cast("int").alias("line"), F.sha2("n_name", 256).alias("body_hash"), F.col("n_regionkey").cast("int").alias("layer"), F.element_at(F.array(*(F.lit(a) for a in ("controller", "service", "domain", "repository", "infra"))), F.col("n_regionkey").cast("int") + 1).alias("arch_layer"))
    name = nodes.select("line", "id")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = shares(l)  # customers meet orders first, and line items are shuffled once
    buyers = o.join(c.hint("merge") if n else c, "c_custkey").drop("c_custkey")
    ends = dealt(l.join(s, "l_suppkey").drop("l_suppkey"), n, "l_orderkey").join(dealt(buyers, n, "l_orderkey"), "l_orderkey")
    ends = ends.join(name.select(F.col("line").alias("s_nationkey"), F.col("id").alias("source")), "s_nationkey").join(name.select(F.col("line").alias("c_nationkey"), F.col("id").alias("target")), "c_nationkey")
    seen = F.when(F.col("l_returnflag") == "R", "runtime").otherwise("static")
    edges = ends.select("source", "target", F.lit("call").alias("edge_type"), seen.alias("confidence"))
    return Graph(nodes.drop("layer", "arch_layer"), edges, nodes.select("id", "layer", "arch_layer"))


def ring(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations joined to those 1, 5 or -5 numbers on, by rules on the number: sparse, with cycles, chains
    and isolated nations, the same at every scale."""
    g = trade(spark, sf_dir)
    ids = g.nodes.select("line", "id")
    steps = F.explode(F.when(F.col("line") < 12, F.array(F.lit(1), F.lit(5))).when(F.col("line") < 18, F.array(F.lit(1))).when(F.col("line") < 23, F.array(F.lit(-5))).otherwise(F.array().cast("array<int>")))
    ends = ids.select(F.col("id").alias("source"), "line", steps.alias("step")).select("source", (F.col("line") + F.col("step")).alias("to"))
    edges = ends.join(ids.select(F.col("line").alias("to"), F.col("id").alias("target")), "to").select("source", "target", F.lit("call").alias("edge_type"), F.lit("static").alias("confidence"))
    return g.with_edges(edges)


def partners(spark: SparkSession, sf_dir: str) -> Graph:
    """All customers and suppliers, a cyclic graph that grows with the data. A customer calls the supplier
    of its fifteen, a supplier one of these customers, the next supplier unless it ends a row of eight,
    and, as the sixth of a row, the third. So cycles of two and more, chains and bridges are in each row."""
    c, s = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey")
    node = lambda rows, entity, key, layer, arch: rows.select(node_id(entity, key).alias("id"), F.concat(F.lit(entity + "s"), F.expr(f"cast({key} div {120 if entity == 'customer' else 8} as string)")).alias("file"), F.lit("function").alias("type"), F.col(key).cast("int").alias("line"), F.sha2(node_id(entity, key), 256).alias("body_hash"), F.lit(layer).alias("layer"), F.lit(arch).alias("arch_layer"))
    nodes = node(c, "customer", "c_custkey", 2, "service").unionByName(node(s, "supplier", "s_suppkey", 3, "domain"))
    supplier = lambda key: F.concat(F.lit("supplier::"), key.cast("string"))
    at = F.col("s_suppkey")
    parts = [
        _edges(c, node_id("customer", "c_custkey"), supplier(F.expr("c_custkey div 15")), "call"),
        _edges(s, supplier(at), F.concat(F.lit("customer::"), (at * 15 + at % 15).cast("string")), "event"),
        _edges(s.where("s_suppkey % 8 <> 7"), supplier(at), supplier(at + 1), "call"),
        _edges(s.where("s_suppkey % 8 = 5"), supplier(at), supplier(at - 3), "call"),
    ]
    ids = nodes.select("id").hint("merge")  # they grow with the data: not through the driver
    edges = _union(parts).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes.drop("layer", "arch_layer"), edges.select("source", "target", "edge_type", "confidence"), nodes.select("id", "layer", "arch_layer"))


def flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types; an edge for each event of a user and the user's next one."""
    e = table(spark, sf_dir, "events")
    then = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.select(F.col("event_type").alias("source"), then.alias("target")).where("target is not null")
    nodes = e.select(F.col("event_type").alias("id")).distinct().select("id", F.lit("events").alias("file"), F.lit("function").alias("type"), F.lit(0).alias("line"), F.sha2("id", 256).alias("body_hash"))
    return Graph(nodes, edges.select("source", "target", F.lit("event").alias("edge_type"), F.lit("runtime").alias("confidence")))


def web(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages and the hosts and paths they refer to."""
    p = table(spark, sf_dir, "pages")
    page = node_id("page", "page_id")
    host = F.concat(F.lit("host::"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    to_host = p.select(page.alias("source"), host.alias("target"), F.lit("call").alias("edge_type"))
    links = p.select(page.alias("source"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    to_path = links.select("source", F.concat(F.lit("path::"), F.col("href")).alias("target"), F.lit("dataflow").alias("edge_type"))
    edges = to_host.unionByName(to_path).withColumn("confidence", F.lit("static"))
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = ids.select("id", F.split_part("id", F.lit("::"), F.lit(1)).alias("file"), F.lit("function").alias("type"), F.lit(0).alias("line"), F.sha2("id", 256).alias("body_hash"))
    return Graph(nodes, edges)
