"""The graph views of ``sources.views`` and the queries of the catalog in SQL, for comparison."""

SALES = """
nodes AS (
  SELECT 'region::' || r_regionkey AS id, 'region' AS file, 'module' AS type, r_regionkey AS line, r_name AS body, 0 AS layer, 'infra' AS arch_layer FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, 'nation', 'class', n_nationkey, n_name, 1, 'repository' FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'customer', 'function', c_custkey, c_mktsegment, 2, 'domain' FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'supplier', 'function', s_suppkey, s_name, 2, 'domain' FROM supplier
  UNION ALL SELECT 'part::' || p_partkey, 'part', 'function', p_partkey, p_brand, 3, 'service' FROM part
  UNION ALL SELECT 'orders::' || o_orderkey, 'orders', 'method', o_orderkey, o_orderstatus, 4, 'controller' FROM orders
), edges AS (
  SELECT 'orders::' || o_orderkey AS source, 'customer::' || o_custkey AS target, 'call' AS edge_type, 'static' AS confidence FROM orders
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, 'call', 'static' FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'call', 'static' FROM supplier
  UNION ALL SELECT 'nation::' || n_nationkey, 'region::' || n_regionkey, 'control_flow', 'static' FROM nation
  UNION ALL SELECT 'orders::' || l_orderkey, 'part::' || l_partkey, 'dataflow', CASE l_returnflag WHEN 'R' THEN 'runtime' WHEN 'A' THEN 'test' ELSE 'static' END FROM lineitem
  UNION ALL SELECT 'orders::' || l_orderkey, 'supplier::' || l_suppkey, 'event', CASE l_returnflag WHEN 'R' THEN 'runtime' WHEN 'A' THEN 'test' ELSE 'static' END FROM lineitem
)"""

TRADE = """
nodes AS (
  SELECT 'r' || n_regionkey || '::' || n_name AS id, 'r' || n_regionkey AS file, 'function' AS type, n_nationkey AS line, n_name AS body,
    n_regionkey AS layer, ['controller', 'service', 'domain', 'repository', 'infra'][n_regionkey + 1] AS arch_layer FROM nation
), edges AS (
  SELECT s.id AS source, t.id AS target, 'call' AS edge_type, CASE l_returnflag WHEN 'R' THEN 'runtime' ELSE 'static' END AS confidence
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nodes s ON s.line = s_nationkey JOIN nodes t ON t.line = c_nationkey
)"""

RING = """
nodes AS (
  SELECT 'r' || n_regionkey || '::' || n_name AS id, 'r' || n_regionkey AS file, 'function' AS type, n_nationkey AS line, n_name AS body,
    n_regionkey AS layer, ['controller', 'service', 'domain', 'repository', 'infra'][n_regionkey + 1] AS arch_layer FROM nation
), step AS (
  SELECT id, line, unnest(CASE WHEN line < 12 THEN [1, 5] WHEN line < 18 THEN [1] WHEN line < 23 THEN [-5] ELSE [] END) AS k FROM nodes
), edges AS (
  SELECT step.id AS source, n.id AS target, 'call' AS edge_type, 'static' AS confidence FROM step JOIN nodes n ON n.line = step.line + step.k
)"""

PARTNERS = """
nodes AS (
  SELECT 'customer::' || c_custkey AS id, 'customers' || (c_custkey // 120) AS file, 'function' AS type, c_custkey AS line, 'customer::' || c_custkey AS body, 2 AS layer, 'service' AS arch_layer FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'suppliers' || (s_suppkey // 8), 'function', s_suppkey, 'supplier::' || s_suppkey, 3, 'domain' FROM supplier
), pair AS (
  SELECT 'customer::' || c_custkey AS source, 'supplier::' || (c_custkey // 15) AS target, 'call' AS edge_type, 'static' AS confidence FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'customer::' || (s_suppkey * 15 + s_suppkey % 15), 'event', 'static' FROM supplier
  UNION ALL SELECT 'supplier::' || s_suppkey, 'supplier::' || (s_suppkey + 1), 'call', 'static' FROM supplier WHERE s_suppkey % 8 <> 7
  UNION ALL SELECT 'supplier::' || s_suppkey, 'supplier::' || (s_suppkey - 3), 'call', 'static' FROM supplier WHERE s_suppkey % 8 = 5
), edges AS (SELECT * FROM pair WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)
)"""

DEGREES = """
deg AS (
  SELECT n.id, coalesce(i.c, 0)::BIGINT AS fan_in, coalesce(o.c, 0)::BIGINT AS fan_out FROM nodes n
  LEFT JOIN (SELECT target, count(*) AS c FROM edges GROUP BY target) i ON i.target = n.id
  LEFT JOIN (SELECT source, count(*) AS c FROM edges GROUP BY source) o ON o.source = n.id
)"""

#: All pairs (a, b) with a way of one step or more from a to b.
CLOSURE = """
closure(a, b) AS (SELECT source, target FROM edges UNION SELECT c.a, e.target FROM closure c JOIN edges e ON e.source = c.b)"""

SCC = f"""{CLOSURE}, scc AS (
  SELECT x.a AS id, min(x.b) AS component FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1
)"""


def sales(body: str, *more: str) -> str:
    return "WITH " + ", ".join([SALES, *more]) + body


def trade(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([TRADE, *more]) + body


def partners(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([PARTNERS, *more]) + body


def ring(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([RING, *more]) + body


def reach(start: str, reverse: bool = False, depth: int | None = None) -> str:
    a, b = ("target", "source") if reverse else ("source", "target")
    if depth is None:
        return f"walk(node) AS (SELECT {b} FROM edges WHERE {a} = '{start}' UNION SELECT e.{b} FROM walk w JOIN edges e ON e.{a} = w.node)"
    return f"walk(node, d) AS (SELECT {b}, 1 FROM edges WHERE {a} = '{start}' UNION SELECT e.{b}, w.d + 1 FROM walk w JOIN edges e ON e.{a} = w.node WHERE w.d < {depth})"


#: Nodes whose ids begin with their file, for views in which the module is the entity.
BY_FILE = """
plain AS (SELECT * FROM nodes), wire AS (SELECT * FROM edges), named AS (SELECT id AS old, file || '::' || replace(id, '::', '') AS id, file, type FROM plain
), arc AS (SELECT s.id AS source, t.id AS target FROM wire JOIN named s ON s.old = source JOIN named t ON t.old = target)"""

#: Label propagation by turns: the state is a list of labels, and one node is asked in each step.
LABELS = """
near AS (SELECT source AS a, target AS b FROM arc UNION SELECT target, source FROM arc
), member AS (SELECT a AS id, row_number() OVER (ORDER BY a) AS k FROM near GROUP BY a
), label AS (SELECT m AS name, row_number() OVER (ORDER BY m) AS r FROM (SELECT DISTINCT split_part(id, '::', 1) AS m FROM member)
), around AS (SELECT x.k, list(y.k) AS near FROM near JOIN member x ON x.id = a JOIN member y ON y.id = b GROUP BY x.k
), size AS (SELECT count(*) AS n FROM member
), turn(t, s, moved) AS (
  SELECT 0::BIGINT, list(r ORDER BY k), 1::BIGINT FROM member JOIN label ON name = split_part(id, '::', 1)
  UNION ALL
  SELECT t + 1, list_concat(s[1:k - 1], [v], s[k + 1:]), CASE WHEN k = 1 THEN 0 ELSE moved END + (v <> s[k])::BIGINT
  FROM (
    SELECT t, s, moved, k, list_sort(list_transform(list_distinct(l), lambda x: {'n': len(list_filter(l, lambda y: y = x)), 'x': x}), 'DESC')[1].x AS v
    FROM (SELECT t, s, moved, k, list_transform(near, lambda u: s[u]) AS l FROM turn, size, around WHERE k = t % n + 1 AND t < 20 * n AND (k > 1 OR moved > 0))
  )
), settled AS (SELECT member.id, name FROM (SELECT arg_max(s, t) AS s FROM turn), member JOIN label ON r = s[k])"""

PARTITION = """
labelled AS (SELECT id, name FROM settled UNION ALL SELECT id, split_part(id, '::', 1) FROM named WHERE id NOT IN (SELECT id FROM settled)
), grouped AS (SELECT name, count(*) AS n, min(id) AS seed, max(count(*)) OVER () >= 4 AS large FROM labelled GROUP BY name
), big AS (
  SELECT id, regexp_replace(split_part(seed, '::', 1), '[/.]', '_', 'g') || '_' || sha1(seed)[1:8] AS partition_id FROM labelled JOIN grouped USING (name) WHERE n >= 4 OR NOT large
), home AS (SELECT split_part(id, '::', 1) AS module, min(partition_id) AS partition_id FROM big GROUP BY 1
), partition AS (
  SELECT * FROM big UNION ALL
  SELECT id, coalesce(home.partition_id, regexp_replace(split_part(id, '::', 1), '[/.]', '_', 'g') || '_' || sha1(id)[1:8])
  FROM labelled LEFT JOIN home ON module = split_part(id, '::', 1) WHERE id NOT IN (SELECT id FROM big)
)"""

OVERVIEW = """
, ends AS (SELECT p.partition_id AS ps, q.partition_id AS pt, source, target FROM arc JOIN partition p ON p.id = source JOIN partition q ON q.id = target
), kind AS (SELECT partition_id, type, count(*) AS n FROM partition JOIN named USING (id) GROUP BY ALL)
SELECT partition_id, count(*)::BIGINT AS size, (SELECT count(*) FROM ends WHERE ps = partition_id AND pt = partition_id)::BIGINT AS internal_edges,
  (SELECT count(*) FROM ends WHERE (ps = partition_id) <> (pt = partition_id))::BIGINT AS boundary_edges,
  (SELECT count(DISTINCT x) FROM (SELECT source AS x FROM ends WHERE ps = partition_id AND pt <> partition_id UNION SELECT target FROM ends WHERE pt = partition_id AND ps <> partition_id))::BIGINT AS boundary_nodes,
  count(DISTINCT file)::BIGINT AS files, 1::BIGINT AS directories, (SELECT '{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}' FROM kind WHERE kind.partition_id = partition.partition_id) AS type_counts,
  NULL::VARCHAR AS declared_subsystem
FROM partition JOIN named USING (id) GROUP BY partition_id"""


def labels(view, body: str, *more: str) -> str:
    by_file = BY_FILE if view is partners else "named AS (SELECT id, file, type FROM nodes), arc AS (SELECT source, target FROM edges)"
    return view(body, by_file, LABELS, *more)


#: Greedy modularity by turns: the state is a list of communities, one file is asked in each step.
MODULARITY = """
weight AS (
  SELECT least(s.file, t.file) AS a, greatest(s.file, t.file) AS b, count(*) AS w FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.file <> t.file GROUP BY ALL
), near AS (SELECT a, b, w FROM weight UNION ALL SELECT b, a, w FROM weight
), member AS (SELECT a AS file, row_number() OVER (ORDER BY a) AS k, sum(w)::BIGINT AS degree FROM near GROUP BY a
), around AS (SELECT x.k, list({'u': y.k, 'w': w::BIGINT}) AS near FROM near JOIN member x ON x.file = a JOIN member y ON y.file = b GROUP BY x.k
), size AS (SELECT count(*) AS n, list(degree ORDER BY k) AS d, sum(degree)::BIGINT AS m FROM member
), turn(t, s, moved) AS (
  SELECT 0::BIGINT, list(k ORDER BY k), 1::BIGINT FROM member
  UNION ALL
  SELECT t + 1, list_concat(s[1:k - 1], [v], s[k + 1:]), CASE WHEN k = 1 THEN 0 ELSE moved END + (v <> s[k])::BIGINT
  FROM (
    SELECT t, s, moved, k, list_sort(list_transform(list_distinct(list_append(list_transform(near, lambda e: s[e.u]), s[k])), lambda c: {
        'loss': d[k] * (coalesce(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN i <> k AND s[i] = c THEN d[i] ELSE 0 END)), 0)::BIGINT) - m * (coalesce(list_sum(list_transform(near, lambda e: CASE WHEN s[e.u] = c THEN e.w ELSE 0 END)), 0)::BIGINT),
        'away': c <> s[k], 'c': c}))[1].c AS v
    FROM turn, size, around WHERE k = t % n + 1 AND t < 50 * n AND (k > 1 OR moved > 0)
  )
), settled AS (SELECT file, s[k] AS c FROM (SELECT arg_max(s, t) AS s FROM turn), member
), owner AS (
  SELECT file, min(file) OVER (PARTITION BY c) AS subsystem FROM settled UNION ALL
  SELECT DISTINCT file, file FROM nodes WHERE file IS NOT NULL AND file NOT IN (SELECT file FROM settled)
)"""

REPORT = """
, held AS (SELECT x.subsystem AS s, y.subsystem AS t, w FROM near JOIN owner x ON x.file = a JOIN owner y ON y.file = b
), edge AS (SELECT s, coalesce(sum(w) FILTER (s = t), 0) / 2 AS i, coalesce(sum(w) FILTER (s <> t), 0) AS e FROM held GROUP BY s
), owned AS (SELECT subsystem, list(DISTINCT file ORDER BY file) AS files, count(*) AS n FROM owner JOIN nodes USING (file) GROUP BY subsystem HAVING count(*) >= 2
), m AS (SELECT sum(w) AS m FROM weight)
SELECT subsystem, CASE WHEN len(files) = 1 THEN subsystem ELSE files[1] END AS name, len(files)::BIGINT AS files, n::BIGINT AS nodes, coalesce(i, 0)::BIGINT AS internal_edges, coalesce(e, 0)::BIGINT AS external_edges,
  round(CASE WHEN coalesce(i + e, 0) > 0 THEN i / (i + e) ELSE 1 END, 6)::DOUBLE AS cohesion, round(coalesce(i / m - ((2 * i + e) / (2 * m)) ** 2, 0), 6)::DOUBLE AS share
FROM owned LEFT JOIN edge ON s = subsystem, m"""


def modularity(view, body: str) -> str:
    return view(body, MODULARITY)


def sliced(root: str, hops: int = 2, density: float = 0.4, limited: bool = False) -> str:
    """A subsystem slice by levels; ``limited`` to the root's file and edges to supplier 15 as runtime ones."""
    own = root.split("::")[0]
    ends = "SELECT source AS a, target AS b FROM arc WHERE source <> target UNION SELECT target, source FROM arc WHERE source <> target"
    if limited:
        ends = f"SELECT a, b FROM ({ends}) WHERE starts_with(a, '{own}::') AND starts_with(b, '{own}::') UNION SELECT source, target FROM seen UNION SELECT target, source FROM seen"
    levels = ["level0 AS (SELECT id, 0 AS depth FROM named WHERE id = '" + root + "')"]
    for d in range(1, hops + 1):
        levels.append(f"level{d} AS (SELECT * FROM level{d - 1} UNION ALL SELECT DISTINCT b, {d} FROM near JOIN level{d - 1} ON id = a AND depth = {d - 1} WHERE b NOT IN (SELECT id FROM level{d - 1}))")
    more = "SELECT source, target FROM arc" + (" UNION ALL SELECT source, target FROM seen" if limited else "")
    return partners(
        f""" SELECT k.id, any_value(k.depth)::INT AS depth, coalesce(bool_or(o.id IS NULL OR split_part(k.id, '::', 1) <> split_part(r.b, '::', 1)) FILTER (r.b IS NOT NULL), false) AS boundary,
  count(*) FILTER (r.b IS NOT NULL AND o.id IS NULL)::BIGINT AS external_edges FROM kept k LEFT JOIN record r ON r.a = k.id LEFT JOIN kept o ON o.id = r.b GROUP BY k.id""",
        BY_FILE, "seen AS (SELECT DISTINCT source, target, row_number() OVER () AS r FROM arc WHERE target = 'suppliers1::supplier15')", f"near AS ({ends})", *levels,
        f"""share AS (SELECT a AS id, avg((b IN (SELECT id FROM level{hops}))::INT) AS share, bool_or(split_part(b, '::', 1) = '{own}') AS by_root FROM near GROUP BY a)""",
        f"""kept AS (SELECT l.id, l.depth FROM level{hops} l LEFT JOIN share USING (id) WHERE l.id = '{root}' OR (share >= {density} AND (split_part(l.id, '::', 1) = '{own}' OR by_root)))""",
        f"record AS (SELECT source AS a, target AS b FROM ({more}) UNION ALL SELECT target, source FROM ({more}))",
    )
