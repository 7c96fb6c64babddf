"""Components and the algorithms that run inside one: cycles, bridges, communities, centrality.

Weak components come from what each task joins, then from hooking and pointer jumping. Strong components
come from trimming nodes that cannot lie on a cycle, then from tasks that take small weak components
together and, in large ones, from colours, one component for every colour that is left at once. Bridges
are found inside each weak component, of large ones by levels.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import FEW_ROWS, Graph, by_size, durable, module_of

from .traverse import arcs


#: Bytes of edges that a task joins at once before it tells what they join.
STRETCH_BYTES = 64 << 20
#: Bytes of what a stretch tells up to which the next one goes on with it.
KEPT_BYTES = 4 << 20
#: Links up to which one task joins them; the result is the same.
FEW_LINKS = 1_000_000


def _least_joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers the smallest of those that the pairs (a, b) join it with."""
    low = np.arange(n)
    while len(a):
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = low[low]
            if (further == low).all():
                break
            low = further
        a, b = low[a], low[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return low


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of each node of each stretch of edges (source, target): root is the smallest id that the
    edges of the stretch join it with. Few such rows are not told but begin the next stretch."""

    def told(stretch: list[pa.RecordBatch]) -> pa.Table:
        ends = pa.concat_arrays([x.column(k) for k in (0, 1) for x in stretch]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        names = ends.dictionary.take(order)
        place = np.empty(len(names), np.int64)
        place[order.to_numpy()] = np.arange(len(names))
        codes = place[ends.indices.to_numpy()]
        half = len(codes) // 2
        roots = names.take(pa.array(_least_joined(codes[:half], codes[half:], len(names))))
        return pa.table({"id": names, "root": roots})

    stretch, size = [], 0
    for batch in batches:
        if batch.num_rows:
            stretch.append(batch)
            size += batch.nbytes
        if size >= STRETCH_BYTES:
            stars = told(stretch)
            stretch, size = [], 0
            if stars.nbytes <= KEPT_BYTES:
                stretch = stars.combine_chunks().to_batches()
            else:
                yield from stars.to_batches(max_chunksize=50_000)
    if stretch:
        yield from told(stretch).to_batches(max_chunksize=50_000)


def _stars_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of the few edges of one task."""
    edges = [x for x in batches if x.num_rows]
    for stars in _stars(iter(pa.Table.from_batches(edges).combine_chunks().to_batches() if edges else [])):
        yield stars.rename_columns(["id", "component"])


def weak_components(nodes: DataFrame, edges: DataFrame, size: int | None = None) -> DataFrame:
    """(id, component): component is the smallest id of those joined by edges in any direction. Tasks join
    the edges that they read, in stretches of bounded size, so that a node has one root for each stretch
    that it is in and not a row for each edge. Roots of one node are linked, and what is left of the graph
    are these links. ``size`` is the number of edges, where that is known."""
    steps = edges.select("source", "target").where("source <> target")
    stars = durable(steps.mapInArrow(_stars, "id string, root string"))  # a table: tasks that are run again may cut other stretches
    rows = stars.unionByName(nodes.select("id", F.lit(None).cast("string").alias("root")))  # nodes are rows without a root
    of_id = Window.partitionBy("id").orderBy(F.asc_nulls_last("root"))
    whole = of_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = rows.select("id", "root", F.coalesce(F.first("root").over(of_id), "id").alias("low"), F.row_number().over(of_id).alias("place"), F.last("root").over(whole).isNull().alias("node"))
    # one row for each node, or for an id that is none, and the roots that its id has besides the least
    held = held.withColumn("named", F.col("root").isNull() | ((F.col("place") == 1) & ~F.col("node")))
    held = durable(held.where("named or root <> low").select("id", "root", "low", "named"))
    links = durable(held.where("root <> low").select(F.col("root").alias("at"), F.col("low").alias("to")).distinct())
    out = held.where("named").select("id", "low")
    n = links.count()
    if not n:
        return out.withColumnRenamed("low", "component")
    roots = _joined(links, n, size).select(F.col("id").alias("x"), "component")
    met = (F.xxhash64("low") == F.xxhash64("x")) & (F.col("low") == F.col("x"))
    out = out.join(F.broadcast(roots) if roots.limit(FEW_ROWS + 1).count() <= FEW_ROWS else roots.hint("merge"), met, "left")
    return durable(out.select("id", F.coalesce("component", "low").alias("component")))


def _joined(links: DataFrame, n: int, before: int | None = None) -> DataFrame:
    """(id, component) of the ends of n distinct links (at, to), a table. Few are joined by one task; more are
    edges for tasks of about as many, if they are at most half of the edges before that they come from; else
    hooking and pointer jumping, until few are left."""
    if n <= FEW_LINKS:
        return _joined_at_once(links)
    if before is None or 2 * n <= before:
        few = links.select(F.col("at").alias("source"), F.col("to").alias("target")).coalesce(-(-n // max(1, FEW_LINKS)))
        return weak_components(few.select(F.col("source").alias("id")).limit(0), few, n)
    links = durable(links.unionByName(links.select(F.col("to").alias("at"), F.col("at").alias("to"))).distinct())
    labels = durable(links.select(F.col("at").alias("id")).distinct().withColumn("component", F.col("id")))
    while not links.isEmpty():
        least = links.groupBy("at").agg(F.min("to").alias("low")).select(F.col("at").alias("x"), F.least("at", "low").alias("p"))
        parents = durable(least)
        while True:
            up = parents.select(F.col("x").alias("p"), F.col("p").alias("q"))
            jumped = durable(parents.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"), (F.col("q") < F.col("p")).alias("moved")))
            parents = jumped.select("x", "p")
            if jumped.where("moved").isEmpty():
                break
        labels = labels.join(parents, labels.component == parents.x, "left").select("id", F.coalesce("p", "component").alias("component"))
        labels = durable(labels)
        a = parents.select(F.col("x").alias("at"), F.col("p").alias("pa"))
        b = parents.select(F.col("x").alias("to"), F.col("p").alias("pb"))
        links = links.join(a, "at", "left").join(b, "to", "left").select(F.coalesce("pa", "at").alias("at"), F.coalesce("pb", "to").alias("to"))
        links = durable(links.where(F.col("at") != F.col("to")).distinct())
        if 0 < links.count() <= FEW_LINKS:
            last = _joined_at_once(links).select(F.col("id").alias("x"), F.col("component").alias("p")).hint("merge")
            return durable(labels.join(last, labels.component == F.col("x"), "left").select("id", F.coalesce("p", "component").alias("component")))
    return labels


def _joined_at_once(links: DataFrame) -> DataFrame:
    return durable(links.select("at", "to").coalesce(1).mapInArrow(_stars_at_once, "id string, component string"))


#: Distinct arcs up to which one task takes strong components of a graph, or of weak components together; the
#: result is the same.
SMALL_ARCS = 100_000


def _strong_in_memory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strong components of two nodes or more of the arcs (at, to) of a partition: an order by when nodes
    are left, then a walk backwards in it."""
    tables = list(batches)
    pdf = pd.concat(tables) if tables else pd.DataFrame({"at": [], "to": []})
    ahead, behind = defaultdict(list), defaultdict(list)
    for a, b in zip(pdf["at"], pdf["to"], strict=True):
        ahead[a].append(b)
        behind[b].append(a)
    order, seen = [], set()
    for start in {*ahead, *behind}:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(ahead.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            new = next((x for x in rest if x not in seen), None)
            if new is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(new)
                stack.append((new, iter(ahead.get(new, ()))))
    taken, rows = set(), []
    for start in reversed(order):
        if start in taken:
            continue
        taken.add(start)
        members = [start]
        for node in members:
            new = [x for x in behind.get(node, ()) if x not in taken]
            taken.update(new)
            members += dict.fromkeys(new)
        if len(members) > 1:
            least = min(members)
            rows += [(m, least) for m in members]
    yield pd.DataFrame(rows, columns=["id", "component"])


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes in strong components of two nodes or more; component is the smallest
    id. Self-loops make no cycle here. Nodes that nothing calls or that call nothing are dropped first. Of
    what is left, weak components of SMALL_ARCS arcs or fewer are dealt to tasks of about as many, and
    colours find the components inside larger ones."""
    left, size = _trimmed(durable(arcs(edges).where(F.col("at") != F.col("to"))))
    if size <= SMALL_ARCS:
        return _strong_in_one(left)
    parts = weak_components(left.select(F.col("at").alias("id")).limit(0), left.select(F.col("at").alias("source"), F.col("to").alias("target")))
    left = durable(left.join(parts.withColumnRenamed("id", "at").hint("merge"), "at"))
    large = durable(left.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_ARCS).select("component"))  # few: each has many arcs
    tasks = -(-size // max(1, SMALL_ARCS))
    small = left.join(F.broadcast(large), "component", "left_anti").withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks)))
    found = small.select("task", "at", "to").groupBy("task").applyInPandas(lambda pdf: next(_strong_in_memory(iter([pdf]))), "id string, component string")
    if large.isEmpty():
        return found
    return found.unionByName(_strong_by_colours(durable(left.join(F.broadcast(large), "component", "left_semi").select("at", "to"))))


def _strong_in_one(left: DataFrame) -> DataFrame:
    return left.coalesce(1).mapInPandas(_strong_in_memory, "id string, component string")


def _trimmed(left: DataFrame) -> tuple[DataFrame, int]:
    """What is left of a table of arcs without nodes that cannot lie on a cycle, as a table, and its number of
    arcs; once there are SMALL_ARCS or fewer, one task does the rest."""
    size = left.count()
    while size > SMALL_ARCS:
        ins, outs = left.select(F.col("to").alias("at")).distinct(), left.select(F.col("at").alias("to")).distinct()
        left = durable(left.join(ins.hint("merge"), "at", "left_semi").join(outs.hint("merge"), "to", "left_semi"))
        before, size = size, left.count()
        if size == before:
            break
    return left, size


def _strong_by_colours(left: DataFrame) -> DataFrame:
    """Strong components of a table of arcs. Each round drops what lies on no cycle and gives every node the
    colour of the first node that reaches it, in an order by hash; nodes that reach the one that gave
    them their colour are its component. So a round finds components in every part of the graph at once,
    and in a row of components one in the middle as a rule, on whose sides the next round goes on."""
    parts = []
    while True:
        left, size = _trimmed(left)
        if size <= SMALL_ARCS:
            rest = _strong_in_one(left)
            break
        colour = _least_before(left)
        a, b = colour.select(F.col("id").alias("at"), F.col("colour").alias("ca")), colour.select(F.col("id").alias("to"), F.col("colour").alias("cb"))
        left = durable(left.join(a.hint("merge"), "at").join(b.hint("merge"), "to").where("ca = cb").select("at", "to", F.col("ca").alias("colour")))
        found = _spread(left, colour.where(F.col("colour") == _colour("id")).select("colour", "id"))
        parts.append(found)
        gone = found.select("id").hint("merge")
        left = durable(left.join(gone.withColumnRenamed("id", "at"), "at", "left_anti").join(gone.withColumnRenamed("id", "to"), "to", "left_anti").select("at", "to"))
    if not parts:
        return rest
    every = union_all(parts)  # a colour is of one node, so it names one component in one round
    least = every.groupBy("colour").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return every.join(least, "colour").select("id", "component").unionByName(rest)


def _colour(name: str) -> Column:
    return F.concat(F.hex(F.xxhash64(name)), F.lit("/"), F.col(name))


def _least_before(steps: DataFrame) -> DataFrame:
    """(id, colour): the first colour among those of the nodes from which there is a way to it, and its own."""
    colour = durable(steps.select(F.explode(F.array("at", "to")).alias("id")).distinct().withColumn("colour", _colour("id")))
    frontier = colour
    while True:
        told = frontier.join(steps, frontier.id == steps.at).groupBy(F.col("to").alias("id")).agg(F.min("colour").alias("new"))
        frontier = durable(told.join(colour, "id").where("new < colour").select("id", F.col("new").alias("colour")))
        if frontier.isEmpty():
            return colour
        newer = frontier.withColumnRenamed("colour", "newer")
        colour = durable(colour.join(newer, "id", "left").select("id", F.coalesce("newer", "colour").alias("colour")))


def _spread(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """(colour, id): what reaches the root of its colour by steps of that colour, the root too."""
    found = frontier = roots
    back = steps.select("colour", F.col("to").alias("id"), F.col("at").alias("next"))
    rounds = 0
    while True:
        new = frontier.join(back, ["colour", "id"]).select("colour", F.col("next").alias("id")).distinct()
        frontier = durable(new.join(found, ["colour", "id"], "left_anti"))
        if frontier.isEmpty():
            return durable(found)
        found, rounds = found.unionByName(frontier), rounds + 1
        if rounds % 10 == 0:
            found = durable(found)


def cycles(graph: Graph, self_loops: bool = False) -> DataFrame:
    """(cycle_id, size, members, evidence): strong components of two nodes or more, largest first, with
    the number of edge records inside; with ``self_loops`` single nodes that call themselves too."""
    scc = durable(strong_components(graph.edges))
    if self_loops:
        alone = graph.edges.where("source = target").select(F.col("source").alias("id")).distinct().join(scc, "id", "left_anti")
        scc = scc.unionByName(alone.select("id", F.col("id").alias("component")))
    s, t = scc.select(F.col("id").alias("source"), F.col("component").alias("cs")), scc.select(F.col("id").alias("target"), F.col("component").alias("ct"))
    s, t = s.hint("merge"), t.hint("merge")  # they grow with the graph: not through the driver
    inside = graph.edges.join(s, "source").join(t, "target").where("cs = ct").groupBy(F.col("cs").alias("component")).agg(F.count("*").alias("evidence"))
    members = scc.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("id")), " -> ").alias("members"))
    return members.join(inside, "component", "left").select(F.col("component").alias("cycle_id"), "size", "members", F.coalesce("evidence", F.lit(0)).alias("evidence")).orderBy(F.desc("size"), "cycle_id")


def per_component(graph: Graph, run, schema: str) -> DataFrame:
    """Applies ``run`` to the distinct arcs (source, target, n) of each weak component."""
    parts = durable(weak_components(graph.nodes, graph.edges))
    own = graph.edges.groupBy("source", "target").agg(F.count("*").alias("n"))
    own = own.join(parts.select(F.col("id").alias("source"), "component"), "source")
    return own.groupBy("component").applyInPandas(lambda pdf: run(pdf), schema)


def bridge_ends(arcs_: list[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """Bridges of the undirected graph of records; pairs joined by more than one record and self-loops
    are none. Depth-first low points, without recursion."""
    count: dict[tuple[str, str], int] = defaultdict(int)
    near: dict[str, set[str]] = defaultdict(set)
    for a, b, n in arcs_:
        if a != b:
            count[min(a, b), max(a, b)] += n
            near[a].add(b)
            near[b].add(a)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    out = []
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, "", iter(sorted(near[root])))]
        while stack:
            node, parent, rest = stack[-1]
            to = next(rest, None)
            if to is None:
                stack.pop()
                if stack:
                    low[parent] = min(low[parent], low[node])
                    if low[node] > order[parent] and count[min(node, parent), max(node, parent)] == 1:
                        out.append((parent, node))
            elif to not in order:
                order[to] = low[to] = len(order)
                stack.append((to, node, iter(sorted(near[to]))))
            elif to != parent:
                low[node] = min(low[node], order[to])
    return out


#: Arcs of a weak component up to which one task takes it whole.
ONE_TASK = 1_000_000


def bridges(graph: Graph, one_task: int | None = None) -> DataFrame:
    """(source, target): edges whose removal parts their weak component, in their own direction. Components
    of more than ``one_task`` distinct arcs are searched level by level instead of in one task."""
    most = ONE_TASK if one_task is None else one_task
    parts = weak_components(graph.nodes, graph.edges)
    own = graph.edges.groupBy("source", "target").agg(F.count("*").alias("n"))
    own = durable(own.join(parts.select(F.col("id").alias("source"), "component"), "source"))
    large = durable(own.groupBy("component").agg(F.count("*").alias("arcs")).where(F.col("arcs") > most))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["source"], pdf["target"], pdf["n"], strict=True))
        found = {frozenset(p) for p in bridge_ends(rows)}
        return pd.DataFrame([(a, b) for a, b, _ in rows if frozenset((a, b)) in found], columns=["source", "target"])

    small = own.join(large, "component", "left_anti")
    out = small.groupBy("component").applyInPandas(run, "source string, target string")
    if large.isEmpty():
        return out
    rest = own.join(large.select("component"), "component", "left_semi")
    found = _bridge_pairs(rest)
    pair = rest.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    return out.unionByName(pair.join(found, ["a", "b"], "left_semi").select("source", "target"))


def _bridge_pairs(own: DataFrame) -> DataFrame:
    """(a, b) of the bridges among arcs (source, target, n, component), by levels of a spanning tree. Every
    pair outside the tree has a random 64-bit label at both ends; the labels of a subtree cancel out but
    for those of pairs that leave it, so an edge above a subtree is a bridge if they come to 0. Two
    different sums are equal by chance once in 2^64."""
    pairs = own.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    pairs = durable(pairs)
    steps = durable(pairs.select(F.col("a").alias("at"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("at"), F.col("a").alias("to"))))
    roots = pairs.select(F.col("component").alias("id")).distinct()
    frontier = durable(roots.select("id", F.lit(None).cast("string").alias("parent")))
    known, levels = frontier.select("id"), [frontier]
    while True:
        new = frontier.join(steps, frontier.id == steps["at"]).groupBy(F.col("to").alias("id")).agg(F.min("at").alias("parent"))
        frontier = durable(new.join(known, "id", "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier.select("id"))
        levels.append(frontier)
    tree = levels[1]
    for level in levels[2:]:
        tree = tree.unionByName(level)
    tree = durable(tree.select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b")))
    labels = pairs.join(tree, ["a", "b"], "left_anti").select("a", "b", F.xxhash64("a", "b", F.lit(7)).alias("label"))
    sums = labels.select(F.explode(F.array("a", "b")).alias("id"), "label").groupBy("id").agg(F.bit_xor("label").alias("own"))
    sums = durable(sums)
    out, below = None, None
    for level in reversed(levels[1:]):
        mine = level.join(sums, "id", "left").fillna(0, ["own"])
        if below is not None:
            mine = mine.join(below, "id", "left").fillna(0, ["sub"]).withColumn("own", F.col("own").bitwiseXOR(F.col("sub"))).drop("sub")
        mine = durable(mine)
        below = mine.groupBy(F.col("parent").alias("id")).agg(F.bit_xor("own").alias("sub"))
        cut = mine.where("own = 0").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
        out = cut if out is None else out.unionByName(cut)
    return out.join(pairs.where("n = 1").select("a", "b"), ["a", "b"], "left_semi")


def betweenness(graph: Graph, samples: int = 50) -> DataFrame:
    """(id, betweenness): shortest-path dependencies summed over sampled sources, the first by hash of
    their id, scaled to all sources. Levels of all sources advance together as joins; parallel records
    count as paths of their own."""
    nodes = graph.nodes.select("id")
    n = nodes.count()
    k = min(samples, n)
    sources = durable(nodes.orderBy(F.sha1("id"), "id").limit(k))
    steps = durable(graph.edges.where("source <> target").groupBy(F.col("source").alias("at"), F.col("target").alias("to")).agg(F.count("*").alias("m")))
    frontier = sources.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(1.0).alias("sigma"))
    known, levels = frontier, [frontier]
    while True:
        new = frontier.join(steps, frontier.node == steps.at).groupBy("origin", F.col("to").alias("node")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        frontier = durable(new.join(known.select("origin", "node"), ["origin", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        levels.append(frontier)
    total, below = None, None
    for i in range(len(levels) - 1, 0, -1):
        own = levels[i].withColumn("delta", F.lit(0.0)) if below is None else levels[i].join(below, ["origin", "node"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        own = durable(own)
        total = own.select("node", "delta") if total is None else total.unionByName(own.select("node", "delta"))
        up = levels[i - 1].select("origin", F.col("node").alias("at"), F.col("sigma").alias("su"))
        below = own.join(steps, own.node == steps["to"]).join(up, ["origin", "at"]).groupBy("origin", F.col("at").alias("node")).agg(F.sum(F.col("su") * F.col("m") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * n / max(1, k)
    if total is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    sums = total.groupBy(F.col("node").alias("id")).agg((F.sum("delta") * scale).alias("betweenness"))
    return nodes.join(sums, "id", "left").fillna(0.0, ["betweenness"])


def bounded_cycles(graph: Graph, ids: list[str], longest: int = 10) -> DataFrame:
    """(origin, length): the shortest cycle of at most ``longest`` edges through each of some nodes."""
    from .traverse import reach, seeds_of

    found = reach(arcs(graph.edges), seeds_of(graph.nodes.sparkSession, ids), longest)
    return found.where("origin = node").select("origin", F.col("depth").alias("length"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(id, level) over the condensed graph: 0 for nodes that call nothing outside their strong component,
    else one more than the largest level of what it calls outside."""
    steps = durable(arcs(edges))
    nodes = durable(steps.select("at").distinct().unionByName(steps.select(F.col("to").alias("at"))).distinct().select(F.col("at").alias("group")))
    # without cycles the levels are those of the nodes themselves, and no components have to be looked for
    calls = steps.where("at <> to").select(F.col("at").alias("ga"), F.col("to").alias("gb"))
    levels = durable(peel(nodes, calls))
    tangled = durable(nodes.join(levels.select("group").hint("merge"), "group", "left_anti").select(F.col("group").alias("id")))
    n = tangled.count()
    if not n:
        return levels.select(F.col("group").alias("id"), "level")
    end = lambda c: by_size(tangled.withColumnRenamed("id", c), n)
    knot = calls.join(end("ga"), "ga", "left_semi").join(end("gb"), "gb", "left_semi")
    scc = strong_components(knot.select(F.col("ga").alias("source"), F.col("gb").alias("target")))
    group = durable(nodes.withColumnRenamed("group", "id").join(scc.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("group")))
    a, b = group.select(F.col("id").alias("ga"), F.col("group").alias("a")).hint("merge"), group.select(F.col("id").alias("gb"), F.col("group").alias("b")).hint("merge")
    calls = durable(calls.join(a, "ga").join(b, "gb").where("a <> b").select(F.col("a").alias("ga"), F.col("b").alias("gb")).distinct())
    levels = peel(group.select("group").distinct(), calls)
    return group.join(levels.hint("merge"), "group").select("id", "level")


def peel(groups: DataFrame, calls: DataFrame) -> DataFrame:
    """(group, level) of groups(group) whose distinct calls(ga, gb), a table, have no cycle; groups on cycles and
    before them get none. Each round joins what was finished last with its callers alone and counts down how many
    callees they wait for. When none waits, what is ready is the last level, and calls are not read again."""
    waits = durable(calls.groupBy(F.col("ga").alias("group")).agg(F.count("*").alias("open")))
    ready = durable(groups.join(waits.select("group").hint("merge"), "group", "left_anti"))
    parts, level, waiting, n = [], 0, waits.count(), ready.count()
    while n:
        parts.append(ready.withColumn("level", F.lit(level)))
        if not waiting:
            break
        freed = calls.join(by_size(ready, n), F.col("gb") == F.col("group")).groupBy(F.col("ga").alias("group")).agg(F.count("*").alias("freed"))
        touched = durable(by_size(waits, waiting).join(freed, "group").select("group", (F.col("open") - F.col("freed")).alias("open")))
        met, n = touched.agg(F.count("*"), F.count_if(F.col("open") == 0)).head()
        waits = durable(waits.join(by_size(touched.select("group"), met), "group", "left_anti").unionByName(touched.where("open > 0")))
        ready = touched.where("open = 0").select("group")
        level, waiting = level + 1, waiting - n
        if len(parts) == 10:
            parts = [durable(union_all(parts))]
    return union_all(parts) if parts else groups.limit(0).withColumn("level", F.lit(0))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
