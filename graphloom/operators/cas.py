"""Content-addressed dependency hashes.

A node's hash is sha256 of its body hash if it has no callees, else of the body hash, a colon and the
sorted hashes of its distinct callees joined by colons. Nodes of one cycle share a hash, made of their
sorted ``id:body_hash`` and the sorted hashes of what the cycle calls outside. Hashes are computed level
by level: each arc meets the hash of its callee once, and goes to its caller once all callees have theirs.
What is left, cycles and what calls them, is condensed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, by_size, durable

from .components import peel, strong_components, union_all
from .traverse import arcs, invalidated


def dependency_hashes(graph: Graph, known: DataFrame | None = None) -> DataFrame:
    """(id, dependency_hash). ``known`` (id, dependency_hash) are taken as they are and not entered."""
    if known is not None:
        return _condensed(graph, known)
    # a caller's distinct callees are one row here, as they are in its hash
    lists = graph.edges.where("source <> target").groupBy(F.xxhash64("source").alias("k"), F.col("source").alias("at")).agg(F.collect_set("target").alias("callees"))
    lists = durable(lists.select("at", "callees"))
    hashes, tangled, n, most = _by_levels(graph.nodes, lists)
    if n:  # cycles and what calls them: these nodes, and as known what they call
        ends = tangled.select("id")
        rest = durable(lists.join(by_size(ends.withColumnRenamed("id", "at"), n), "at", "left_semi").select("at", F.explode("callees").alias("to")))
        found = durable(hashes.join(rest.select(F.col("to").alias("id")).distinct(), "id", "left_semi"))
        inside = graph.nodes.select("id", "body_hash").join(by_size(ends, n), "id", "left_semi").unionByName(found.select("id", F.lit("").alias("body_hash")))
        more = _condensed(Graph(inside, rest.select(F.col("at").alias("source"), F.col("to").alias("target"))), found)
        hashes = hashes.unionByName(more.join(by_size(ends, n), "id", "left_semi").distinct())
    return hashes if most < 2 else graph.nodes.select("id").join(hashes, "id")


def _met(one: str, other: str) -> Column:
    """Equal ids. Tables are sorted by a hash first: ids begin alike, which makes comparing them slow."""
    return (F.xxhash64(one) == F.xxhash64(other)) & (F.col(one) == F.col(other))


def _by_levels(nodes: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(id, dependency_hash) of ids from which no cycle and no node without a hash is reached, the others (id,
    body_hash) and their number, and how many nodes share an id at most. ``lists`` (at, callees) has a row for each
    caller; ends outside ``nodes`` do not count. Hashes travel in 32 bytes."""
    nodes = nodes.where("id is not null").groupBy(F.xxhash64("id").alias("k"), "id").agg(F.min("body_hash").alias("body_hash"), F.count("*").alias("rows"))
    callers = lists.select("at").hint("merge")
    marked = durable(nodes.join(callers, (F.col("k") == F.xxhash64("at")) & (F.col("id") == F.col("at")), "left").select("id", "body_hash", "rows", F.col("at").isNotNull().alias("calls")))
    hashed = F.unhex(F.sha2("body_hash", 256)).alias("hash")
    parts = [durable(marked.where("not calls").select("id", hashed))]
    waiting = marked.where("calls").select("id", "body_hash")
    callees = parts[0].unionByName(waiting.select("id", F.lit(None).cast("binary").alias("hash"))).hint("merge")
    met = durable(lists.select("at", F.explode("callees").alias("to")).join(callees, _met("to", "id")).select("at", "to", "hash"))
    n, most = marked.agg(F.count_if("calls"), F.max("rows")).first()
    told = []
    while n:
        told.append(met.where("hash is not null").select("at", "hash"))
        left = met.where("hash is null").select("at", "to")
        waits = left.select("at").distinct().hint("merge")
        split = durable(waiting.join(waits, _met("id", "at"), "left").select("id", "body_hash", F.col("at").isNotNull().alias("waits")))
        ready, waiting = split.where("not waits").select("id", "body_hash"), split.where("waits").select("id", "body_hash")
        freed, before = ready.count(), n
        if not freed:
            break
        n = before - freed
        own = union_all(told)
        if n:
            own = own.join(by_size(ready.select(F.col("id").alias("x")), freed), _met("at", "x"), "left_semi")
        # bodies come as further rows of their groups; a group without one is of a caller that has its hash
        bodies = ready.select(F.col("id").alias("at"), F.lit(None).cast("binary").alias("hash"), F.col("body_hash").alias("body"), F.lit(True).alias("new"))
        own = own.select("at", "hash", F.lit(None).cast("string").alias("body"), F.lit(False).alias("new")).unionByName(bodies)
        own = own.withColumn("k", F.xxhash64("at")).repartition("k", "at")  # few rows of a task share a caller: nothing to gather before
        new = own.groupBy("k", "at").agg(F.array_sort(F.collect_list("hash")).alias("callees"), F.max("body").alias("body"), F.max("new").alias("new"))
        text = F.when(F.col("body").isNotNull(), F.concat_ws(":", "body", F.transform("callees", lambda h: F.lower(F.hex(h)))))
        parts.append(durable(new.where("new").select(F.col("at").alias("id"), F.unhex(F.sha2(text, 256)).alias("hash"))))
        if n:
            met = durable(left.join(by_size(parts[-1], freed), _met("to", "id"), "left").select("at", "to", "hash"))
        if len(parts) % 10 == 0:  # short plans however deep the graph
            parts = [durable(union_all(parts))]
            told = [durable(union_all(told).join(by_size(waiting.select(F.col("id").alias("x")), n), _met("at", "x"), "left_semi"))] if n else []
    return union_all(parts).select("id", F.lower(F.hex("hash")).alias("dependency_hash")), waiting, n, most or 0


def _condensed(graph: Graph, known: DataFrame) -> DataFrame:
    """(id, dependency_hash) where ``known`` are taken as they are: by groups, a cycle or a single node each."""
    nodes = durable(graph.nodes.select("id", "body_hash"))
    e = arcs(graph.edges).where(F.col("at") != F.col("to"))
    inside = nodes.select("id")
    e = e.join(inside.withColumnRenamed("id", "at"), "at", "left_semi").join(inside.withColumnRenamed("id", "to"), "to", "left_semi")
    e = durable(e)
    # without cycles the levels are those of the nodes themselves, and no components have to be looked for
    levels = durable(peel(nodes.select(F.col("id").alias("group")), e.select(F.col("at").alias("ga"), F.col("to").alias("gb"))))
    tangled = nodes.join(levels.select(F.col("group").alias("id")), "id", "left_anti").select("id")
    knot = e.join(tangled.withColumnRenamed("id", "at"), "at", "left_semi").join(tangled.withColumnRenamed("id", "to"), "to", "left_semi")
    scc = strong_components(knot.select(F.col("at").alias("source"), F.col("to").alias("target")))
    group = durable(nodes.join(scc, "id", "left").select("id", "body_hash", F.coalesce("component", "id").alias("group"), F.col("component").isNotNull().alias("cyclic")))
    body = group.groupBy("group").agg(F.max("cyclic").alias("cyclic"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "body_hash"))), "|").alias("members"), F.min("body_hash").alias("body"))
    a, b = group.select(F.col("id").alias("at"), F.col("group").alias("ga")), group.select(F.col("id").alias("to"), F.col("group").alias("gb"))
    calls = durable(e.join(a, "at").join(b, "to").where("ga <> gb").select("ga", "gb").distinct())
    done = durable(group.join(known, "id").groupBy("group").agg(F.max("dependency_hash").alias("hash")))
    body = durable(body.join(done, "group", "left_anti"))
    # a group is hashed in the round after its last callee; hashes of callees are collected as they come
    waiting = calls.join(done, calls.gb == done.group, "left_anti")
    levels = durable(peel(body.select("group"), durable(waiting.join(body.select(F.col("group").alias("ga")), "ga", "left_semi"))))
    depth = levels.agg(F.max("level")).first()[0]
    got = calls.join(done, calls.gb == done.group).select(F.col("ga").alias("group"), "hash")
    for level in range((-1 if depth is None else depth) + 1):
        ready = levels.where(F.col("level") == level).select("group").join(body, "group")
        callees = got.groupBy("group").agg(F.array_sort(F.collect_list("hash")).alias("callees"))
        new = ready.join(callees, "group", "left").withColumn("callees", F.coalesce("callees", F.array().cast("array<string>")))
        own = F.when(F.col("cyclic"), F.concat_ws("|", "members", F.array_join("callees", ":")))
        plain = F.when(F.size("callees") == 0, F.col("body")).otherwise(F.concat(F.col("body"), F.lit(":"), F.array_join("callees", ":")))
        new = durable(new.select("group", F.sha2(F.coalesce(own, plain), 256).alias("hash")))
        done = done.unionByName(new)
        passed = calls.join(new, calls.gb == new.group).select(F.col("ga").alias("group"), "hash")
        got = got.join(new.select("group"), "group", "left_anti").unionByName(passed)
        if level % 10 == 9:  # short plans however deep the graph
            done, got = durable(done), durable(got)
    return group.join(done, "group").select("id", F.col("hash").alias("dependency_hash"))


def rehash(graph: Graph, old: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, dependency_hash) after changes: only changed(node) and what depends on them is computed."""
    touched = durable(invalidated(graph, changed).select(F.col("node").alias("id")))
    kept = old.join(touched, "id", "left_anti").join(graph.nodes.select("id"), "id", "left_semi").select("id", "dependency_hash")
    return dependency_hashes(graph, durable(kept))


def verify(graph: Graph, stored: DataFrame) -> DataFrame:
    """(id, stored, computed) where a stored hash is not what the graph gives."""
    now = dependency_hashes(graph).withColumnRenamed("dependency_hash", "computed")
    j = now.join(stored.select("id", F.col("dependency_hash").alias("stored")), "id", "full")
    return j.where(~F.col("stored").eqNullSafe(F.col("computed"))).select("id", "stored", "computed")


def explain_change(graph: Graph, old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, cause): nodes whose hash changed, because of their own body or of a callee."""
    j = new.select("id", F.col("dependency_hash").alias("n")).join(old.select("id", F.col("dependency_hash").alias("o"), F.col("body_hash").alias("ob")), "id", "left").join(graph.nodes.select("id", "body_hash"), "id")
    cause = F.when(F.col("o").isNull(), "new").when(F.col("ob") != F.col("body_hash"), "body").otherwise("dependency")
    return j.where(~F.col("o").eqNullSafe(F.col("n"))).select("id", cause.alias("cause"))
