"""Planned graphs against changes that are applied one by one."""

import random

import pytest

from graphloom.graph import Graph
from graphloom.operators import planned, traverse


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, i.split("::")[0], "function", 1, "h", None) for i in sorted(nodes)], "id string, file string, type string, line int, body_hash string, dependency_hash string")
    e = spark.createDataFrame([(a, b, k, "static") for a, b, k in edges], "source string, target string, edge_type string, confidence string")
    notes = spark.createDataFrame([(i, 2, "service") for i in sorted(nodes)], "id string, layer int, arch_layer string")
    return Graph(n, e, notes)


def check(spark, nodes, edges, ops):
    want_nodes, want_edges = planned.written_out(set(nodes), list(edges), ops)
    got = planned.planned(graph(spark, nodes, edges), planned.change_list(spark, ops))
    assert sorted(r["id"] for r in got.nodes.collect()) == sorted(want_nodes), ops
    assert sorted((r["source"], r["target"], r["edge_type"]) for r in got.edges.collect()) == sorted(want_edges), ops
    return got, want_nodes, want_edges


@pytest.mark.parametrize("ops", [
    [("rename_node", "a", "b2"), ("add_node", "a"), ("add_edge", "a", "b2"), ("remove_edge", "b2", "b")],
    [("remove_node", "a"), ("add_node", "a"), ("rename_node", "a", "z"), ("add_edge", "z", "c")],
    [("rename_node", "a", "x"), ("rename_node", "x", "y"), ("remove_node", "y"), ("add_edge", "a", "c")],
    [("rename_node", "a", "b"), ("remove_edge", "b", "b"), ("add_edge", "c", "b", "event")],
    [("add_edge", "a", "c"), ("remove_node", "c"), ("add_edge", "b", "c"), ("remove_edge", "a", "c")],
    [],
])
def test_changes_in_order(spark, ops):
    check(spark, "abc", [("a", "b", "call"), ("b", "c", "call"), ("a", "b", "call"), ("c", "a", "event")], ops)


def test_random_changes_and_traversals(spark):
    rng = random.Random(11)
    for _ in range(6):
        names = [f"m{k % 3}::n{k}" for k in range(9)]
        nodes, edges = names[:6], [(rng.choice(names[:6]), rng.choice(names[:6]), rng.choice(["call", "event"])) for _ in range(10)]
        ops = []
        for _ in range(14):
            op = rng.choice(["add_node", "remove_node", "rename_node", "add_edge", "add_edge", "remove_edge"])
            ops.append((op, rng.choice(names)) if op in ("add_node", "remove_node") else (op, *rng.sample(names, 2), *([] if op == "rename_node" else [rng.choice(["call", "event"])])))
        got, want_nodes, want_edges = check(spark, nodes, edges, ops)
        start = sorted(want_nodes)[0] if want_nodes else "none"
        plain = graph(spark, want_nodes, want_edges)
        for walk in (traverse.dependencies, traverse.dependents):
            assert sorted(r["id"] for r in walk(got, start).collect()) == sorted(r["id"] for r in walk(plain, start).collect())
        assert {r["id"] for r in got.annotations.collect()} <= want_nodes
