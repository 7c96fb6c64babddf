"""Label propagation and greedy modularity against nodes that take their turns one by one."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import communities


def graph(spark, pairs, extra=(), files=None):
    ids = sorted({x for p in pairs for x in p} | set(extra))
    nodes = spark.createDataFrame([(i, (files or {}).get(i, i.split("::")[0]), "function") for i in ids], "id string, file string, type string")
    edges = spark.createDataFrame([(a, b, "call", "static") for a, b in pairs], "source string, target string, edge_type string, confidence string")
    return Graph(nodes, edges)


def labels_by_turns(pairs, sweeps=20):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    label = {n: n.split("::")[0] for n in near}
    for _ in range(sweeps):
        before = dict(label)
        for n in sorted(near):
            votes = defaultdict(int)
            for other in near[n]:
                votes[label[other]] += 1
            label[n] = max((count, name) for name, count in votes.items())[1]
        if label == before:
            break
    return label


def communities_by_turns(weights, passes=50):
    near = defaultdict(lambda: defaultdict(int))
    for a, b, w in weights:
        near[a][b] += w
        near[b][a] += w
    degree = {f: sum(x.values()) for f, x in near.items()}
    m2, own = sum(degree.values()), {f: f for f in near}
    for _ in range(passes):
        before = dict(own)
        for f in sorted(near):
            def gain(c):
                return sum(w for g, w in near[f].items() if own[g] == c) * m2 - degree[f] * sum(degree[g] for g in near if g != f and own[g] == c)  # noqa: B023

            best = min({own[g] for g in near[f]} | {own[f]}, key=lambda c: (-gain(c), c != own[f], c))  # noqa: B023
            own[f] = best
        if own == before:
            break
    return own


def shapes():
    """Random graphs, a long chain in order, a star, cliques joined in a row, a self-loop."""
    rng = random.Random(7)
    name = lambda i: f"m{i * 7 % 11:02d}::n{i:03d}"
    yield [(name(rng.randrange(60)), name(rng.randrange(60))) for _ in range(90)]
    yield [(f"m{i % 4}::{i:03d}", f"m{(i + 1) % 4}::{i + 1:03d}") for i in range(25)] + [("m0::000", "m0::000")]
    yield [("hub::h", f"leaf{i % 5}::{i}") for i in range(40)] + [(f"leaf{i % 5}::{i}", f"leaf{(i + 1) % 5}::{i + 1}") for i in range(0, 40, 3)]
    yield [(f"c{k}::{i}", f"c{k}::{j}") for k in range(6) for i in range(5) for j in range(i)] + [(f"c{k}::0", f"c{k + 1}::4") for k in range(5)]


@pytest.mark.parametrize("k", range(4))
def test_label_propagation_is_that_of_turns(spark, k):
    pairs = list(shapes())[k]
    got = {r["id"]: r["label"] for r in communities.propagate_labels(graph(spark, pairs)).collect()}
    assert got == labels_by_turns(pairs)


def test_the_largest_of_equal_labels_wins(spark):
    got = {r["id"]: r["label"] for r in communities.propagate_labels(graph(spark, [("a::1", "b::1"), ("a::1", "c::1")]), 1).collect()}
    assert got["a::1"] == "c"


@pytest.mark.parametrize("k", range(4))
def test_modularity_is_that_of_turns(spark, monkeypatch, k):
    monkeypatch.setattr(communities, "BUCKET", 2)  # many buckets
    pairs = [(a, b) for a, b in list(shapes())[k] if a != b]
    weights = defaultdict(int)
    for a, b in pairs:
        weights[min(a, b), max(a, b)] += 1
    g = graph(spark, pairs, files={x: x for p in pairs for x in p})
    got = {r["id"]: r["label"] for r in communities.greedy_modularity(communities.file_weights(g)).collect()}
    assert got == communities_by_turns([(a, b, w) for (a, b), w in weights.items()])


def test_partitions_attach_small_groups_to_their_module(spark):
    pairs = [(f"a::{i}", f"a::{j}") for i in range(4) for j in range(i)]
    parts = {r["id"]: r["partition_id"] for r in communities.partitions(graph(spark, pairs, extra=["a::alone", "q::alone"])).collect()}
    assert parts["a::alone"] == parts["a::0"] and parts["q::alone"].startswith("q_")


def test_overview_of_communities(spark):
    g = graph(spark, [("a::1", "a::2"), ("a::2", "b::1"), ("b::1", "b::2"), ("x::1", "a::1")], files={"a::1": "src/a.py", "a::2": "src/sub/a2.py", "b::1": "", "b::2": "b.py"})
    parts = spark.createDataFrame([("a::1", "P"), ("a::2", "P"), ("b::1", "Q"), ("b::2", "Q"), ("x::1", "Q"), ("gone::1", "Q")], "id string, partition_id string")
    declared = spark.createDataFrame([("a::1", "core"), ("a::2", " core "), ("b::1", "edge"), ("b::2", "")], "id string, subsystem string")
    out = {r["partition_id"]: r.asDict() for r in communities.community_overview(g, parts, declared).collect()}
    assert out["P"] == {"partition_id": "P", "size": 2, "internal_edges": 1, "boundary_edges": 2, "boundary_nodes": 2, "files": 2, "directories": 2, "type_counts": {"function": 2}, "declared_subsystem": "core"}
    assert out["Q"]["size"] == 4 and out["Q"]["files"] == 4 and out["Q"]["declared_subsystem"] is None and out["Q"]["directories"] == 1


def test_names_of_subsystems(spark):
    cases = [
        (["src/app/a.py"], "a"), (["src/app/a.py", "src/app/b.py"], "src/app"), (["src/a.py", "lib/b.py", "lib/c.py"], "lib"), (["b.py", "a.py"], "a.py"), ([], "unknown"), (["src\\x\\a.py", "src/y/b.py"], "src"),
    ]
    df = spark.createDataFrame([(k, f) for k, (f, _) in enumerate(cases)], "k int, files array<string>")
    got = {r["k"]: r["name"] for r in df.select("k", communities.subsystem_name(F.col("files")).alias("name")).collect()}
    assert got == {k: name for k, (_, name) in enumerate(cases)}


def test_report_adds_up_to_the_modularity(spark):
    g = graph(spark, [(f"{k}{i}::x", f"{k}{j}::x") for k in "ab" for i in range(4) for j in range(i)] + [("a0::x", "b0::x")])
    owners = communities.subsystems_by_modularity(g)
    out = communities.subsystem_report(g, owners, 1).collect()
    assert len(out) == 2 and {(r["internal_edges"], r["external_edges"]) for r in out} == {(6, 1)}
    assert sum(r["share"] for r in out) == pytest.approx(2 * (6 / 13 - 0.25), abs=1e-5)
    link = communities.subsystem_couplings(g, owners).first()
    assert (link["edge_count"], link["coupling_strength"]) == (1, pytest.approx(1 / 13, abs=1e-6))
    empty = graph(spark, [], extra=["a::1"])
    assert communities.partitions(empty).count() == 1 and communities.subsystems_by_modularity(empty).count() == 1
