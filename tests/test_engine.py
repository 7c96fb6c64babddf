"""The graph operators on small graphs with awkward shapes, and every registered query against SQL."""

import hashlib
import os
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom import graph
from graphloom.functions import text
from graphloom.graph import Graph, module_of, validate
from graphloom.operators import cas, components, diff, governance, history, lookup, metrics, policy, score, semantics, simulate, traverse
from graphloom.plans import catalog, formats, index
from graphloom.plans.expressions import Engine, QueryError, parse, render
from graphloom.sources import code, files, runtime
from graphloom.streaming import events
from graphloom.streaming.state import KeyedState

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def make(spark, pairs, extra=(), layers=None, arch=None, types=None):
    """A graph of (source, target) pairs; ``m::x`` lies in file ``m``."""
    ids = sorted({x for p in pairs for x in p[:2]} | set(extra))
    nodes = spark.createDataFrame([(i, i.split("::")[0], (types or {}).get(i, "function"), k, "h" + i, None) for k, i in enumerate(ids)], "id string, file string, type string, line int, body_hash string, dependency_hash string")
    edges = spark.createDataFrame([(p[0], p[1], p[2] if len(p) > 2 else "call", "static") for p in pairs], "source string, target string, edge_type string, confidence string")
    notes = spark.createDataFrame([(i, (layers or {}).get(i, 3), (arch or {}).get(i, "")) for i in ids], "id string, layer int, arch_layer string")
    return Graph(nodes, edges, notes)


@pytest.fixture(scope="module")
def awkward(spark):
    """A cycle with a self-loop and parallel edges, a diamond, a bridge, an isolated node, hostile ids."""
    pairs = [("a::1", "a::2"), ("a::2", "a::3"), ("a::3", "a::1"), ("a::3", "a::3"), ("a::1", "a::2"), ("b::1", "b::2"), ("b::1", "b::3"), ("b::2", "b::4"), ("b::3", "b::4"), ("a::3", "b::1"), ("c%::x_", "c%::X.[")]
    return make(spark, pairs, extra=["d::alone", "d"], types={"d": "module"})


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


# ---- lookups


def test_search_is_a_literal_unless_it_has_wildcards(awkward):
    assert ids(lookup.search_nodes(awkward, "%")) == ["c%::X.[", "c%::x_"]
    assert ids(lookup.search_nodes(awkward, "_")) == ["c%::x_"]
    assert ids(lookup.search_nodes(awkward, "C%::?*")) == ["c%::X.[", "c%::x_"]
    assert ids(lookup.search_nodes(awkward, "*", 2)) == ["a::1", "a::2"]


@pytest.mark.parametrize(("glob", "hit", "miss"), [("a*c", "a/b/c", "a/b/cd"), ("[!a]?", "bx", "ax"), ("a.b", "a.b", "axb"), ("a[", "a[", "ab"), ("[a-c]", "b", "d")])
def test_globs(spark, glob, hit, miss):
    df = spark.createDataFrame([(hit,), (miss,)], "s string")
    assert [r["s"] for r in df.where(lookup.matches("s", glob)).collect()] == [hit]


def test_suggestions_and_resolution(awkward):
    assert ids(lookup.suggest(awkward, "ALO")) == ["d::alone"]
    assert ids(lookup.resolve(awkward, "1")) == ["a::1", "b::1"]
    assert ids(lookup.suggest(awkward, "nothing")) == []


def test_edge_filters_count_by_the_first_that_takes(spark):
    g = make(spark, [("m::f", "m::C::__init__"), ("m::f", "logger.info"), ("m::f", "os.path.join"), ("m::f", "m::setup_module"), ("m::f", "m::test_fixture"), ("m::f", "m::__call__")])
    kept, counts = lookup.filter_edges(g, [("dunder", lookup.dunder_edges()), ("logging", lookup.logging_edges()), ("stdlib", lookup.stdlib_edges()), ("harness", lookup.harness_edges())])
    assert sorted(ids(kept, "target")) == ["m::__call__", "m::test_fixture"]
    assert {r["filter"]: r["removed"] for r in counts.collect()} == {"dunder": 1, "logging": 1, "stdlib": 1, "harness": 1}


def test_validation_finds_what_is_wrong(spark):
    g = make(spark, [("a", "b", "bad")], types={"a": "thing"})
    g = Graph(g.nodes.where("id <> 'b'"), g.edges, g.annotations)
    assert sorted(r["kind"] for r in validate(g).collect()) == ["edge_type", "node_type", "unknown_end"]


# ---- traversals


def test_origin_on_a_cycle(awkward):
    assert ids(traverse.dependencies(awkward, "a::1")) == ["a::2", "a::3", "b::1", "b::2", "b::3", "b::4"]
    assert "a::1" in ids(traverse.dependents(awkward, "a::1"))
    assert ids(traverse.dependents(awkward, "b::1")) == ["a::3", "a::2", "a::1"]
    assert ids(traverse.callers(awkward, "a::3")) == sorted(r["source"] for r in awkward.edges.where("target = 'a::3'").collect())
    assert ids(traverse.callers(awkward, "a::3", 5)) == ["a::1", "a::2"]
    with pytest.raises(ValueError):
        traverse.callers(awkward, "a::1", 0)


def test_limits_tell_the_total(awkward):
    found = traverse.dependents(awkward, "b::1").select("id")
    n = found.count()
    assert [tuple(r) for r in traverse.limited(found, 2).collect()] == [(i, n, n > 2) for i in sorted(ids(found))[:2]]
    assert {(r["total"], r["truncated"]) for r in traverse.limited(found, None).collect()} == {(n, False)}
    assert traverse.limited(found, 0).count() == n


def test_levels_of_a_graph_with_cycles(spark):
    g = make(spark, [("top", "a"), ("a", "b"), ("b", "a"), ("b", "low"), ("a", "a"), ("low", "end"), ("top", "end")])
    got = {r["id"]: r["level"] for r in components.topological_levels(g.edges).collect()}
    assert got == {"end": 0, "low": 1, "a": 2, "b": 2, "top": 3}


def test_levels_without_cycles_look_for_no_components(spark, monkeypatch):
    monkeypatch.setattr(components, "strong_components", lambda edges: pytest.fail("looked for components"))
    got = {r["id"]: r["level"] for r in components.topological_levels(make(spark, [("top", "a"), ("a", "end"), ("top", "end"), ("a", "a")]).edges).collect()}
    assert got == {"end": 0, "a": 1, "top": 2}


def test_index_lookups(spark, awkward, tmp_path):
    hashes = cas.dependency_hashes(awkward)
    counts = index.write_index(awkward, str(tmp_path / "i"), hashes)
    i = index.Index(spark, str(tmp_path / "i"))
    assert counts["nodes"] == awkward.nodes.count() == counts["dependency_hashes"] and counts["callers"] == awkward.edges.count() == counts["callees"]
    assert i.node("a::1").drop("bucket").collect() == lookup.get_node(awkward, "a::1").select(i.node("a::1").columns).collect()
    for node in ("a::1", "a::3", "unknown"):
        assert sorted(map(tuple, i.callers(node).collect())) == sorted(map(tuple, lookup.callers_of(awkward, node).collect()))
        assert sorted(map(tuple, i.callees(node).collect())) == sorted(map(tuple, lookup.callees_of(awkward, node).collect()))
        assert ids(i.tests_of(node), "test_id") == ids(lookup.tests_of(awkward, node), "test_id")
    assert ids(i.node_ids()) == ids(lookup.node_ids(awkward)) and ids(i.search("a::*")) == ids(lookup.search_nodes(awkward, "a::*"))
    assert i.dependency_hash("a::1").first()["dependency_hash"] == hashes.where("id = 'a::1'").first()["dependency_hash"]
    assert i.graph().edges.exceptAll(awkward.edges.select(i.graph().edges.columns)).count() == 0


def test_a_lookup_writes_only_what_it_reads(spark, awkward, tmp_path):
    tables = lambda name: {p.stem for p in (tmp_path / name).glob("*.json")}
    i = index.Index(spark, str(tmp_path / "i"), awkward)
    assert sorted(map(tuple, i.callers("a::3").collect())) == sorted(map(tuple, lookup.callers_of(awkward, "a::3").collect())) and tables("i") == {"callers"}
    assert ids(i.tests_of("a::3"), "test_id") == ids(lookup.tests_of(awkward, "a::3"), "test_id") and tables("i") == {"callers", "nodes"}
    j = index.Index(spark, str(tmp_path / "j"), awkward)
    assert ids(j.search("a::*")) == ids(lookup.search_nodes(awkward, "a::*")) and tables("j") == {"trigrams", "trigram_counts"}
    for node in ids(awkward.nodes):
        assert ids(i.nodes_of_test(node), "node_id") == ids(lookup.nodes_of_test(awkward, node), "node_id")


def test_a_key_of_most_rows_is_cut_into_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 50)
    g = make(spark, [(f"m::{k}", "hub::1") for k in range(1000)])
    index.write_table(g, str(tmp_path), "callers")
    files = [spark.read.parquet(str(p)).count() for p in (tmp_path / "callers").rglob("*.parquet")]
    assert sum(files) == 1000 and max(files) <= 150
    assert index.Index(spark, str(tmp_path)).callers("hub::1").count() == 1000


def test_searches_by_trigram(spark, tmp_path):
    names = ["Src/App.py::Run", "src/app.py::runner", "lib/x.py::a*b", "lib/\u0130x.py::c", "z", "src/main.py::go"]
    g = make(spark, [], extra=names)
    index.write_index(g, str(tmp_path / "i"))
    i = index.Index(spark, str(tmp_path / "i"))
    for pattern in ("*APP*", "run", "src/*go", "??", "zz", "a*b", "nothing here", "*", "\u0130x", "x.py"):
        assert ids(i.search(pattern)) == ids(lookup.search_nodes(g, pattern)), pattern
        assert ids(i.suggest(pattern)) == ids(lookup.suggest(g, pattern)), pattern
        assert ids(i.resolve(pattern)) == ids(lookup.resolve(g, pattern)), pattern
    assert ids(i.nodes_in_file("src/app.py")) == ["src/app.py::runner"]


def test_a_search_reads_the_buckets_of_its_trigrams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 50)
    g = make(spark, [], extra=[f"mod{k % 7}::name{k}" for k in range(120)])
    index.write_index(g, str(tmp_path / "i"))
    i = index.Index(spark, str(tmp_path / "i"))
    assert ids(i.search("*name119")) == ["mod0::name119"]
    found = i.candidates("*name119")
    # of the folders of the trigram table only that of the rarest one is listed
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (= \d+|IN )", found._jdf.queryExecution().executedPlan().toString())
    assert len(list((tmp_path / "i" / "trigrams").glob("bucket=*"))) > 10 and found.count() == 1


def test_paths(awkward):
    assert traverse.path(awkward, "a::1", "b::4").first()["path"] == ["a::1", "a::2", "a::3", "b::1", "b::2", "b::4"]
    assert traverse.path(awkward, "a::1", "a::1").first()["path"] == ["a::1"]
    assert traverse.path(awkward, "b::4", "a::1").count() == 0
    assert traverse.path(awkward, "a::1", "b::4", 4).count() == 0
    assert ids(traverse.orphans(awkward)) == ["d::alone"]
    assert ids(traverse.dependencies(awkward, "a::1", limit=2)) == ["a::2", "a::3"]
    assert ids(traverse.dependencies(awkward, "unknown")) == []


def plain_reach(pairs, start):
    out, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_against_plain_algorithms(spark, seed):
    rng = random.Random(seed)
    names = [f"m{i % 4}::{i:02}" for i in range(16)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(22)]
    g = make(spark, pairs, extra=names)
    reached = {n: plain_reach(pairs, n) for n in names}
    want = {(n, m) for n in names for m in reached[n]}
    seeds = g.nodes.select(F.col("id").alias("origin"), F.col("id").alias("node"))
    assert {(r["origin"], r["node"]) for r in traverse.reach(traverse.arcs(g.edges), seeds).collect()} == want
    both = {n: plain_reach(pairs + [(b, a) for a, b in pairs], n) | {n} for n in names}
    assert {r["id"]: r["component"] for r in components.weak_components(g.nodes, g.edges).collect()} == {n: min(both[n]) for n in names}
    strong = {n: {m for m in reached[n] if n in reached[m]} for n in names}
    assert {r["id"]: r["component"] for r in components.strong_components(g.edges).collect()} == {n: min(s) for n, s in strong.items() if len(s) > 1}
    bridges = {p for p in set(pairs) if p[0] != p[1] and pairs.count(p) + pairs.count(p[::-1]) == 1 and p[1] not in plain_reach([q for x in pairs if x != p for q in (x, x[::-1])], p[0])}
    assert {(r["source"], r["target"]) for r in components.bridges(g).collect()} == bridges
    assert {(r["source"], r["target"]) for r in components.bridges(g, one_task=0).collect()} == bridges


def test_weak_components_keep_no_row_for_each_edge(spark, monkeypatch):
    monkeypatch.setattr(components, "STRETCH_BYTES", 1)
    held, keep = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: held.append(keep(df)) or held[-1])
    g = make(spark, [(f"m::{i}", f"n{j}") for i in range(60) for j in range(60)] + [("x::1", "é"), ("é", "x::1"), ("self", "self")], extra=["alone", "alone2"])
    g = Graph(g.nodes.where("id <> 'x::1'"), g.edges.repartition(4))
    got = {r["id"]: r["component"] for r in components.weak_components(g.nodes, g.edges).collect()}
    assert len(got) == 125 and {got[f"m::{i}"] for i in range(60)} | {got[f"n{i}"] for i in range(60)} == {"m::0"}
    assert (got["é"], got["x::1"], got["self"], got["alone"]) == ("x::1", "x::1", "self", "alone")
    assert max(df.count() for df in held) <= 4 * 122


def test_weak_components_of_a_long_chain_in_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(components, "STRETCH_BYTES", 1)
    names = [f"n{i * 7919 % 500:03}" for i in range(500)]
    edges = make(spark, list(zip(names[:250], names[1:250])) + list(zip(names[251:], names[250:]))).edges.repartition(40)
    got = {r["id"]: r["component"] for r in components.weak_components(edges.select(F.col("source").alias("id")).limit(0), edges).collect()}
    assert got == {n: min(names[:250]) for n in names[:250]} | {n: min(names[250:]) for n in names[250:]}


def test_hashes_meet_each_arc_once_and_look_for_components_only_of_what_is_left(spark, monkeypatch):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    pairs = [("top", "mid"), ("top", "end"), ("top", "end"), ("mid", "end"), ("mid", "mid"), ("mid", "outside"), ("far", "outside"), ("outside", "end")]
    g = make(spark, pairs, extra=["alone"])
    g = Graph(g.nodes.where("id <> 'outside'").unionByName(g.nodes.where("id = 'end'")).withColumn("body_hash", F.expr("if(id = 'alone', null, body_hash)")), g.edges)
    end = sha("hend")
    mid = sha("hmid:" + end)
    want = [("alone", None), ("end", end), ("end", end), ("far", sha("hfar")), ("mid", mid), ("top", sha(":".join(["htop", *sorted([mid, end])])))]
    with monkeypatch.context() as m:
        m.setattr(cas, "peel", lambda *a: pytest.fail("went over levels apart from hashes"))
        m.setattr(cas, "strong_components", lambda edges: pytest.fail("looked for components"))
        assert sorted(map(tuple, cas.dependency_hashes(g).collect())) == want
        chain = make(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(24)])
        below = None
        for i in reversed(range(25)):
            below = sha(f"hn{i:02}:{below}" if below else f"hn{i:02}")
        assert cas.dependency_hashes(chain).where("id = 'n00'").first()["dependency_hash"] == below
    pairs += [("a", "b"), ("b", "a"), ("b", "mid"), ("above", "a"), ("above", "end"), ("above", "alone")]
    knot = make(spark, pairs, extra=["alone"])
    ring = sha(f"a:ha|b:hb|{got['mid']}") if (got := {r["id"]: r["dependency_hash"] for r in cas.dependency_hashes(knot).collect()}) else None
    assert got["a"] == got["b"] == ring and got["above"] == sha(":".join(["habove", *sorted([ring, end, sha("halone")])]))
    assert len(got) == 9 and got["outside"] == sha("houtside:" + end)


@pytest.mark.parametrize("few", [0, 60, 1_000_000])
def test_few_links_of_weak_components_are_joined_by_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(components, "STRETCH_BYTES", 1)
    monkeypatch.setattr(components, "KEPT_BYTES", 0)
    monkeypatch.setattr(components, "FEW_LINKS", few)
    held, keep = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: held.append(1) or keep(df))
    names = [f"n{i * 7919 % 400:03}" for i in range(400)]
    g = make(spark, list(zip(names[:200], names[1:200])) + list(zip(names[201:], names[200:])), extra=["alone"])
    twice = Graph(g.nodes.where("id <> 'n000'").unionByName(g.nodes.where("id in ('n001', 'alone')")), g.edges.repartition(30))
    got = components.weak_components(twice.nodes, twice.edges).collect()
    want = {n: min(names[:200]) for n in names[:200]} | {n: min(names[200:]) for n in names[200:]} | {"alone": "alone"}
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want) + 2
    assert few < 1_000_000 or len(held) == 5


def test_stretches_of_few_nodes_go_on_with_them(monkeypatch):
    monkeypatch.setattr(components, "STRETCH_BYTES", 1)
    batches = [pa.record_batch({"source": [f"m{i}", "é"], "target": [f"m{i + 1}", "z"]}) for i in range(9)]
    rows = [r for x in components._stars(iter(batches)) for r in x.to_pylist()]
    assert {r["id"]: r["root"] for r in rows} == {f"m{i}": "m0" for i in range(10)} | {"z": "z", "é": "z"} and len(rows) == 12


def test_empty_graphs(spark):
    g = make(spark, [], extra=["x::1"])
    assert components.strong_components(g.edges).count() == 0
    assert ids(components.weak_components(g.nodes, g.edges)) == ["x::1"]
    assert components.bridges(g).count() == 0 and metrics.hubs(g).count() == 0
    assert [r["fan_in"] for r in metrics.degrees(g).collect()] == [0]
    assert score.health(g).first()["fan_in_entropy"] == 0


# ---- metrics


def test_hubs_keep_ties(spark):
    g = make(spark, [("x::1", "h::1"), ("x::2", "h::2")], extra=[f"z::{i}" for i in range(5)])
    assert ids(metrics.hubs(g)) == ["x::1", "x::2"]


def test_best_edges_and_compression(spark):
    g = make(spark, [("a::x", "b::y"), ("a::x", "b::y", "trace"), ("a::C::m", "a::C::n")])
    assert [r["edge_type"] for r in metrics.best_edges(g).where("target = 'b::y'").collect()] == ["trace"]
    assert {(r["source"], r["target"]) for r in metrics.compress(g).collect()} == {("a", "b"), ("a", "a")}
    assert {(r["source"], r["target"]) for r in metrics.compress(g, metrics.class_of).collect()} == {("a", "b"), ("a::C", "a::C")}


def test_betweenness_of_a_chain(spark):
    g = make(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    found = {r["id"]: r["betweenness"] for r in components.betweenness(g).collect()}
    assert found == pytest.approx({"a": 0, "b": 2 / 6, "c": 2 / 6, "d": 0})


# ---- diffs and hashes


def test_delta_equals_full_build(spark):
    old = make(spark, [("a::1", "b::1"), ("b::1", "c::1"), ("c::1", "a::1")])
    new = make(spark, [("a::1", "b::1"), ("b::1", "b::2"), ("b::2", "a::1")])
    merged = diff.apply_delta(old, new)
    out = diff.snapshot_diff({"nodes": merged.nodes, "edges": merged.edges}, {"nodes": new.nodes, "edges": new.edges})
    assert all(r["only_old"] == r["only_new"] == 0 for r in out.collect())
    same = diff.diff_nodes(old, old).select("change").distinct().collect()
    assert [r["change"] for r in same] == ["unchanged"]


def test_renames_and_collisions(spark):
    old = spark.createDataFrame([("a.py", "1"), ("b.py", "2")], "path string, content_hash string")
    new = spark.createDataFrame([("c.py", "1"), ("b.py", "3"), ("d.py", "4")], "path string, content_hash string")
    assert {(r["path"], r["old_path"], r["change"]) for r in diff.changed_paths(old, new).collect()} == {("c.py", "a.py", "renamed"), ("b.py", None, "modified"), ("d.py", None, "added")}
    twice = spark.createDataFrame([("x", "f", 9), ("x", "f", 2)], "id string, file string, line int")
    assert {(r["id"], r["line"]) for r in diff.number_collisions(twice).collect()} == {("x", 2), ("x[2]", 9)}
    moved = spark.createDataFrame([("a.py::f",), ("a.pyx::f",)], "id string").select(diff.rename_prefix(F.col("id"), "a.py", "z.py").alias("id"))
    assert ids(moved) == ["z.py::f", "a.pyx::f"]


def test_hashes_change_upwards_only(spark, awkward):
    before = cas.dependency_hashes(awkward)
    touched = Graph(awkward.nodes.withColumn("body_hash", F.expr("if(id = 'b::2', 'new', body_hash)")), awkward.edges)
    seeds = spark.createDataFrame([("b::2",)], "node string")
    after = {r["id"]: r["dependency_hash"] for r in cas.rehash(touched, before, seeds).collect()}
    old = {r["id"]: r["dependency_hash"] for r in before.collect()}
    assert {i for i in old if old[i] != after[i]} == {"b::2", "b::1", "a::1", "a::2", "a::3"}
    assert after == {r["id"]: r["dependency_hash"] for r in cas.dependency_hashes(touched).collect()}
    assert old["a::1"] == old["a::2"]


def test_annotations(spark):
    cols = "id string, intent string, layer int, arch_layer string, tags array<string>, intent_version int"
    old = spark.createDataFrame([("a", "x", 3, "service", ["t"], 1)], cols)
    new = spark.createDataFrame([("a", "y", 4, "", ["u"], 1), ("b", "z", 3, "", [], 1)], cols)
    out = {r["id"]: r for r in diff.upsert_annotations(old, new).collect()}
    assert (out["a"]["intent"], out["a"]["arch_layer"], out["a"]["intent_version"], out["b"]["intent_version"]) == ("y", "service", 2, 1)


# ---- policies and simulation


def test_rules(spark):
    g = make(spark, [("a::1", "b::1"), ("b::1", "c::1")], layers={"a::1": 1, "b::1": 2, "c::1": 0}, arch={"c::1": "infra"})
    rules = policy.rules_table(spark, [
        {"id": "f", "type": "forbidden_call", "source": "a::*", "target_layer": 2},
        {"id": "r", "type": "required_call", "source": "?::1", "target_arch_layer": "infra"},
        {"id": "g", "type": "forbidden_call", "source": "?::1", "target_arch_layer": "infra"},
        {"id": "n", "type": "forbidden_call", "source": "none*", "target": "a::1"},
        {"id": "l", "type": "dependency_limit", "source": "*", "max_fan_out": 0},
    ])
    assert {tuple(r) for r in policy.forbidden_calls(g, rules).collect()} == {("f", "a::1", "b::1"), ("g", "b::1", "c::1")}
    assert {tuple(r) for r in policy.missing_calls(g, rules).collect()} == {("r", "a::1"), ("r", "c::1")}
    assert {r["status"] for r in policy.rule_status(g, rules).where("rule_id = 'n'").collect()} == {"dangling"}
    assert {tuple(r) for r in policy.conflicting_rules(rules).collect()} == {("r", "g")}
    assert policy.fan_violations(g, rules).count() == 2


def test_simulation_blocks_a_new_cycle(spark, awkward):
    changes = simulate.change_set(spark, [("add", "b::4", "b::1")])
    row = simulate.verdict(simulate.assess(awkward, changes)).first()
    assert (row["new_cycles"], row["risk"], row["verdict"]) == (1, "blocked", "reject")
    kinds = {r["kind"] for r in simulate.structural_effects(awkward, simulate.change_set(spark, [("add", "d::alone", "a::1")])).collect()}
    assert {"connection_added", "region_newly_connected"} <= kinds
    assert simulate.rank_candidates(awkward, {"bad": changes, "good": simulate.change_set(spark, [("remove", "b::3", "b::4")])}).where("place = 1").first()["candidate"] == "good"


def test_history(spark):
    h = spark.createDataFrame([(1, 0.5, 9, 100), (2, 0.6, 9, 101), (3, 0.6, 9, 103)], "at int, score double, nodes int, edges int")
    assert [r["trend"] for r in history.score_trend(h).orderBy("at").collect()] == ["stable", "improving", "stable"]
    assert [r["converged"] for r in history.converged(h).orderBy("at").collect()] == [False, False, True]


# ---- the query language


def test_precedence_and_quotes():
    assert render(parse("a(x) OR b(y) AND c(z)")) == "(a('x') OR (b('y') AND c('z')))"
    assert render(parse('callers("x AND y")')) == "callers('x AND y')"
    assert render(parse("a(x) AND NOT b(y)")) == "(a('x') NOT b('y'))"
    assert render(parse("(a(x) OR b(y)) AND c(z, depth=2)")) == "((a('x') OR b('y')) AND c('z', depth=2))"
    assert render(parse("SELECT nodes WHERE layer=3 AND fan_in>=2")) != render(parse("SELECT nodes WHERE layer=3"))


@pytest.mark.parametrize("bad", ["", "a(", "SELECT", "a(x) AND", "a(x)) ", "a(x) b(y) c", "SELECT nodes IN other(x)", '"open', "((((", "%%%", "path(x)", "unknown(x)", "SELECT nothing"])
def test_bad_queries_are_errors(awkward, bad):
    with pytest.raises(QueryError):
        Engine(awkward).run(bad)


def test_queries(spark, awkward):
    e = Engine(awkward)
    assert ids(e.run("dependencies(a::1) AND dependents(b::4)")) == ["a::2", "a::3", "b::1", "b::2", "b::3"]
    assert ids(e.run('callees("a::3") NOT callees("a::2")')) == ["a::1", "b::1"]
    assert ids(e.run("NOT search(*::*)")) == ["d"]
    assert ids(e.run("path(a::1, a::3)", limit=2)) == ["a::1", "a::2"]
    assert ids(e.run("SELECT cycles")) == ["a::1 -> a::2 -> a::3 -> a::1"]
    assert ids(e.run("SELECT nodes WHERE file=b AND fan_in>=2")) == ["b::4"]
    batch = e.run_batch(["orphans", "nonsense(x)"])
    assert ids(batch["orphans"]) == ["d::alone"] and isinstance(batch["nonsense(x)"], QueryError)
    sem = spark.createDataFrame([("a", [], [], [], ["auth"], [], []), ("b", [], [], [("database_write", "t")], [], [], ["INSERT"])], "id string, actions array<struct<verb:string,object:string,action_type:string>>, guards array<struct<condition:string,raises:string>>, side_effects array<struct<effect_type:string,target:string>>, domain_tags array<string>, library_calls array<string>, sql_operations array<string>")
    s = Engine(awkward, semantics=sem)
    assert (ids(s.run("pure")), ids(s.run("risky")), ids(s.run("domain(auth)"))) == (["a"], ["b"], ["a"])


# ---- functions


def test_text_functions(spark):
    df = spark.createDataFrame([("_settle_order", "def f(): session.query(x); logger.info(1)")], "name string, body string")
    r = df.select(text.action_of("name").alias("a"), text.effects_of("body").alias("e"), text.domains_of(F.lit("auth/login")).alias("d")).first()
    assert (r["a"], sorted(r["e"]), r["d"][0]) == ("write", ["database_read", "logging"], "auth")
    paths = spark.createDataFrame([("lib/site-packages/x.py",), ("tests/a.py",), ("src/test_a.py",), ("src/a.py",)], "p string")
    assert [r[0] for r in paths.select(text.layer_of_path("p")).collect()] == [1, 4, 4, 3]
    quality = spark.createDataFrame([("",), ("a helper for things",), ("short",), ("computes the order total",)], "i string")
    assert [r[0] for r in quality.select(text.intent_quality("i")).collect()] == ["fail", "warn", "warn", "ok"]
    assert spark.range(1).select(module_of(F.lit("a/b"))).first()[0] == "a/b"


# ---- sources


def test_code_becomes_a_graph(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("function skipped() {}")
    (tmp_path / "app" / "data.py").write_text('def fetch():\n    """doc"""\n    return 1\n')
    (tmp_path / "app" / "trade.py").write_text("from app.data import fetch\nLIMIT = 3\nclass T:\n    def go(self):\n        return self.check() + fetch()\n    def check(self):\n        return getattr(self, 'x')()\n")
    (tmp_path / "app" / "bad.py").write_text("def broken(:\n")
    (tmp_path / "app" / "api.py").write_text("@app.route('/orders/<int:id>')\ndef orders(id):\n    db.execute('select 1 from orders')\n")
    (tmp_path / "app" / "List.tsx").write_text("import { x } from './x';\nexport function List() { return fetch(`/orders/${id}`); }\n")
    scanned = code.scan(spark, str(tmp_path), ["*.md"])
    rows = code.extract(scanned).cache()
    g = code.graph_of(scanned)
    assert {r["id"] for r in g.nodes.where("type <> 'module'").collect()} == {"app/data.py::fetch", "app/trade.py::T", "app/trade.py::T::go", "app/trade.py::T::check", "app/api.py::orders", "app/List.tsx::List"}
    assert {(r["source"], r["target"]) for r in g.edges.where("edge_type = 'call'").collect()} == {("app/trade.py::T::go", "app/trade.py::T::check"), ("app/trade.py::T::go", "app/data.py::fetch")}
    assert ids(rows.where("kind = 'error'")) == ["app/bad.py"]
    assert [r["name"] for r in rows.where("kind = 'global'").collect()] == ["LIMIT"]
    run = runtime.runtime_edges(scanned)
    assert {(r["source_node"], r["edge_type"], r["target"]) for r in run.collect()} == {("app/api.py::orders", "db_query", "orders"), ("app/List.tsx", "fetch", "/orders/${id}")}
    links = code.route_links(run.where("edge_type = 'fetch'"), code.routes(scanned)).collect()
    assert [(r["source_file"], r["target_file"], r["kind"]) for r in links] == [("app/List.tsx", "app/api.py", "normalised")]
    covered = code.covered_nodes(spark.createDataFrame([("/x/app/data.py", [3])], "file string, executed_lines array<int>"), g.nodes)
    assert ids(covered) == ["app/data.py::fetch"]


def test_runtime_edges_belong_to_the_function_around_them(spark):
    python = """
import os, asyncio
from json import loads
from pathlib import Path
os.environ["HOME"]
class Shop:
    async def buy(self, cursor):
        cursor.execute("UPDATE stock SET n = 0")
        requests.post("http://x/pay", json={})
        os.getenv("KEY")
        os.environ.get("TOKEN")
        channel.basic_publish(exchange="ex")
        tasks.delay("mail")
        work_queue.put("job")
        await asyncio.gather(a(), b())
        stub.call(1)
        ws.send("hi")
        bus.on("sold")
        d = {}.get("no")
def top():
    db.query(text)
"""
    files_ = spark.createDataFrame([("s.py", python), ("bad.py", "def"), ("n.txt", "fetch('/a')"), ("x.js", "axios.get('/b'); fetch(`/a`)"), ("e.py", None)], "path string, content string")
    got = {(r["source_node"].removeprefix("s.py::"), r["edge_type"], r["target"]) for r in runtime.runtime_edges(files_).collect()}
    buy = {("db_query", "stock"), ("http_call", "http://x/pay"), ("env_var", "KEY"), ("env_var", "TOKEN"), ("mq_publish", "ex"), ("event_produce", "ex"), ("worker", "mail"), ("queue_task", "mail"), ("queue", "job"), ("queue_task", "job"), ("http_call", "job"), ("async_workflow", "gather"), ("rpc_call", "<rpc>"), ("websocket_event", "hi"), ("event_consume", "sold"), ("http_call", "no")}
    assert got == {("Shop::buy", *x) for x in buy} | {("<module>", "env_var", "HOME"), ("top", "db_query", "<dynamic>"), ("x.js", "axios", "/b"), ("x.js", "fetch", "/a")}


def test_routes_with_parameters_fit_values(spark):
    calls = spark.createDataFrame([("a.ts", "/orders/5"), ("b.ts", "/orders/list"), ("c.ts", "http://h/users/7/items/9"), ("d.ts", "/none/1"), ("e.ts", "/orders/${id}")], "source_file string, target string")
    declared = spark.createDataFrame([("api.py", "/orders/<int:id>"), ("api.py", "/orders/list"), ("u.py", "/users/{u}/items/{i}"), ("w.py", "/{any}/x/y")], "file string, route string")
    got = {(r["source_file"], r["target_file"], r["route"], r["kind"]) for r in code.route_links(calls, declared).collect()}
    assert got == {("a.ts", "api.py", "/orders/<int:id>", "parameter"), ("b.ts", "api.py", "/orders/list", "exact"), ("c.ts", "u.py", "/users/{u}/items/{i}", "parameter"), ("e.ts", "api.py", "/orders/<int:id>", "normalised")}


def test_graph_files_and_snapshots(spark, awkward, tmp_path):
    (tmp_path / "n.json").write_text('{"nodes": [{"id": "a", "file": "f", "type": "function", "line": 1, "body_hash": "h"}]}')
    (tmp_path / "e.json").write_text('{"edges": [{"source": "a", "target": "a", "edge_type": "call", "confidence": "static"}]}')
    g = files.read_graph(spark, str(tmp_path / "n.json"), str(tmp_path / "e.json"))
    assert g.nodes.count() == g.edges.count() == 1
    formats.save_snapshot(awkward, str(tmp_path / "s"), "one")
    back = formats.load_snapshot(spark, str(tmp_path / "s"), "one")
    assert back.edges.exceptAll(awkward.edges).count() == 0 and ids(formats.snapshots(spark, str(tmp_path / "s")), "snapshot") == ["one"]
    assert formats.mermaid(awkward).first()["diagram"].startswith("graph TD\n")


def test_rollback_archive_and_reports(spark, awkward, tmp_path):
    path = str(tmp_path / "s")
    formats.save_snapshot(awkward, path, "one")
    formats.save_snapshot(awkward.with_edges(awkward.edges.limit(1)), path, "two")
    assert formats.rollback(spark, path, "one", "three").edges.count() == awkward.edges.count()
    extra = awkward.annotations.unionByName(spark.createDataFrame([("gone", 3, "")], "id string, layer int, arch_layer string"))
    kept = formats.archive(extra, awkward, str(tmp_path / "a"))
    assert kept.where("id = 'gone'").count() == 0
    back = Graph(awkward.nodes.unionByName(awkward.nodes.limit(1).withColumn("id", F.lit("gone"))), awkward.edges)
    assert formats.restore(kept, back, str(tmp_path / "a")).where("id = 'gone'").count() == 1
    assert '"nodes"' in formats.drawing(awkward, 3).first()["value"]
    assert "<td>a::3</td>" in formats.report(awkward).first()["value"]


def test_declared_systems(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"subsystems": [{"name": "x", "components": [{"name": "c", "module": "a", "functions": ["a::1"]}]}], "edges": [{"source": "a", "target": "b"}], "constraints": []}')
    (tmp_path / "r.json").write_text('{"rules": [{"id": "f", "type": "forbidden_call", "source": "a*", "target_layer": 2}]}')
    system = files.read_system(spark, str(tmp_path / "s.json"))
    assert {k: v.count() for k, v in system.items()} == {"modules": 1, "functions": 1, "links": 1, "constraints": 0}
    assert files.read_rules(spark, str(tmp_path / "r.json")).first()["target_layer"] == 2


def test_semantic_rules_and_flows(spark, awkward):
    sources = spark.createDataFrame([("a::save_order", "a", "db.execute('insert into t'); open('x')"), ("a::send", "a", "requests.get(u)")], "id string, file string, body string")
    sem = semantics.describe(sources)
    assert {(r["rule"], r["id"]) for r in semantics.rule_findings(sem).collect()} == {("db-write-no-guard", "a::save_order"), ("file-write-no-logging", "a::save_order"), ("network-no-error-handling", "a::send")}
    flows = {(r["target"], r["edge_type"]) for r in semantics.context_flows(awkward, sem).collect()}
    assert {("a::requests.get", "side_effect"), ("a::open(", "side_effect")} <= flows
    bare = sem.withColumn("side_effects", F.transform("side_effects", lambda e: e.withField("target", F.lit(""))))
    assert ("a::network_call", "side_effect") in {(r["target"], r["edge_type"]) for r in semantics.context_flows(awkward, bare).collect()}
    assert semantics.behaviour_changes(sem, sem).count() == 0
    types = spark.createDataFrame([("t", "OrderDTO")], "id string, name string")
    models = spark.createDataFrame([("m", "OrderModel"), ("n", "Other")], "id string, name string")
    assert [r["target"] for r in semantics.contract_links(types, models).collect()] == ["m"]
    out = spark.createDataFrame([("web", "http://x/api/orders")], "repo string, route string")
    api = spark.createDataFrame([("shop", "/api/orders"), ("web", "/api/orders")], "repo string, route string")
    assert [tuple(r) for r in semantics.repository_links(out, api).collect()] == [("web", "shop", "http://x/api/orders")]


def test_policies_by_handler(spark, awkward):
    subs = awkward.nodes.select("id", F.col("file").alias("subsystem"))
    found = governance.evaluate(awkward, subs, [{"id": "only", "kind": "allowed_subsystem_deps", "target": "x->y"}, {"id": "gate", "kind": "score_gate", "threshold": 1.0}])
    assert {(r["policy_id"], r["subject"]) for r in found.collect()} == {("only", "a->b"), ("gate", "score")}
    with pytest.raises(ValueError):
        governance.evaluate(awkward, subs, [{"id": "x", "kind": "none"}])


# ---- streams


def test_watcher_sees_new_rewritten_and_removed_files(spark, tmp_path):
    src, state = tmp_path / "src", str(tmp_path / "state")
    src.mkdir()
    seen = []

    def update(changes, number, depth):
        seen.append(({(r["path"].rsplit("/", 1)[-1], r["change"]) for r in changes.collect()}, depth))

    def tick():
        events.watch_files(spark, str(src), state, update, once=True).awaitTermination()

    for name in "abc":
        (src / name).write_text("1")
    tick()
    (src / "a").write_text("2")
    (src / "b").unlink()
    (src / "d").write_text("1")
    tick()
    (src / "c").write_text("1")  # touched only
    tick()
    old = (src / "c").stat()
    (src / "c").write_text("2")  # of the same length, and the time put back: not opened, so not seen
    os.utime(src / "c", ns=(old.st_atime_ns, old.st_mtime_ns))
    (src / "e").write_text("1")
    tick()
    assert seen == [
        ({("a", "added"), ("b", "added"), ("c", "added")}, "affected"), ({("a", "modified"), ("b", "removed"), ("d", "added")}, "affected"), ({("e", "added")}, "local"),
    ]
    events.BY_NAME, named = 0, events.BY_NAME
    try:
        (src / "c").write_text("33")
        tick()
    finally:
        events.BY_NAME = named
    assert seen[-1] == ({("c", "modified")}, "local")


def test_upsert_keeps_the_newest(spark, tmp_path):
    write, state = events.upsert(str(tmp_path / "state"), ["path"], "modified"), KeyedState(spark, str(tmp_path / "state"), ["path"], "modified")
    batch = lambda *rows: spark.createDataFrame(rows, "path string, modified long")
    write(batch(("a", 1), ("b", 1)), 0)
    write(batch(("a", 2), ("a", 3)), 1)
    write(batch(("a", 2), ("a", 3)), 1)  # repeated after a failure
    assert {(r["path"], r["modified"]) for r in state.read().collect()} == {("a", 3), ("b", 1)}
    assert {(r["path"], r["modified"]) for r in state.read(1).collect()} == {("a", 1), ("b", 1)} and state.read(0) is None


def test_a_state_writes_what_changed_and_lets_old_folders_go(spark, tmp_path):
    path = str(tmp_path / "state")
    state = KeyedState(spark, path, ["k"], "at", removed="gone", buckets=4)
    rows = lambda ids, at, gone=False: spark.createDataFrame([(i, at, "x" * 50, gone) for i in ids], "k long, at long, v string, gone boolean")
    size = lambda: {f: f.stat().st_size for f in (tmp_path / "state" / "data").rglob("*.parquet")}
    state.write(rows(range(4000), 0), 0)
    want, first = dict.fromkeys(range(4000), 0), sum(size().values())
    for n in range(1, 24):
        before = size()
        state.write(rows([n, n + 1, 10_000 + n], n), n) if n % 5 else state.write(rows([n, 2000 + n], n, True), n)
        if n % 5:
            want |= dict.fromkeys((n, n + 1, 10_000 + n), n)
        else:
            want.pop(n, None)
            want.pop(2000 + n, None)
        fresh = [s for f, s in size().items() if f not in before and "merged" not in str(f)]
        assert sum(fresh) < first / 3  # a batch of a few rows writes a few rows
    assert {r["k"]: r["at"] for r in state.read().collect()} == want
    assert len(state.numbers()) == 2 and len(list((tmp_path / "state" / "data").iterdir())) < 24
    assert any("merged" in str(f) for f in size())


def test_the_last_change_of_a_burst_is_reported(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "old"), ("a", "2024-01-01 00:00:00.4", "new"), ("b", "2024-01-01 00:00:00.5", "x"), ("a", "2024-01-01 00:00:09", "later"), ("z", "2024-01-01 01:00:00", "end")]
    table = spark.createDataFrame(rows, "path string, modified string, content_hash string").withColumn("modified", F.col("modified").cast("timestamp"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = events.debounced(stream).writeStream.format("memory").queryName("d").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["path"], r["content_hash"]) for r in spark.table("d").collect()) == [("a", "later"), ("a", "new"), ("b", "x")]


def test_windows_on_a_stream_equal_those_on_a_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    table.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").exceptAll(events.tumbling(table)).count() == 0


# ---- the catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), columns)


def test_a_slice_follows_binding_edges_within_its_bounds(spark):
    pairs = [("m::r", "m::a"), ("m::a", "m::b"), ("m::r", "m::s", "side_effect"), ("m::s", "m::t"), ("x::1", "m::r", "event"), ("x::1", "x::2"), ("x::2", "x::3"), ("m::b", "y::1", "dataflow")]
    g = make(spark, pairs)
    rows = lambda **more: {(r["id"], r["depth"], r["boundary"], r["external_edges"]) for r in traverse.subsystem_slice(g, "m::r", **more).collect()}
    # x::2 has no neighbour of the root's module, s is only reached by an effect
    assert rows() == {("m::r", 0, True, 1), ("m::a", 1, False, 0), ("x::1", 1, True, 1), ("m::b", 2, True, 1)}
    assert rows(density=0.6) == {("m::r", 0, True, 1), ("m::a", 1, True, 1), ("x::1", 1, True, 1)}
    assert {r[0] for r in rows(most=2)} == {"m::r", "m::a"} and {r[0] for r in rows(hops=0)} == {"m::r"}
    parts = spark.createDataFrame([(i, i[0]) for i in ("m::r", "m::a", "m::b", "m::s", "m::t", "x::1", "x::2", "x::3", "y::1")], "id string, partition_id string")
    assert {r[0] for r in rows(parts=parts, density=0.0)} == {"m::r", "m::a", "m::b"}
    seen = spark.createDataFrame([("m::a", "x::3"), ("x::3", "x::2"), ("m::a", "nowhere")], "source string, target string")
    assert {r[0] for r in rows(parts=parts, runtime=seen, density=0.0, hops=4)} == {"m::r", "m::a", "m::b", "x::3"}
    assert traverse.subsystem_slice(g, "unknown").count() == 0


def test_strong_components_are_the_same_both_ways(spark, monkeypatch):
    rng = random.Random(12)
    for size in (12, 60):
        g = make(spark, [(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}") for _ in range(size * 5 // 3)])
        both = []
        for most in (100_000, 0):
            monkeypatch.setattr(components, "SMALL_ARCS", most)
            both.append({tuple(r) for r in components.strong_components(g.edges).collect()})
        assert both[0] == both[1] and (both[0] or size == 12)
    assert components.strong_components(make(spark, [], extra=["a"]).edges).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_weak_components_are_dealt_to_tasks_and_need_no_colours(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL_ARCS", 5)
    monkeypatch.setattr(components, "_least_before", lambda steps: pytest.fail("gave colours"))
    rings = [(f"r{k}::{i}", f"r{k}::{(i + 1) % 4}") for k in range(20) for i in range(4)] + [(f"r{k}::0", f"tail{k}") for k in range(20)]
    got = {tuple(r) for r in components.strong_components(make(spark, rings).edges).collect()}
    assert got == {(f"r{k}::{i}", f"r{k}::0") for k in range(20) for i in range(4)}


def test_tables_that_grow_with_the_graph_are_not_sent_to_all_tasks(spark, monkeypatch):
    g = make(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    g = Graph(graph.durable(g.nodes), graph.durable(g.edges))
    assert "Broadcast" not in plan_of(components.cycles(g)) and [r["evidence"] for r in components.cycles(g).collect()] == [2]
    assert "Broadcast" not in plan_of(components.topological_levels(g.edges))
    assert "Broadcast" not in plan_of(catalog.PARTNERS(spark, SF).edges)


def test_sides_of_joins_go_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_ROWS", 1)
    small = graph.durable(make(spark, [("a", "b"), ("b", "c")]).edges)
    assert "Broadcast" in plan_of(small.join(graph.by_size(small.select("source"), 1), "source"))
    assert "Broadcast" not in plan_of(small.join(graph.by_size(small.select("source"), 2), "source"))
    edges = make(spark, [("top", "a"), ("a", "b"), ("b", "a"), ("b", "low"), ("low", "end"), ("top", "end")]).edges
    assert {r["id"]: r["level"] for r in components.topological_levels(edges).collect()} == {"end": 0, "low": 1, "a": 2, "b": 2, "top": 3}


def test_rows_of_snapshots_are_dealt_by_the_size_of_the_input(spark, monkeypatch):
    from graphloom.sources import views

    run = lambda: [sorted(map(str, catalog.QUERIES[q](spark, SF).collect())) for q in ("snapshot_diff_multigraph", "snapshot_diff_edges")]
    want, lines = run(), views.table(spark, SF, "lineitem")
    size = os.path.getsize(f"{SF}/lineitem.parquet")
    assert graph.shares(lines) == 0
    monkeypatch.setattr(graph, "SHARE", size // 8)
    n = graph.shares(lines, lines.union(lines))
    assert n in (8, 9)
    old, new = catalog.snapshot(spark, SF, catalog.CUT_A), catalog.snapshot(spark, SF, catalog.CUT_B)
    assert diff.diff_multigraph(old, new).rdd.getNumPartitions() == graph.shares(old.edges) > n
    assert all(r in new.edges._jdf.queryExecution().optimizedPlan().toString() for r in (f"RepartitionByExpression [l_orderkey", f", {n}"))
    assert run() == want


def test_trade_shuffles_line_items_once_and_deals_them_by_the_size_of_the_input(spark, monkeypatch):
    run = lambda: [sorted(map(str, catalog.QUERIES[q](spark, SF).collect())) for q in ("neighbourhood", "module_coupling")]
    want = run()
    monkeypatch.setattr(graph, "SHARE", os.path.getsize(f"{SF}/lineitem.parquet") // 8)
    plan = traverse.neighbourhood(catalog.TRADE(spark, SF), [catalog.NATION], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1  # both directions come from one pass
    assert len(re.findall(r"RepartitionByExpression \[l_orderkey#\d+L\], [89]\b", plan)) == 2, plan
    assert run() == want


def test_domains_put_a_text_in_lower_case_once(spark):
    assert all(w.isalpha() and w == w.lower() for words in text.DOMAINS.values() for w in words)
    assert plan_of(catalog.QUERIES["document_domains"](spark, SF)).count("lower(") == 1
    words = [w for ws in text.DOMAINS.values() for w in ws]
    df = spark.createDataFrame([(w.upper(),) for w in words] + [(None,), ("",)], "text string")
    got = [r["d"] for r in df.select(text.domains_of("text").alias("d")).collect()]
    assert got == [[k for k, ws in text.DOMAINS.items() if any(x in w for x in ws)] for w in words] + [[], []]


def test_names_by_file_are_not_sent_to_all_tasks(spark):
    assert "Broadcast" not in plan_of(catalog.by_file(catalog.PARTNERS)(spark, SF).edges)


@pytest.mark.parametrize("rows", [200_000_000, 40])
def test_reach_within_three_steps_by_classes_and_slices(spark, monkeypatch, rows):
    monkeypatch.setattr(metrics, "SLICE_ROWS", rows)
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)] + [(f"leaf{i}", t) for i in range(30) for t in ("n1", "n2")] + [("n1", "leaf3"), ("self", "self"), ("end", "n5")]
    g = make(spark, pairs, extra=["alone"])
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    step = lambda nodes: {t for n in nodes for t in ahead.get(n, ())}
    want = {n: len((step({n}) | step(step({n})) | step(step(step({n})))) - {n}) for n in {x for p in pairs for x in p} | {"alone"}}
    assert {r["id"]: r["reach"] for r in metrics.reach3(g).collect()} == want


def test_reach_makes_classes_of_nodes_between_only(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SLICE_ROWS", 40)
    held, keep = [], metrics.durable
    monkeypatch.setattr(metrics, "durable", lambda df: held.append(keep(df)) or held[-1])
    pairs = [(f"top{i}", t) for i in range(60) for t in (f"leaf{i}", "mid")] + [("mid", "end")]
    got = {r["id"]: r["reach"] for r in metrics.reach3(make(spark, pairs)).collect()}
    assert got["top7"] == 3 and got["mid"] == 1 and got["leaf7"] == 0
    assert [df.count() for df in held if df.columns == ["id", "class"]] == [1]


def test_calls_between_subsystems_are_counted_once_for_all_policies(spark, monkeypatch):
    made, count = [], governance.subsystem_calls
    monkeypatch.setattr(governance, "subsystem_calls", lambda *a: made.append(1) or count(*a))
    g = make(spark, [("a::1", "b::1"), ("b::1", "a::1"), ("a::1", "a::2")])
    rules = [{"id": "f", "kind": "forbidden_subsystem_dep", "target": "a->b"}, {"id": "o", "kind": "allowed_subsystem_deps", "target": "a->b"}, {"id": "c", "kind": "forbidden_subsystem_cycle"}, {"id": "l", "kind": "coupling_limit", "threshold": 0.5}]
    rows = {tuple(r) for r in governance.evaluate(g, g.nodes.select("id", F.col("file").alias("subsystem")), rules).collect()}
    assert rows == {("f", "a->b", "1"), ("o", "b->a", "1"), ("c", "a", "a -> b"), ("l", "coupling", "0.666667")} and made == [1]


def test_no_file_is_collected_into_a_row_to_compare_it(spark):
    old, new = make(spark, [("a::1", "c::1"), ("b::1", "c::1")]), make(spark, [("a::1", "c::1"), ("b::2", "c::1")])
    merged = diff.apply_delta(old, new)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan(merged.nodes) and sorted(ids(merged.nodes)) == ["a::1", "b::2", "c::1"]
    assert {(r["source"], r["target"]) for r in merged.edges.collect()} == {("a::1", "c::1"), ("b::2", "c::1")}
    found = diff.snapshot_diff({"nodes": old.nodes}, {"nodes": new.nodes})
    assert plan(found).count("Aggregate") <= 2
    assert {tuple(r) for r in found.collect()} == {("nodes", 1, 1)}


def test_a_lock_knows_folders_forbidden_and_undeclared_links(spark):
    g = make(spark, [("app/a.py::f", "lib/x.py::g"), ("app/b.py::f", "lib/x.py::g"), ("lib/x.py::g", "app/a.py::f"), ("new/z.py::f", "app/a.py::f")])
    modules = spark.createDataFrame([("app", "app/a.py"), ("app", "app/b.py"), ("lib", "lib/x.py"), ("zoo", "lib/x.py")], "subsystem string, module string")
    links = spark.createDataFrame([("lib", "app")], "source string, target string")
    denied = spark.createDataFrame([("lib", "app", "forbidden"), ("app", "lib", "required")], "source string, target string, type string")
    rows = {tuple(r) for r in policy.lock_report(g, modules, links, denied, strict=True).collect()}
    assert rows == {
        ("undeclared_module", "error", "new/z.py", None, None), ("forbidden_dependency", "error", "lib/x.py", "lib", "app/a.py"), ("boundary_violation", "warning", "app/a.py", "app", "lib"),
    }
    fewer = modules.where("module <> 'app/b.py'")
    assert not [r for r in policy.lock_report(g, fewer, links, denied).collect() if r["module"] == "app/b.py"]
