"""Candidates evaluated together against each alone, objectives and fronts against plain versions."""

import random
from collections import Counter

import pytest

from graphloom.graph import Graph
from graphloom.operators import search

FILES = {f"n{i}": f"f{i % 3}" for i in range(9)}
LAYERS = {f"n{i}": i % 4 for i in range(9)}


def graph(spark, edges):
    n = spark.createDataFrame([(i, FILES[i], "function", 1, "h") for i in FILES], "id string, file string, type string, line int, body_hash string")
    e = spark.createDataFrame([(a, b, "call", "static") for a, b in edges], "source string, target string, edge_type string, confidence string")
    notes = spark.createDataFrame([(i, LAYERS[i], "") for i in LAYERS], "id string, layer int, arch_layer string")
    return Graph(n, e, notes)


def way(edges, a, b):
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        for s, t in edges:
            if s == x and t not in seen:
                seen.add(t)
                todo.append(t)
    return b in seen


def alone(edges, changes):
    """One candidate, by writing its graph out."""
    removed, added = {c[1:] for c in changes if c[0] == "remove"}, sorted({c[1:] for c in changes if c[0] == "add"})
    after = [e for e in edges if e not in removed] + added
    outside = lambda es: sum(FILES[a] != FILES[b] for a, b in es) / len(es) if es else 0.0
    fan = lambda es: max(Counter(a for a, _ in es).values(), default=0)
    gone = {e for e in removed if e in edges} - set(added)
    return {
        "edges": len(after), "coupling": round(outside(after), 6), "coupling_before": round(outside(edges), 6), "violations_added": sum(LAYERS[a] < LAYERS[b] for a, b in added),
        "max_fan_out": fan(after), "max_fan_out_before": fan(edges), "cycles_closed": sum(way(after, b, a) for a, b in added),
        "cycles_opened": sum(way(edges, b, a) and not (way(after, b, a) and way(after, a, b)) for a, b in gone),
    }


def worth(m, risk=0.05):
    if m["cycles_closed"]:
        return -1.0
    clip = lambda x: max(0.0, min(1.0, x))
    coupling = 0.25 * clip(0.5 + 5 * (m["coupling_before"] - m["coupling"])) if m["coupling"] > 0 else 0.125
    return min(1.0, coupling + 0.15 * clip((m["max_fan_out_before"] - m["max_fan_out"]) / 5) + 0.1 * (m["violations_added"] == 0) + risk + 0.1 * m["cycles_opened"])


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(3)
    return [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(16)] + [("n0", "n1"), ("n0", "n1"), ("n1", "n2"), ("n2", "n0")]


def test_candidates_together_are_as_each_alone(spark, edges):
    rng = random.Random(4)
    pick = lambda: rng.choice([("remove", *rng.choice(edges)), ("add", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}"), ("remove", "n7", "n8")])
    candidates = {f"c{k}": [pick() for _ in range(rng.randrange(1, 5))] for k in range(25)} | {"cut": [("remove", "n2", "n0")], "swap": [("remove", "n0", "n1"), ("add", "n0", "n1")]}
    rows = search.scored(search.evaluate(graph(spark, edges), search.candidate_table(spark, candidates))).collect()
    assert len(rows) == len(candidates)
    for r in rows:
        want = alone(edges, candidates[r["candidate"]])
        assert {k: r[k] for k in want} == want, (r["candidate"], candidates[r["candidate"]])
        assert r["safe"] == (want["cycles_closed"] == 0) and r["score"] == pytest.approx(worth(want), abs=2e-6)


def test_search_keeps_the_best_sets_of_moves(spark, edges):
    moves = {f"cut {a} {b}": [("remove", a, b)] for a, b in sorted(set(edges))[:6]} | {"add n3 n8": [("add", "n3", "n8")], "add n8 n4": [("add", "n8", "n4")]}
    got = [(r["round"], r["place"], r["candidate"], r["score"]) for r in search.search(graph(spark, edges), search.candidate_table(spark, moves), 2, 3).orderBy("round", "place").collect()]
    beam, want = [()], []
    for number in (1, 2, 3):
        sets = {tuple(sorted({*b, m})) for b in beam for m in moves if m not in b}
        rated = sorted((-round(worth(x), 6), " + ".join(s), s) for s in sets if not (x := alone(edges, [c for m in s for c in moves[m]]))["cycles_closed"] and not x["violations_added"])[:2]
        want += [(number, k + 1, name, -score) for k, (score, name, _) in enumerate(rated)]
        beam = [s for *_, s in rated]
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_objectives(spark):
    rows = [("a", 0.9, 0.2, 1, 10, 1), ("b", None, None, None, None, None), ("c", 2.0, 0.9, 9, 80, 0)]
    df = spark.createDataFrame(rows, "candidate string, predicted_score double, predicted_coupling double, predicted_cycles int, predicted_max_fan_out int, predicted_god_modules int")
    base = spark.createDataFrame([(0.5, 0.4, 4)], "score double, coupling double, cycles int")
    got = {r["candidate"]: tuple(r[k] for k in (*search.OBJECTIVES, "objective_score")) for r in search.objectives(df, base).collect()}
    assert got["a"] == pytest.approx((0.9, 0.5, 0.75, 0.7, 0.4 * 0.9 + 0.3 * 0.5 + 0.2 * 0.75 + 0.1 * 0.7))
    assert got["b"] == pytest.approx((0.5, 0.0, 0.0, 0.7, 0.27)) and got["c"][:4] == (1.0, 0.0, 0.0, 0.0)
    none = spark.createDataFrame([(0.0, 0.0, 0)], "score double, coupling double, cycles int")
    assert {r["candidate"]: r["coupling_reduction"] for r in search.objectives(df, none).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    effects = spark.createDataFrame([("cycle_break", 0.8), ("cycle_break", 0.4), ("module_split", -1.0), ("unknown", 1.0)], "strategy string, effectiveness double")
    w = search.learnt_weights(effects)
    assert sum(w.values()) == pytest.approx(1) and w["cycle_reduction"] == pytest.approx(0.26 / 1.06) and w["modularity"] == pytest.approx(0.4 / 1.06)


def test_fronts(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    rng = random.Random(5)
    rows = [(k, *(rng.randrange(12) / 10 for _ in range(3))) for k in range(250)] + [(1000, None, 1.1, 1.1), (1001, 1.1, None, 1.1), (1002, 1.1, None, 1.1)]
    df = spark.createDataFrame(rows, "k long, x double, y double, z double")
    points = {k: tuple(v or 0 for v in p) for k, *p in rows}
    want = sorted(k for k, p in points.items() if not any(q != p and all(a >= b for a, b in zip(q, p, strict=True)) for q in points.values()))
    assert sorted(r["k"] for r in search.non_dominated(df, ("x", "y", "z"), 5).collect()) == want
    assert search.non_dominated(df.limit(0), ("x", "y")).count() == 0
