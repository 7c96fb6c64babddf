"""Named policies over a graph and its subsystems, by a table of handlers that can be added to.

A policy is a mapping with id, kind and, by kind, threshold or target. Every handler returns a table of
(subject, detail) violations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, durable

from .components import strong_components
from .metrics import god_modules
from .score import architecture_score

Handler = Callable[[Graph, DataFrame, dict], DataFrame]
HANDLERS: dict[str, Handler] = {}


def handler(kind: str):
    """Registers a handler of (graph, subsystems(id, subsystem), policy)."""

    def register(run: Handler) -> Handler:
        HANDLERS[kind] = run
        return run

    return register


def _found(df: DataFrame, subject, detail) -> DataFrame:
    return df.select(subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def subsystem_calls(graph: Graph, subsystems: DataFrame) -> DataFrame:
    """(a, b, n): edge records between different subsystems."""
    s, t = subsystems.select(F.col("id").alias("source"), F.col("subsystem").alias("a")), subsystems.select(F.col("id").alias("target"), F.col("subsystem").alias("b"))
    return graph.edges.join(s, "source").join(t, "target").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


#: Kinds of policies that look at the calls between subsystems, and where :func:`evaluate` puts them.
BETWEEN, CALLS = ("coupling_limit", "layer_isolation", "forbidden_subsystem_dep", "allowed_subsystem_deps", "forbidden_subsystem_cycle"), "__calls"


def _calls(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    return policy[CALLS] if CALLS in policy else subsystem_calls(graph, subsystems)


def pairs_of(target: str) -> list[tuple[str, str]]:
    """``a->b;c->d`` as pairs."""
    return [(a.strip(), b.strip()) for a, sep, b in (x.partition("->") for x in (target or "").split(";")) if sep]


@handler("no_large_modules")
def no_large_modules(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    return _found(god_modules(graph, int(policy.get("threshold") or 50) + 1), F.col("file"), F.col("n"))


@handler("max_subsystem_size")
def max_subsystem_size(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    sizes = subsystems.groupBy("subsystem").agg(F.count("*").alias("n"))
    return _found(sizes.where(F.col("n") > int(policy.get("threshold") or 300)), F.col("subsystem"), F.col("n"))


@handler("score_gate")
def score_gate(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    return _found(architecture_score(graph).where(F.col("score") < float(policy.get("threshold") or 0.7)), F.lit("score"), F.col("score"))


@handler("coupling_limit")
def coupling_limit(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    across = _calls(graph, subsystems, policy).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    share = across.crossJoin(graph.edges.agg(F.greatest(F.count("*"), F.lit(1)).alias("m"))).select(F.round(F.col("n") / F.col("m"), 6).alias("share"))
    return _found(share.where(F.col("share") > float(policy.get("threshold") or 0.4)), F.lit("coupling"), F.col("share"))


@handler("frontend_backend_boundary")
def frontend_backend_boundary(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    e = graph.ends("file").where(F.lower("s_file").rlike(r"\.(js|jsx|ts|tsx)$") & F.lower("t_file").endswith(".py") & F.col("edge_type").isin("call", "dataflow", "control_flow"))
    return _found(e.select("s_file", "t_file").distinct(), F.col("s_file"), F.col("t_file"))


@handler("no_apply_without_plan")
def no_apply_without_plan(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    bad = policy.get("operation") == "apply" and not policy.get("plan_exists", False)
    return _found(graph.nodes.sparkSession.range(int(bad)), F.lit("apply"), F.lit("no plan"))


@handler("layer_isolation")
def layer_isolation(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    return forbidden_subsystem_dep(graph, subsystems, policy)


@handler("forbidden_subsystem_dep")
def forbidden_subsystem_dep(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    named = F.lit(False)
    for a, b in pairs_of(policy.get("target")):
        named = named | ((F.col("a") == a) & (F.col("b") == b))
    return _found(_calls(graph, subsystems, policy).where(named), F.concat_ws("->", "a", "b"), F.col("n"))


@handler("allowed_subsystem_deps")
def allowed_subsystem_deps(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    named = F.lit(False)
    for a, b in pairs_of(policy.get("target")):
        named = named | ((F.col("a") == a) & (F.col("b") == b))
    return _found(_calls(graph, subsystems, policy).where(~named), F.concat_ws("->", "a", "b"), F.col("n"))


@handler("forbidden_subsystem_cycle")
def forbidden_subsystem_cycle(graph: Graph, subsystems: DataFrame, policy: dict) -> DataFrame:
    calls = _calls(graph, subsystems, policy).select(F.col("a").alias("source"), F.col("b").alias("target"))
    members = strong_components(calls).groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("id")), " -> ").alias("m"))
    return _found(members, F.col("component"), F.col("m"))


def evaluate(graph: Graph, subsystems: DataFrame, policies: list[dict]) -> DataFrame:
    """(policy_id, subject, detail) of the violations of all policies; a kind without a handler is an error.
    Calls between subsystems are counted once for all of them."""
    out, calls = None, None
    for p in policies:
        if p["kind"] not in HANDLERS:
            raise ValueError(f"no handler for policies of kind {p['kind']}")
        if p["kind"] in BETWEEN:
            calls = durable(subsystem_calls(graph, subsystems)) if calls is None else calls
            p = p | {CALLS: calls}
        rows = HANDLERS[p["kind"]](graph, subsystems, p).select(F.lit(p["id"]).alias("policy_id"), "subject", "detail")
        out = rows if out is None else out.unionByName(rows)
    return out


def policy_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(policy_id, subject, change) between two evaluations."""
    from .diff import diff

    return diff(before, after, ["policy_id", "subject"], ["detail"]).where("change <> 'unchanged'")


def intent_drift(violations: DataFrame, checked: int, edges: int) -> DataFrame:
    """One row: 0.7 of violations over checked pairs and 0.3 of violations over edges, at most 1."""
    n = F.count("*")
    return violations.agg(F.round(F.least(F.lit(1.0), 0.7 * n / max(1, checked) + 0.3 * n / max(1, edges)), 6).alias("drift_score"))
