"""Search for changes of an architecture: many candidates in one plan, objectives, and the best of them.

A candidate is a set of changes (candidate, change, source, target), add or remove. All candidates are
evaluated together from their difference to the graph, in tables keyed by candidate: what a candidate
adds and removes changes counts and degrees, and the ways that close or open cycles are followed for all
at once over the edges that are common to all and those of each. The graph is never copied per candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, by_size, durable

from .traverse import arcs

CANDIDATES = "candidate string, change string, source string, target string"


def candidate_table(spark: SparkSession, candidates: dict[str, list[tuple[str, str, str]]]) -> DataFrame:
    return spark.createDataFrame([(name, *change) for name, changes in candidates.items() for change in changes], CANDIDATES)


def _counted(graph: Graph) -> DataFrame:
    """(source, target, n, inside, upward): pairs with their records, whether they stay in a file, and
    whether they go to a higher layer."""
    e = graph.ends("file", "layer")
    inside, upward = F.coalesce(F.col("s_file") == F.col("t_file"), F.lit(False)), F.coalesce(F.col("s_layer") < F.col("t_layer"), F.lit(False))
    return e.groupBy("source", "target").agg(F.count("*").alias("n"), F.first(inside).alias("inside"), F.first(upward).alias("upward"))


def closes(steps: DataFrame, changes: DataFrame, questions: DataFrame) -> DataFrame:
    """(candidate, source, target) of the questions for which the graph with the changes of the
    candidate has a way from source to target. All ways are followed together, an arc at a time."""
    removed = changes.where("change = 'remove'").select("candidate", F.col("source").alias("at"), F.col("target").alias("to"))
    added = changes.where("change = 'add'").select("candidate", F.col("source").alias("at"), F.col("target").alias("to")).distinct()
    asked = durable(questions.select("candidate", "source", "target").distinct())
    frontier = durable(asked.select("candidate", F.col("source").alias("origin"), F.col("source").alias("node")).distinct())
    changed, ends, last = changes.count(), asked.count(), frontier.count()
    removed, added = by_size(removed, changed), by_size(added, changed)
    asked = by_size(asked.select("candidate", F.col("source").alias("origin"), F.col("target").alias("node")), ends)
    seen, known, found = frontier, last, None
    while True:
        frontier = by_size(frontier, last)
        common = frontier.join(steps, F.col("node") == F.col("at")).select("candidate", "origin", "at", "to").join(removed, ["candidate", "at", "to"], "left_anti")
        own = frontier.withColumnRenamed("node", "at").join(added, ["candidate", "at"]).select("candidate", "origin", "at", "to")
        new = common.unionByName(own).select("candidate", "origin", F.col("to").alias("node")).distinct()
        hit = new.join(asked, ["candidate", "origin", "node"], "left_semi")
        found = hit if found is None else found.unionByName(hit)
        frontier = durable(new.join(by_size(seen, known), ["candidate", "origin", "node"], "left_anti"))
        last = frontier.count()
        if not last:
            return found.select("candidate", F.col("origin").alias("source"), F.col("node").alias("target")).distinct()
        seen, known, found = durable(seen.unionByName(frontier)), known + last, durable(found.distinct())


def evaluate(graph: Graph, candidates: DataFrame) -> DataFrame:
    """(candidate, edges, coupling, coupling_before, violations_added, max_fan_out, max_fan_out_before,
    cycles_closed, cycles_opened) of each candidate. Coupling is the share of edge records between files.
    An added edge closes a cycle if its target reaches its source afterwards, a removed one opens a cycle
    if its ends reached each other before and do not afterwards. An added pair is one record more, a
    removed one loses all of its records; what is removed and added at once is added."""
    changes = durable(candidates.select("candidate", "change", "source", "target").distinct())
    changed = changes.count()
    side = lambda df: by_size(df, changed)  # noqa: E731  of about as many rows as there are changes
    pairs = durable(_counted(graph))
    known = graph.described().select("id", "file", "layer").hint("merge")
    added = side(changes.where("change = 'add'"))
    removed = side(changes.where("change = 'remove'")).join(pairs, ["source", "target"])
    end = lambda c: known.select(F.col("id").alias(c), F.col("file").alias(c + "_file"), F.col("layer").alias(c + "_layer"))
    placed = added.join(end("source"), "source", "left").join(end("target"), "target", "left")
    new = placed.select(
        "candidate", "source", "target", F.lit(1).alias("n"), F.coalesce(F.col("source_file") == F.col("target_file"), F.lit(False)).alias("inside"), F.coalesce(F.col("source_layer") < F.col("target_layer"), F.lit(False)).alias("upward")
    )
    deltas = durable(new.unionByName(removed.select("candidate", "source", "target", (-F.col("n")).alias("n"), "inside", "upward")))
    sums = deltas.groupBy("candidate").agg(F.sum("n").alias("d_edges"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("d_outside"), F.count_if((F.col("n") > 0) & F.col("upward")).alias("violations_added"))
    base = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("outside"))

    fans = durable(pairs.groupBy("source").agg(F.sum("n").alias("fan_out")))
    touched = deltas.groupBy("candidate", "source").agg(F.sum("n").alias("d")).join(fans.hint("merge"), "source", "left").select("candidate", "source", (F.coalesce("fan_out", F.lit(0)) + F.col("d")).alias("fan_out"))
    touched = durable(touched)
    # the largest fan-out of nodes that a candidate leaves alone is among as many as it touches, and one
    most = touched.groupBy("candidate").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]
    top = fans.orderBy(F.desc("fan_out"), "source").limit(most + 1)
    names = changes.select("candidate").distinct()
    alone = names.crossJoin(F.broadcast(top)).join(side(touched.select("candidate", "source")), ["candidate", "source"], "left_anti")  # most + 1 rows for each candidate
    fan = touched.unionByName(alone.select("candidate", "source", "fan_out")).groupBy("candidate").agg(F.max("fan_out").alias("max_fan_out"))
    before = fans.agg(F.coalesce(F.max("fan_out"), F.lit(0)).alias("max_fan_out_before"))

    steps = durable(arcs(graph.edges))
    gone = removed.join(added.select("candidate", "source", "target"), ["candidate", "source", "target"], "left_anti").select("candidate", "source", "target")
    back = lambda df: df.select("candidate", F.col("target").alias("source"), F.col("source").alias("target"))
    after = durable(closes(steps, changes, back(added).unionByName(gone).unionByName(back(gone))))
    closed = back(after).join(added, ["candidate", "source", "target"], "left_semi").groupBy("candidate").agg(F.count("*").alias("cycles_closed"))
    was = gone.select(F.lit("").alias("candidate"), "source", "target").distinct()
    cyclic = back(closes(steps, changes.limit(0), back(was))).select("source", "target")
    both = after.join(side(back(after)), ["candidate", "source", "target"], "left_semi")
    opened = gone.join(side(cyclic), ["source", "target"], "left_semi").join(side(both), ["candidate", "source", "target"], "left_anti").groupBy("candidate").agg(F.count("*").alias("cycles_opened"))

    rows = names.join(side(sums), "candidate", "left").join(side(fan), "candidate", "left").join(side(closed), "candidate", "left").join(side(opened), "candidate", "left")
    rows = rows.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(before)).fillna(0)  # one row each
    edges = F.col("edges") + F.col("d_edges")
    share = lambda part, whole: F.round(F.when(whole > 0, part / whole).otherwise(0.0), 6)
    return rows.select(
        "candidate", edges.alias("edges"), share(F.col("outside") + F.col("d_outside"), edges).alias("coupling"), share(F.col("outside"), F.col("edges")).alias("coupling_before"),
        "violations_added", "max_fan_out", "max_fan_out_before", "cycles_closed", "cycles_opened",
    )


#: What a candidate's risk level is worth.
RISK = {"low": 0.10, "medium": 0.05, "high": 0.0}


def scored(evaluated: DataFrame, risk: Column | None = None) -> DataFrame:
    """Adds ``safe`` and ``score``: a candidate that closes a cycle is not safe and scores -1, others up to 1
    for less coupling, less fan-out, no violations, low risk and opened cycles."""
    level = F.lit("medium") if risk is None else risk
    worth = F.lit(0.0)
    for name, value in RISK.items():
        worth = F.when(level == name, value).otherwise(worth)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    coupling = F.when(F.col("coupling") > 0, 0.25 * clip(0.5 + 5 * (F.col("coupling_before") - F.col("coupling")))).otherwise(0.125)
    fan = 0.15 * clip((F.col("max_fan_out_before") - F.col("max_fan_out")) / 5.0)
    total = coupling + fan + F.when(F.col("violations_added") == 0, 0.10).otherwise(0.0) + worth + 0.10 * F.col("cycles_opened")
    safe = F.col("cycles_closed") == 0
    return evaluated.withColumns({"safe": safe, "score": F.round(F.when(safe, F.least(F.lit(1.0), total)).otherwise(-1.0), 6)})


def search(graph: Graph, moves: DataFrame, width: int = 4, rounds: int = 2) -> DataFrame:
    """(round, place, candidate, score, ...): a beam search over sets of moves (candidate, change, source,
    target). In each round every set of the beam is extended by every move that it lacks, all are evaluated
    in one plan, and the ``width`` best safe ones by score and name without violations are the next
    beam."""
    moves = durable(moves.select("candidate", "change", "source", "target").distinct())
    names, known = moves.select(F.col("candidate").alias("move")).distinct(), by_size(moves.withColumnRenamed("candidate", "move"), moves.count())
    beam, out = names.sparkSession.createDataFrame([([],)], "moves array<string>"), None
    for number in range(1, rounds + 1):
        # width rows by all moves
        sets = F.broadcast(beam).crossJoin(names).where(~F.array_contains("moves", F.col("move"))).select(F.array_sort(F.array_append("moves", F.col("move"))).alias("moves")).distinct()
        sets = durable(sets.withColumn("candidate", F.array_join("moves", " + ")))
        rows = sets.select("candidate", F.explode("moves").alias("move")).join(known, "move").select("candidate", "change", "source", "target")
        best = scored(evaluate(graph, rows)).where("safe and violations_added = 0").orderBy(F.desc("score"), "candidate").limit(width)
        best = durable(best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "candidate"))).withColumn("round", F.lit(number)))
        out = best if out is None else out.unionByName(best)
        beam = best.join(sets, "candidate").select("moves")
    return out


# ---- objectives

#: The objectives with their weights, and which one each strategy of a candidate serves.
WEIGHTS = {"modularity": 0.4, "coupling_reduction": 0.3, "cycle_reduction": 0.2, "maintainability": 0.1}
SERVES = {
    "module_split": "modularity", "fan_out_reduction": "coupling_reduction", "fan_in_reduction": "coupling_reduction", "cycle_break": "cycle_reduction", "component_extraction": "modularity",
    "deep_chain_reduction": "maintainability", "dependency_inversion": "coupling_reduction", "subsystem_boundary": "modularity",
}
OBJECTIVES = tuple(WEIGHTS)


def objectives(candidates: DataFrame, baseline: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds modularity, coupling_reduction, cycle_reduction, maintainability, each from 0 to 1, and their
    weighted ``objective_score`` to candidates (candidate, predicted_score, predicted_coupling,
    predicted_cycles, predicted_max_fan_out, predicted_god_modules). ``baseline`` is one row of score,
    coupling and cycles, which stand in for predictions that are null; without a predicted fan-out it is
    15. Weights are used in proportion; if none is above 0, the usual ones."""
    w = WEIGHTS | (weights or {})
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()} if total > 0 else WEIGHTS
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    base = F.broadcast(baseline.select(F.coalesce("score", F.lit(0.0)).alias("base_score"), F.coalesce("coupling", F.lit(0.0)).alias("base_coupling"), F.coalesce("cycles", F.lit(0)).alias("base_cycles")).limit(1))
    rows = candidates.crossJoin(base)
    coupling, cycles = F.coalesce("predicted_coupling", "base_coupling"), F.coalesce("predicted_cycles", "base_cycles")
    less_coupling = F.when(F.col("base_coupling") > 0, clip((F.col("base_coupling") - coupling) / F.col("base_coupling"))).otherwise(F.when(coupling == 0, 1.0).otherwise(0.0))
    less_cycles = F.when(F.col("base_cycles") > 0, clip((F.col("base_cycles") - cycles) / F.col("base_cycles"))).otherwise(1.0)
    upkeep = F.greatest(F.lit(0.0), 1.0 - F.coalesce("predicted_max_fan_out", F.lit(15)) / 50.0 - F.coalesce("predicted_god_modules", F.lit(0)) * 0.1)
    axes = dict(zip(OBJECTIVES, (clip(F.coalesce("predicted_score", "base_score")), less_coupling, less_cycles, upkeep), strict=True))
    rows = rows.withColumns({k: F.round(v, 6) for k, v in axes.items()}).drop("base_score", "base_coupling", "base_cycles")
    return rows.withColumn("objective_score", F.round(sum((w[k] * F.col(k) for k in OBJECTIVES), F.lit(0.0)), 6))


def without_degrading(rated: DataFrame, score: float, least: float = 0.0) -> DataFrame:
    """Candidates whose modularity is at least about that of now, or ``least``."""
    return rated.where(F.col("modularity") >= max(least, score) * 0.98)


def learnt_weights(effects: DataFrame, weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights in which objectives count more, by up to a half, the more effective strategies that serve
    them were: effects (strategy, effectiveness), of which those above 0 are averaged."""
    serves = F.lit(None).cast("string")
    for strategy, objective in SERVES.items():
        serves = F.when(F.col("strategy") == strategy, objective).otherwise(serves)
    means = effects.where("effectiveness > 0").groupBy(serves.alias("objective")).agg(F.avg("effectiveness").alias("mean"))
    boost = {r["objective"]: 1 + r["mean"] / 2 for r in means.where("objective is not null").collect()}  # four at most
    raised = {k: v * boost.get(k, 1.0) for k, v in (WEIGHTS | (weights or {})).items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total > 0 else dict(WEIGHTS)


#: Points of a local front that are held against one another at once.
BLOCK = 2048


def front_of(points: np.ndarray) -> np.ndarray:
    """Numbers of the points that no other is at least as good as in all and better in one: they are
    swept by falling sum, as a point is only beaten by one of larger sum."""
    order = np.argsort(-points.sum(1), kind="stable")
    kept: list[int] = []
    held = np.empty((0, points.shape[1]))
    for i in order.tolist():
        p = points[i]
        if not len(held) or not ((held >= p).all(1) & (held > p).any(1)).any():
            kept.append(i)
            held = np.vstack([held, p])
    return np.array(kept, np.int64)


def non_dominated(rated: DataFrame, axes: tuple[str, ...] = OBJECTIVES, parts: int | None = None) -> DataFrame:
    """The rows that no other row is at least as good as on all axes and better on one; equal rows stay
    together, nulls count as 0. Every partition sweeps its different points; points of these local fronts
    are held against those of the others in blocks, so no task has more than two blocks."""
    spark = rated.sparkSession
    values = rated.withColumns({f"axis_{k}": F.coalesce(F.col(a).cast("double"), F.lit(0.0)) for k, a in enumerate(axes)})
    names = [f"axis_{k}" for k in range(len(axes))]
    schema = ", ".join(f"{n} double" for n in names)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, len(names)))
        for pdf in batches:
            both = np.unique(np.vstack([held, pdf[names].to_numpy()]), axis=0)
            held = both[front_of(both)]
        yield pd.DataFrame(held, columns=names)

    points = values.select(*names).distinct()
    fronts = durable((points if parts is None else points.repartition(parts)).mapInPandas(local, schema).distinct())
    blocks = max(1, -(-fronts.count() // BLOCK))
    dealt = durable(fronts.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")))
    others = spark.range(blocks).select(F.col("id").cast("int").alias("other"))
    asked = dealt.crossJoin(others).select("block", "other", *names, F.lit(True).alias("asked"))
    told = dealt.crossJoin(others.withColumnRenamed("other", "ask")).select(F.col("ask").alias("block"), F.col("block").alias("other"), *names, F.lit(False).alias("asked"))

    def beaten(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = (pdf.loc[pdf["asked"] == x, names].to_numpy() for x in (True, False))
        lost = [((theirs >= p).all(1) & (theirs > p).any(1)).any() for p in mine]
        return pd.DataFrame(mine[np.array(lost, bool)] if len(mine) else mine, columns=names)

    bad = asked.unionByName(told).groupBy("block", "other").applyInPandas(beaten, schema).distinct()
    best = fronts.join(bad, names, "left_anti")
    return values.join(best, names, "left_semi").select(rated.columns)
