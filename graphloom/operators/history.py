"""Time series of snapshots, experiments and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_trend(history: DataFrame, step: float = 0.05) -> DataFrame:
    """(at, score, delta, trend) of history(at, score): change since the row before."""
    delta = F.col("score") - F.lag("score").over(Window.orderBy("at"))
    trend = F.when(delta > step, "improving").when(delta < -step, "declining").otherwise("stable")
    return history.select("at", "score", F.round(delta, 6).alias("delta"), trend.alias("trend"))


def converged(history: DataFrame, rows: int = 3, tolerance: float = 0.05) -> DataFrame:
    """(at, converged): the last three counts of nodes are equal and those of edges within 5 %."""
    w = Window.orderBy("at").rowsBetween(1 - rows, 0)
    full = F.count("*").over(w) == rows
    same = F.min("nodes").over(w) == F.max("nodes").over(w)
    near = F.max("edges").over(w) - F.min("edges").over(w) <= tolerance * F.min("edges").over(w)
    return history.select("at", (full & same & near).alias("converged"))


def interactions(edges: DataFrame, most: int = 200) -> DataFrame:
    """(source_kind, target_kind, n, share): edge records by the second last segments of their ends."""
    kind = lambda c: F.when(F.size(F.split(c, "::")) >= 2, F.element_at(F.split(c, "::"), -2)).otherwise(F.col(c))
    counts = edges.groupBy(kind("source").alias("source_kind"), kind("target").alias("target_kind")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("source_kind", "target_kind", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.desc("n"), "source_kind", "target_kind").limit(most)


def mined_tags(experiments: DataFrame, least: int = 2) -> DataFrame:
    """(tag, n, success, avg_delta, examples) of experiments(id, tags, merged, delta)."""
    e = experiments.select("id", "merged", "delta", F.explode("tags").alias("tag"))
    out = e.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg(F.col("merged").cast("int")), 6).alias("success"), F.round(F.avg("delta"), 6).alias("avg_delta"), F.slice(F.array_sort(F.collect_set("id")), 1, 5).alias("examples"))
    return out.where(F.col("n") >= least)


def strategy_effect(runs: DataFrame) -> DataFrame:
    """(strategy, n, effect) of runs(strategy, success, delta): half the success rate, half the mean of
    deltas other than 0 plus a half, within 0 and 1."""
    mean = F.coalesce(F.avg(F.when(F.col("delta") != 0, F.col("delta"))), F.lit(0.0))
    gain = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean + 0.5))
    return runs.groupBy("strategy").agg(F.count("*").alias("n"), F.round(0.5 * F.avg(F.col("success").cast("int")) + 0.5 * gain, 6).alias("effect"))


def proposal_feedback(proposals: DataFrame) -> DataFrame:
    """(task, n, accepted, rejected, adverse, bump) of proposals(status, violations, tasks)."""
    p = proposals.select("status", "violations", F.explode("tasks").alias("task"))
    out = p.groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.round(F.avg(((F.col("status") == "rejected") | (F.col("violations") > 0)).cast("int")), 6).alias("adverse"))
    return out.withColumn("bump", F.col("adverse") >= 0.5)


def calibration(predictions: DataFrame) -> DataFrame:
    """(action, n, accuracy, mae) of predictions(action, expected, actual) with an actual value."""
    p = predictions.where("actual is not null")
    right = (F.signum("expected") == F.signum("actual")).cast("int")
    return p.groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.abs(F.col("expected") - F.col("actual"))), 6).alias("mae"))


def metric_gate(before: DataFrame, after: DataFrame, limits: DataFrame) -> DataFrame:
    """(metric, before, after, delta, passed) of (metric, value) tables and limits(metric, most,
    inverted): the rise, or the fall of an inverted metric, may be at most ``most``."""
    j = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric").join(limits, "metric")
    delta = F.col("after") - F.col("before")
    return j.select("metric", "before", "after", F.round(delta, 6).alias("delta"), (F.when(F.col("inverted"), -delta).otherwise(delta) <= F.col("most")).alias("passed"))


def target_delta(target_nodes: DataFrame, nodes: DataFrame, target_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, subject, change) between a target architecture and the actual one."""
    pair = F.concat_ws(" -> ", "source", "target")
    ids = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), c.alias("subject")).distinct()
    want = ids(target_nodes, "node", F.col("id")).unionByName(ids(target_edges, "edge", pair))
    have = ids(nodes, "node", F.col("id")).unionByName(ids(edges, "edge", pair))
    return want.join(have, ["kind", "subject"], "left_anti").withColumn("change", F.lit("to_add")).unionByName(have.join(want, ["kind", "subject"], "left_anti").withColumn("change", F.lit("to_remove")))
