"""A planned graph: an ordered list of changes laid over a graph without rewriting it.

Changes are rows (place, op, a, b, edge_type) in the order of ``place``, which is above 0:
``add_node`` and ``remove_node`` of a, ``rename_node`` of a to b, ``add_edge`` and ``remove_edge`` from
a to b. What a name stands for at some place is followed through later renames, which gives the stretches
of places in which it has each of its names; a removal ends what has its name at that place. So the fate
of each node and edge that the changes touch is found on its own, by joins with the changes, which are
few; what they do not touch stays where it is, and the result is a plan over the base like any graph.

Removing a node takes the edges that are there at that point, not those that are added later. Adding what
is there changes nothing; removing an edge takes all of its records of that type. Renaming to a name that
is taken makes one node of both and keeps the edges of both. Edges may have ends that are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, durable

OPS = "place long, op string, a string, b string, edge_type string"


def change_list(spark: SparkSession, ops: list[tuple]) -> DataFrame:
    """Changes from (op, a, b, edge_type), the last two as far as they are needed, in order."""
    return spark.createDataFrame([(k + 1, *op, *(None,) * (4 - len(op))) for k, op in enumerate(ops)], OPS)


NEVER = (1 << 62) - 1


def name_spans(names: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, place, called, since, until): what is called ``name`` at ``place`` is called ``called``
    between two places later."""
    renames = durable(renames.select(F.col("a").alias("was"), F.col("b").alias("to"), F.col("place").alias("at")))
    live = durable(names.select("name", "place").distinct().select("name", "place", F.col("name").alias("called"), F.col("place").alias("since")))
    out = None
    while True:
        later = live.join(renames, (live.called == renames.was) & (renames["at"] > live.since), "left")
        key = ["name", "place", "called", "since"]
        step = durable(later.groupBy(*key).agg(F.min(F.struct("at", "to")).alias("next"), F.count("at").alias("n")))
        done = step.select(*key, F.when(F.col("n") > 0, F.col("next.at")).otherwise(NEVER).alias("until"))
        out = done if out is None else out.unionByName(done)
        live = durable(step.where("n > 0").select("name", "place", F.col("next.to").alias("called"), F.col("next.at").alias("since")))
        if live.isEmpty():
            return durable(out)


def planned(graph: Graph, changes: DataFrame) -> Graph:
    """The graph with the changes laid over it."""
    ops = durable(changes.select("place", "op", "a", "b", F.coalesce("edge_type", F.lit("call")).alias("edge_type")))
    said = ops.select(F.explode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("name"), "place")
    named = said.unionByName(said.select("name", F.lit(0).cast("long").alias("place"))).distinct()
    spans = name_spans(named, ops.where("op = 'rename_node'"))
    removed_nodes = ops.where("op = 'remove_node'").select(F.col("a").alias("gone"), F.col("place").alias("t"))
    final = spans.where(F.col("until") == NEVER).select("name", "place", F.col("called").alias("final"))

    # nodes: those of the base that changes name, and added ones
    died = spans.join(removed_nodes, (spans.called == removed_nodes.gone) & (F.col("t") > F.col("since")) & (F.col("t") < F.col("until"))).select("name", "place").distinct()
    living = durable(final.join(died, ["name", "place"], "left_anti"))
    touched = said.select(F.col("name").alias("id")).distinct()

    def kept(df: DataFrame) -> DataFrame:
        """Rows of the base under their final names; of several with one name that of the row that had it."""
        own = living.where("place = 0").select(F.col("name").alias("id"), "final")
        moved = df.join(own, "id").withColumns({"was": F.col("id"), "id": F.col("final")}).drop("final")
        first = moved.groupBy(F.col("id").alias("now")).agg(F.min_by(F.struct(*moved.columns), F.struct(F.col("was") != F.col("id"), "was")).alias("row")).select("row.*")
        return df.join(touched, "id", "left_anti").unionByName(first.select(df.columns)).select(df.columns)

    nodes = kept(graph.nodes)
    new = ops.where("op = 'add_node'").select(F.col("a").alias("name"), "place").join(living, ["name", "place"]).select(F.col("final").alias("id")).distinct()
    values = {"file": F.col("id"), "type": F.lit("module"), "line": F.lit(1), "body_hash": F.lit("")}
    fresh = new.join(nodes, "id", "left_anti").select("id", *(v.alias(c) for c, v in values.items() if c in graph.nodes.columns))
    nodes = nodes.unionByName(fresh, allowMissingColumns=True).select(graph.nodes.columns)

    # edges: kinds of records of the base with an end that the changes name, and added ones
    key = ["source", "target", "edge_type"]
    by = lambda c: touched.withColumnRenamed("id", c)
    kinds = graph.edges.select(*key).distinct()
    near = kinds.join(by("source"), "source", "left_semi").unionByName(kinds.join(by("target"), "target", "left_semi")).distinct().withColumn("born", F.lit(0).cast("long"))
    lives = durable(near.unionByName(ops.where("op = 'add_edge'").select(F.col("a").alias("source"), F.col("b").alias("target"), "edge_type", F.col("place").alias("born"))))
    one = [*key, "born"]
    side = lambda c: spans.select(F.col("name").alias(c), F.col("place").alias("born"), F.col("called").alias("called_" + c), F.col("since").alias("since_" + c), F.col("until").alias("until_" + c))
    parts = lives.join(side("source"), ["source", "born"], "left").join(side("target"), ["target", "born"], "left")
    parts = parts.select(
        *one, F.coalesce("called_source", "source").alias("s"), F.coalesce("called_target", "target").alias("t"),
        F.greatest(F.coalesce("since_source", "born"), F.coalesce("since_target", "born")).alias("since"), F.least(F.coalesce("until_source", F.lit(NEVER)), F.coalesce("until_target", F.lit(NEVER))).alias("until"),
    )
    parts = durable(parts.where("since < until"))
    within = (F.col("at") > F.col("since")) & (F.col("at") < F.col("until"))
    ends = removed_nodes.select("gone", F.col("t").alias("at"))
    cuts = ops.where("op = 'remove_edge'").select(F.col("a").alias("s"), F.col("b").alias("t"), "edge_type", F.col("place").alias("at"))
    deaths = parts.join(ends, (F.col("gone") == F.col("s")) | (F.col("gone") == F.col("t"))).where(within).select(*one, "at").unionByName(parts.join(cuts, ["s", "t", "edge_type"]).where(within).select(*one, "at"))
    parts = durable(parts.join(deaths.groupBy(*one).agg(F.min("at").alias("died")), one, "left").withColumn("died", F.coalesce("died", F.lit(NEVER))))
    asked = ops.where("op = 'add_edge'").select(F.col("a").alias("s"), F.col("b").alias("t"), "edge_type", F.col("place").alias("at"))
    there = parts.join(asked, ["s", "t", "edge_type"]).where(within & (F.col("born") < F.col("at")) & (F.col("died") > F.col("at")))
    idle = there.select(F.col("s").alias("source"), F.col("t").alias("target"), "edge_type", F.col("at").alias("born")).distinct()
    left = durable(parts.where((F.col("died") == NEVER) & (F.col("until") == NEVER)).select(*one, "s", "t"))

    columns = graph.edges.columns
    moved = graph.edges.join(left.where("born = 0").drop("born"), key).withColumns({"source": F.col("s"), "target": F.col("t")}).select(columns)
    added = left.where("born > 0").join(idle, one, "left_anti").select(F.col("s").alias("source"), F.col("t").alias("target"), "edge_type", F.lit("static").alias("confidence"))
    edges = graph.edges.join(near.drop("born"), key, "left_anti").select(columns).unionByName(moved).unionByName(added, allowMissingColumns=True).select(columns)
    return Graph(nodes, edges, None if graph.annotations is None else kept(graph.annotations))


def written_out(nodes: set[str], edges: list[tuple[str, str, str]], ops: list[tuple]) -> tuple[set[str], list[tuple[str, str, str]]]:
    """The changes applied one after the other to a small graph in memory; for comparison."""
    for op, a, *rest in ops:
        b, kind = (*rest, None, None)[:2]
        if op == "add_node":
            nodes = nodes | {a}
        elif op == "remove_node":
            nodes, edges = nodes - {a}, [e for e in edges if a not in e[:2]]
        elif op == "rename_node":
            to = lambda x: b if x == a else x  # noqa: B023, E731
            nodes, edges = {to(x) for x in nodes}, [(to(s), to(t), k) for s, t, k in edges]
        elif op == "remove_edge":
            edges = [e for e in edges if e != (a, b, kind or "call")]
        elif (a, b, kind or "call") not in edges:
            edges = [*edges, (a, b, kind or "call")]
    return nodes, edges
