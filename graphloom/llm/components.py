"""Connected components of a link table by repeated hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def contract(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links(a, b)``; component is the smallest id it reaches.
    Each round hooks every component on its smallest neighbour, halves the paths until they are
    flat and keeps the links between different components, so rounds grow with the logarithm of
    the number of ids. Only counts come to the driver."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y")
    edges = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    labels = None
    while True:
        parents = cut(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("p")), "parents")
        while True:
            up = parents.select(F.col("x").alias("p"), F.col("p").alias("q"))
            jumped = cut(parents.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"), (F.col("q") < F.col("p")).alias("moved")), "jumps")
            moved = jumped.where("moved").limit(1).count()
            parents = jumped.select("x", "p")
            if not moved:
                break
        if labels is None:
            labels = parents.select(F.col("x").alias("id"), F.col("p").alias("component"))
        else:
            step = parents.select(F.col("x").alias("component"), "p")
            labels = labels.join(step, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        ends = edges.join(parents, "x", "left").select(F.coalesce("p", "x").alias("x"), "y")
        ends = ends.join(parents.select(F.col("x").alias("y"), "p"), "y", "left").select("x", F.coalesce("p", "y").alias("y"))
        edges = cut(ends.where("x <> y").distinct(), "edges")
        if not edges.limit(1).count():
            return cut(labels, "labels")
