"""Comparison, merging and incremental maintenance of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, dealt, shares

from .metrics import degrees


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, removed, modified or unchanged, by one full join on the keys."""
    a = old.select(*keys, F.struct(*values).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(*keys, F.struct(*values).alias("__new"), F.lit(True).alias("__in_new"))
    same = F.col("__old").eqNullSafe(F.col("__new"))
    change = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def diff_nodes(old: Graph, new: Graph) -> DataFrame:
    return diff(old.nodes, new.nodes, ["id"], ["body_hash"])


def diff_edges(old: Graph, new: Graph) -> DataFrame:
    """Pairs (source, target) by change of their type or confidence. Of the records of a pair the last by
    type and confidence counts."""
    n = shares(old.edges, new.edges)
    one = lambda g: dealt(g.edges.select("source", "target", "edge_type", "confidence"), n, "source", "target").groupBy("source", "target").agg(F.max(F.struct("edge_type", "confidence")).alias("m")).select("source", "target", "m.*")
    return diff(one(old), one(new), ["source", "target"], ["edge_type", "confidence"])


def diff_multigraph(old: Graph, new: Graph) -> DataFrame:
    """(source, target, edge_type, delta): change of the number of records, where there is one."""
    count = lambda g, n: g.edges.select("source", "target", "edge_type", F.lit(n).alias("n"))
    both = count(new, 1).unionByName(count(old, -1))
    return dealt(both, shares(both), "source", "target", "edge_type").groupBy("source", "target", "edge_type").agg(F.sum("n").alias("delta")).where("delta <> 0")


def metric_row(graph: Graph) -> DataFrame:
    """One row: node_count, edge_count, density, max_fan_in, max_fan_out."""
    d = degrees(graph).agg(F.count("*").alias("node_count"), F.coalesce(F.max("fan_in"), F.lit(0)).alias("max_fan_in"), F.coalesce(F.max("fan_out"), F.lit(0)).alias("max_fan_out"))
    out = d.crossJoin(graph.edges.agg(F.count("*").alias("edge_count")))  # one row each
    pairs = F.col("node_count") * (F.col("node_count") - 1)
    return out.withColumn("density", F.round(F.when(pairs > 0, F.col("edge_count") / pairs).otherwise(0.0), 6))


#: Changes from which a metric counts as a regression.
REGRESSION = {"density": 0.2, "max_fan_in": 10, "max_fan_out": 10}


def metric_deltas(old: Graph, new: Graph) -> DataFrame:
    """(metric, before, after, delta, regression)."""
    names = ["node_count", "edge_count", "density", "max_fan_in", "max_fan_out"]
    long = lambda g, c: metric_row(g).unpivot([], [F.col(n).cast("double").alias(n) for n in names], "metric", c)
    out = long(old, "before").join(long(new, "after"), "metric")
    delta = F.round(F.col("after") - F.col("before"), 6)
    regression = F.lit(False)
    for name, most in REGRESSION.items():
        regression = regression | ((F.col("metric") == name) & (delta > most))
    return out.select("metric", "before", "after", delta.alias("delta"), regression.alias("regression"))


def cycle_changes(old: Graph, new: Graph) -> DataFrame:
    """(members, change): strong components that are new or resolved, known by their members."""
    from .components import cycles

    return diff(cycles(old), cycles(new), ["members"], ["size"]).where("change in ('added', 'removed')")


def merge_nodes(base: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Base without removed(id) and the old rows of added ones, with the added ones."""
    gone = removed.select("id").unionByName(added.select("id")).distinct()
    return base.join(gone, "id", "left_anti").unionByName(added, allowMissingColumns=True)


def merge_edges(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.dropDuplicates(["source", "target", "edge_type", "confidence"])


def update_edges(base: Graph, affected_files: DataFrame, deleted: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Edges without those whose source lies in affected(file) or whose target is deleted(id), with the
    rebuilt ones."""
    sources = base.nodes.join(affected_files.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("source"))
    gone = sources.unionByName(deleted.select(F.col("id").alias("source"))).distinct()
    kept = base.edges.join(gone, "source", "left_anti").join(deleted.select(F.col("id").alias("target")).distinct(), "target", "left_anti")
    return kept.select(base.edges.columns).unionByName(rebuilt.select(base.edges.columns))


def apply_delta(base: Graph, new: Graph) -> Graph:
    """The new graph made from the old one: unchanged files keep their rows, the rest comes from new."""
    # a file is known by the number of its rows and sums of 128 bits of their hashes, so that no file is in one row
    halves = lambda h: (F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))))
    digest = [x for k in (1, 2) for x in halves(F.xxhash64("id", "body_hash", F.lit(k)))]
    files = lambda g: g.nodes.groupBy("file").agg(F.struct(F.count("*"), *digest).alias("h"))
    changed = diff(files(base), files(new), ["file"], ["h"]).where("change <> 'unchanged'").select("file")
    removed = base.nodes.join(new.nodes, "id", "left_anti").select("id")
    old_ids = base.nodes.join(changed, "file", "left_semi").select("id")
    nodes = merge_nodes(base.nodes, old_ids.unionByName(removed).distinct(), new.nodes.join(changed, "file", "left_semi"))
    inside = new.nodes.join(changed, "file", "left_semi").select(F.col("id").alias("source"))
    rebuilt = new.edges.join(inside, "source", "left_semi")
    return Graph(nodes, update_edges(base, changed, removed, rebuilt), new.annotations)


def affected_files(graph: Graph, changed_files: DataFrame) -> DataFrame:
    """Changed(file) and the files with a call to a name that a changed file defines."""
    name = lambda c: F.element_at(F.split(c, "::"), -1)
    names = graph.nodes.join(changed_files, "file", "left_semi").select(name("id").alias("name")).distinct()
    calls = graph.ends("file").select(F.col("s_file").alias("file"), name("target").alias("name"))
    return calls.join(names, "name", "left_semi").select("file").unionByName(changed_files.select("file")).where("file is not null").distinct()


def rename_prefix(ids: Column, old: str, new: str) -> Column:
    """Ids whose file was renamed, with the new one."""
    return F.when(F.split_part(ids, F.lit("::"), F.lit(1)) == old, F.concat(F.lit(new), F.substring(ids, F.lit(len(old) + 1), F.length(ids)))).otherwise(ids)


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old_path, change) of two snapshots (path, content_hash); a path with the content of one
    that went is a rename, of several the first."""
    d = diff(old, new, ["path"], ["content_hash"]).where("change <> 'unchanged'")
    gone = d.where("change = 'removed'").join(old, "path").groupBy("content_hash").agg(F.min("path").alias("old_path"))
    came = d.where("change = 'added'").join(new, "path")
    came = came.join(gone, "content_hash", "left").select("path", "old_path", F.when(F.col("old_path").isNotNull(), "renamed").otherwise("added").alias("change"))
    moved = came.where("old_path is not null").select(F.col("old_path").alias("path"))
    rest = d.where("change <> 'added'").join(moved, "path", "left_anti").select("path", F.lit(None).cast("string").alias("old_path"), "change")
    return came.unionByName(rest)


def snapshot_diff(old: dict[str, DataFrame], new: dict[str, DataFrame], ignore: tuple[str, ...] = ("computed_at",)) -> DataFrame:
    """(table, only_old, only_new): rows of each table that one snapshot alone has."""
    out = None
    for name in sorted(set(old) & set(new)):
        columns = sorted(set(old[name].columns) - set(ignore))
        side = lambda df, k: df.select(F.struct(columns).alias("row"), F.lit(k).alias("k"))  # noqa: E731, B023
        sides = side(old[name], 1).unionByName(side(new[name], 2)).groupBy("row").agg(F.bit_or("k").alias("k"))
        row = sides.agg(F.lit(name).alias("table"), F.count_if(F.col("k") == 1).alias("only_old"), F.count_if(F.col("k") == 2).alias("only_new"))
        out = row if out is None else out.unionByName(row)
    return out


def consistency(graph: Graph) -> DataFrame:
    """(problem, n): edge ends without a node, annotations without a node, repeated ids."""
    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(graph.nodes, "id", "left_anti")
    rows = ends.agg(F.lit("unknown_edge_end").alias("problem"), F.count("*").alias("n"))
    if graph.annotations is not None:
        stale = graph.annotations.join(graph.nodes, "id", "left_anti")
        rows = rows.unionByName(stale.agg(F.lit("stale_annotation").alias("problem"), F.count("*").alias("n")))
    repeated = graph.nodes.groupBy("id").count().where("count > 1")
    return rows.unionByName(repeated.agg(F.lit("repeated_id").alias("problem"), F.count("*").alias("n")))


def reconcile(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """(source, target, status): expected edges that came, that did not, and others that came."""
    d = diff(predicted.select("source", "target").distinct().withColumn("x", F.lit(1)), actual.select("source", "target").distinct().withColumn("x", F.lit(1)), ["source", "target"], ["x"])
    status = F.when(F.col("change") == "unchanged", "matched").when(F.col("change") == "removed", "missing").otherwise("unexpected")
    return d.select("source", "target", status.alias("status"))


def upsert_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations with new ones put in: their intent, layer and tags replace the old, the version rises,
    an empty arch_layer keeps the old one."""
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    new_row = F.col("b.id").isNotNull()
    pick = lambda c: F.when(new_row, F.col("b." + c)).otherwise(F.col("a." + c)).alias(c)
    arch = F.coalesce(F.when(F.col("b.arch_layer") != "", F.col("b.arch_layer")), F.col("a.arch_layer"), F.lit(""))
    version = F.coalesce(F.col("a.intent_version"), F.lit(0)) + F.when(new_row, 1).otherwise(0)
    return j.select(F.coalesce("a.id", "b.id").alias("id"), pick("intent"), pick("layer"), arch.alias("arch_layer"), pick("tags"), version.alias("intent_version"))


def missing_intents(graph: Graph) -> DataFrame:
    stated = graph.annotations.where("coalesce(trim(intent), '') <> ''").select("id")
    return graph.nodes.join(stated, "id", "left_anti").select("id")


def stale_intents(graph: Graph) -> DataFrame:
    """(id, reason): annotations of nodes that went or whose body changed since."""
    n = graph.nodes.select("id", "body_hash")
    j = graph.annotations.join(n, "id", "left")
    reason = F.when(F.col("body_hash").isNull(), "node_missing").when(F.col("intent_body_hash").isNotNull() & (F.col("intent_body_hash") != F.col("body_hash")), "body_changed")
    return j.select("id", reason.alias("reason")).where("reason is not null")


def number_collisions(nodes: DataFrame) -> DataFrame:
    """Nodes whose second and later rows of an id are named id[2], id[3] and so on, by file and line."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("id").orderBy("file", "line"))
    return nodes.withColumn("__n", n).withColumn("id", F.when(F.col("__n") > 1, F.concat("id", F.lit("["), F.col("__n"), F.lit("]"))).otherwise(F.col("id"))).drop("__n")
