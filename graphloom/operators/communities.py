"""Communities: label propagation and greedy modularity, exactly as if nodes took their turns one by one.

Both are defined by turns in sorted order: a node looks at what the nodes before it have become in this
sweep and at what those after it were at the end of the last one. So the outcome of a sweep is the one
fixed point of "every node decides given the decisions before it", and that is computed for all nodes at
once: all decide on a guess, those whose guess turns out wrong are corrected, and whoever looks at a
corrected node decides again, until nothing changes. Each round settles at least the first node that was
wrong, and in practice all nodes but the tails of long chains of decisions, wherever they are in the
graph. The result does not depend on the number of tasks, and no component is ever gathered in one.

A round reads the arcs of the nodes that decide again; what changed in a sweep is kept beside the table
of all nodes and merged into it when the sweep ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, durable, module_of

from .traverse import arcs

#: Places of the order of turns that are summed together; a power of two.
BUCKET = 1 << 16


def merged(changed: DataFrame, moved: DataFrame | None) -> DataFrame:
    """The rows (id, label) of ``changed`` and those of ``moved`` with other ids."""
    return changed if moved is None else changed.unionByName(moved.join(changed.select("id"), "id", "left_anti"))


def guessed(base: DataFrame, moved: DataFrame | None) -> DataFrame:
    """(id, ..., label, now): the label at the end of the last sweep and the one guessed in this."""
    if moved is None:
        return base.withColumn("now", F.col("label"))
    return base.join(moved.withColumnRenamed("label", "now"), "id", "left").withColumn("now", F.coalesce("now", "label"))


def propagate_labels(graph: Graph, sweeps: int = 20) -> DataFrame:
    """(id, label) of the nodes with edges. Labels are modules at first; each node in turn takes the most
    frequent label around it, of several the largest, until a sweep changes none or there were
    ``sweeps``."""
    near = durable(arcs(graph.edges, undirected=True))
    base = durable(near.select(F.col("at").alias("id")).distinct().withColumn("label", module_of("id")))
    waiting = base.select("id")
    for _ in range(sweeps):
        moved = None
        while True:
            labels = guessed(base, moved)
            asked = waiting.join(near, waiting.id == near.at).select("at", "to")
            seen = asked.join(labels, labels.id == asked["to"]).select("at", F.when(F.col("to") < F.col("at"), F.col("now")).otherwise(F.col("label")).alias("label"))
            votes = seen.groupBy("at", "label").agg(F.count("*").alias("n"))
            best = votes.groupBy("at").agg(F.max(F.struct("n", "label")).alias("best")).select(F.col("at").alias("id"), F.col("best.label").alias("best"))
            changed = durable(best.join(labels, "id").where("best <> now").select("id", F.col("best").alias("label")))
            if changed.isEmpty():
                break
            moved = durable(merged(changed, moved))
            waiting = changed.join(near, changed.id == near.at).where("to > at").select(F.col("to").alias("id")).distinct()
        if moved is None:
            break
        swept = durable(moved.withColumnRenamed("label", "new").join(base, "id").where("new <> label").select("id", "new"))
        if swept.isEmpty():
            break
        base = durable(base.join(swept, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
        waiting = durable(swept.join(near, swept.id == near.at).where("to <= at").select(F.col("to").alias("id")).distinct())
        if waiting.isEmpty():
            break
    return base


def partition_name(seed: str) -> Column:
    """The name of a partition: the module of its first node, and a hash of that node."""
    module = F.regexp_replace(module_of(seed), "[/.]", "_")
    return F.concat(F.when(module == "", "partition").otherwise(module), F.lit("_"), F.substring(F.sha1(seed), 1, 8))


def partitions(graph: Graph, least: int = 4) -> DataFrame:
    """(id, partition_id): communities by label propagation. Labels with fewer than ``least`` nodes join
    the first large partition that shares a module, else stay alone; if none is large, all stay."""
    found = propagate_labels(graph)
    alone = graph.nodes.select("id").join(found, "id", "left_anti")
    labels = durable(found.unionByName(alone.select("id", module_of("id").alias("label"))))
    groups = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("seed"))
    any_large = groups.agg(F.max(F.col("n") >= least).alias("any_large"))
    groups = groups.crossJoin(F.broadcast(any_large)).withColumn("partition_id", partition_name("seed"))
    kept = durable(labels.join(groups.where((F.col("n") >= least) | ~F.col("any_large")), "label").select("id", "partition_id"))
    small = labels.join(kept, "id", "left_anti").select("id", module_of("id").alias("module"))
    homes = kept.groupBy(module_of("id").alias("module")).agg(F.min("partition_id").alias("partition_id"))
    own = F.concat(F.regexp_replace("module", "[/.]", "_"), F.lit("_"), F.substring(F.sha1("id"), 1, 8))
    return kept.unionByName(small.join(homes, "module", "left").select("id", F.coalesce("partition_id", own).alias("partition_id")))


def directory_of(file: Column) -> Column:
    """The folder of a file; ``.`` without one."""
    folder = F.regexp_extract(F.regexp_replace(file, r"\\", "/"), r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", ".").otherwise(folder)


def _across(graph: Graph, parts: DataFrame) -> DataFrame:
    """Edge records with the partitions ps and pt of their ends."""
    s, t = parts.select(F.col("id").alias("source"), F.col("partition_id").alias("ps")), parts.select(F.col("id").alias("target"), F.col("partition_id").alias("pt"))
    return graph.edges.join(s, "source").join(t, "target")


def community_overview(graph: Graph, parts: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(partition_id, size, internal_edges, boundary_edges, boundary_nodes, files, directories,
    type_counts, declared_subsystem) of communities (id, partition_id). ``type_counts`` maps node types to
    numbers. A community has a declared subsystem if all of its nodes have the same one in
    ``declared`` (id, subsystem). Nodes without a file count with their module."""
    e = _across(graph, parts)
    inside = e.where("ps = pt").groupBy(F.col("ps").alias("partition_id")).agg(F.count("*").alias("internal_edges"))
    ends = e.where("ps <> pt").select(F.explode(F.array(F.struct(F.col("ps").alias("p"), F.col("source").alias("n")), F.struct(F.col("pt").alias("p"), F.col("target").alias("n")))).alias("x"))
    boundary = ends.groupBy(F.col("x.p").alias("partition_id")).agg(F.count("*").alias("boundary_edges"), F.countDistinct("x.n").alias("boundary_nodes"))
    owned = parts.join(graph.nodes.select("id", "file", "type"), "id", "left")
    if declared is not None:
        owned = owned.join(declared.select("id", F.when(F.trim("subsystem") != "", F.trim("subsystem")).alias("subsystem")), "id", "left")
    else:
        owned = owned.withColumn("subsystem", F.lit(None).cast("string"))
    file = F.when(F.trim("file") != "", F.trim("file")).otherwise(module_of("id"))
    owned = owned.withColumns({"file": file, "type": F.coalesce("type", F.lit("function"))})
    one = (F.count("subsystem") == F.count("*")) & (F.min("subsystem") == F.max("subsystem"))
    sizes = owned.groupBy("partition_id").agg(
        F.count("*").alias("size"), F.countDistinct("file").alias("files"), F.countDistinct(directory_of(F.col("file"))).alias("directories"), F.when(one, F.min("subsystem")).alias("declared_subsystem")
    )
    kinds = owned.groupBy("partition_id", "type").agg(F.count("*").alias("n")).groupBy("partition_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_counts"))
    out = sizes.join(kinds, "partition_id").join(inside, "partition_id", "left").join(boundary, "partition_id", "left").fillna(0, ["internal_edges", "boundary_edges", "boundary_nodes"])
    return out.select("partition_id", "size", "internal_edges", "boundary_edges", "boundary_nodes", "files", "directories", "type_counts", "declared_subsystem")


def community_links(graph: Graph, parts: DataFrame) -> DataFrame:
    """(source_community, target_community, edge_count, coupling_score): edge records between communities
    in either direction, over those and the internal ones of both."""
    pairs = _across(graph, parts).groupBy(F.least("ps", "pt").alias("a"), F.greatest("ps", "pt").alias("b")).agg(F.count("*").alias("n"))
    inside = pairs.where("a = b")
    out = pairs.where("a <> b").join(inside.select("a", F.col("n").alias("na")), "a", "left").join(inside.select("b", F.col("n").alias("nb")), "b", "left").fillna(0, ["na", "nb"])
    return out.select(F.col("a").alias("source_community"), F.col("b").alias("target_community"), F.col("n").alias("edge_count"), F.round(F.col("n") / (F.col("na") + F.col("nb") + F.col("n")), 6).alias("coupling_score"))


# ---- modularity


def file_weights(graph: Graph) -> DataFrame:
    """(at, to, w): edge records between two files in either direction, for both ends."""
    e = graph.ends("file").where("s_file is not null and t_file is not null and s_file <> t_file")
    pairs = e.groupBy(F.least("s_file", "t_file").alias("a"), F.greatest("s_file", "t_file").alias("b")).agg(F.count("*").alias("w"))
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to"), "w"), F.struct(F.col("b").alias("at"), F.col("a").alias("to"), "w"))).alias("x")).select("x.*")


def totals_before(asked: DataFrame, moves: DataFrame) -> DataFrame:
    """For ``asked`` (id, place, label) also ``total``, the sum of ``delta`` over the rows of ``moves``
    (place, label, delta) of that label at places before. Sums of buckets of places first, then those
    within a bucket, so that a label that all nodes move to is not summed in one task."""
    bucket = F.shiftright("place", BUCKET.bit_length() - 1)
    rows = asked.select("label", "place", bucket.alias("bucket"), F.lit(0).cast("long").alias("delta"), "id").unionByName(
        moves.select("label", "place", bucket.alias("bucket"), "delta", F.lit(None).cast("string").alias("id"))
    )
    inside = rows.withColumn("within", F.sum("delta").over(Window.partitionBy("label", "bucket").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)))
    sums = rows.groupBy("label", "bucket").agg(F.sum("delta").alias("whole"))
    sums = sums.withColumn("earlier", F.sum("whole").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("whole")
    out = inside.where("id is not null").join(sums, ["label", "bucket"])
    return out.select("id", "label", (F.coalesce("within", F.lit(0)) + F.coalesce("earlier", F.lit(0))).alias("total"))


def greedy_modularity(near: DataFrame, passes: int = 50) -> DataFrame:
    """(id, label) for weights (at, to, w), each pair given for both ends. Every node is a community at
    first. Each in turn moves to the community around it of largest gain, of several that of smallest
    name, if that is more than what staying gains, until a pass moves none. Gains are whole numbers: twice
    the total weight times what the node shares with a community, less its degree times that
    community's."""
    near = durable(near)
    degrees = near.groupBy(F.col("at").alias("id")).agg(F.sum("w").alias("degree"))
    # numbers in the order of ids: partitions are ranges of it, and sorted
    base = durable(degrees.orderBy("id").withColumns({"place": F.monotonically_increasing_id(), "label": F.col("id")}))
    twice = base.agg(F.sum("degree")).head()[0]
    if twice is None:
        return base.select("id", "label")
    waiting = base.select("id")
    for _ in range(passes):
        totals = durable(base.groupBy("label").agg(F.sum("degree").alias("all")))
        moved = None
        while True:
            labels = guessed(base, moved)
            asked = waiting.join(near, waiting.id == near.at).select("at", "to", "w")
            seen = asked.join(labels, labels.id == asked["to"]).select("at", F.when(F.col("to") < F.col("at"), F.col("now")).otherwise(F.col("label")).alias("label"), "w")
            own = waiting.join(labels, "id").select(F.col("id").alias("at"), "label", F.lit(0).cast("long").alias("w"))
            shared = seen.unionByName(own).groupBy(F.col("at").alias("id"), "label").agg(F.sum("w").alias("shared"))
            choices = durable(shared.join(labels.select("id", "place", "degree", F.col("label").alias("old"), "now"), "id"))
            moves = labels.where("now <> label").select("place", F.explode(F.array(F.struct(F.col("now").alias("label"), F.col("degree").alias("delta")), F.struct(F.col("label").alias("label"), (-F.col("degree")).alias("delta")))).alias("x")).select("place", "x.*")
            known = choices.join(totals, "label").join(totals_before(choices.select("id", "place", "label"), moves), ["id", "label"])
            rest = F.col("all") + F.col("total") - F.when(F.col("label") == F.col("old"), F.col("degree")).otherwise(0)
            gain = F.col("shared").cast("decimal(19,0)") * F.lit(twice).cast("decimal(19,0)") - rest.cast("decimal(19,0)") * F.col("degree").cast("decimal(19,0)")
            # of equal gains the own community, then the smallest name
            best = known.groupBy("id").agg(F.min(F.struct((-gain).alias("loss"), (F.col("label") != F.col("old")).alias("moves"), "label", "place", "now")).alias("best"))
            changed = durable(best.where("best.label <> best.now").select("id", F.col("best.label").alias("label"), F.col("best.now").alias("was"), F.col("best.place").alias("place")))
            if changed.isEmpty():
                break
            moved = durable(merged(changed.select("id", "label"), moved))
            waiting = readers(changed.select(F.explode(F.array("label", "was")).alias("label"), "place"), guessed(base, moved), near)
        swept = None if moved is None else durable(moved.withColumnRenamed("label", "new").join(base, "id").where("new <> label").select("id", "new", "label"))
        if swept is None or swept.isEmpty():
            break
        base = durable(base.join(swept.select("id", "new"), "id", "left").select("id", "degree", "place", F.coalesce("new", "label").alias("label")))
        touched = swept.select(F.explode(F.array("new", "label")).alias("label"), F.lit(-1).cast("long").alias("place"))
        waiting = readers(touched, base.withColumn("now", F.col("label")), near)
    return base.select("id", "label")


def readers(touched: DataFrame, labels: DataFrame, near: DataFrame) -> DataFrame:
    """(id) of the nodes whose decision may depend on the communities ``touched`` (label, place), which
    changed at that place: those in them or next to one of theirs, after it."""
    since = touched.groupBy(F.col("label").alias("community")).agg(F.min("place").alias("since"))
    member = labels.select("id", "place", F.explode(F.array_distinct(F.array("label", "now"))).alias("community")).join(since, "community").groupBy("id").agg(F.min("since").alias("since"))
    around = near.join(member, near["to"] == member.id).select(F.col("at").alias("id"), "since").unionByName(member)
    first = around.groupBy("id").agg(F.min("since").alias("since"))
    return durable(first.join(labels.select("id", "place"), "id").where("place > since").select("id"))


def subsystems_by_modularity(graph: Graph) -> DataFrame:
    """(file, subsystem): communities of the file graph by greedy modularity, named by their first file.
    Files without edges to another are on their own."""
    found = greedy_modularity(file_weights(graph))
    named = found.join(found.groupBy("label").agg(F.min("id").alias("subsystem")), "label").select(F.col("id").alias("file"), "subsystem")
    files = graph.nodes.select("file").where("file is not null").distinct()
    return named.unionByName(files.join(named, "file", "left_anti").select("file", F.col("file").alias("subsystem")))


def subsystem_name(files: Column) -> Column:
    """The name of a subsystem from the list of its files: of one its base name without ``.py``, of more
    their common folders or else the most frequent folder (a file without one counts with its name), of
    equally frequent ones that of the first file in order; ``unknown`` without files."""
    paths = F.transform(F.array_sort(files), lambda f: F.split(F.regexp_replace(f, r"\\", "/"), "/"))
    head = F.get(paths, 0)
    least = F.array_min(F.transform(paths, lambda p: F.size(p)))
    same = lambda i: F.forall(paths, lambda p: F.get(p, i) == F.get(head, i))
    common = F.aggregate(F.sequence(F.lit(0), least - 1), F.lit(0), lambda n, i: F.when((n == i) & same(i), n + 1).otherwise(n))
    prefix = F.regexp_replace(F.array_join(F.slice(head, 1, common), "/"), r"\.py$", "")
    folders = F.transform(paths, lambda p: F.when(F.size(p) > 1, F.array_join(F.slice(p, 1, F.size(p) - 1), "/")).otherwise(F.get(p, 0)))
    often = lambda x: F.size(F.filter(folders, lambda y: y == x))
    most = F.array_max(F.transform(folders, often))
    frequent = F.get(F.filter(folders, lambda x: often(x) == most), 0)
    alone = F.replace(F.element_at(head, -1), F.lit(".py"), F.lit(""))
    return F.when(F.coalesce(F.size(files), F.lit(0)) < 1, "unknown").when(F.size(files) == 1, alone).when(common > 0, prefix).otherwise(frequent)


def subsystem_report(graph: Graph, owners: DataFrame, least: int = 2) -> DataFrame:
    """(subsystem, name, files, nodes, internal_edges, external_edges, cohesion, share) of subsystems
    (file, subsystem) with at least ``least`` nodes. Edges are records between different files; cohesion is
    the internal ones over all, 1 without any. ``share`` is what the subsystem adds to the modularity of
    the partition, so that the sum of the column is Q."""
    near = durable(file_weights(graph))
    a, b = owners.select(F.col("file").alias("at"), F.col("subsystem").alias("sa")), owners.select(F.col("file").alias("to"), F.col("subsystem").alias("sb"))
    seen = near.join(a, "at").join(b, "to").groupBy(F.col("sa").alias("subsystem")).agg(
        F.sum(F.when(F.col("sa") == F.col("sb"), F.col("w")).otherwise(0)).alias("twice"), F.sum(F.when(F.col("sa") != F.col("sb"), F.col("w")).otherwise(0)).alias("external_edges")
    )
    total = near.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("all"))
    nodes = graph.nodes.select("file").where("file is not null").groupBy("file").agg(F.count("*").alias("n"))
    # a subsystem's file names are its result here, a row's size grows with their number
    sizes = owners.join(nodes, "file").groupBy("subsystem").agg(F.collect_list("file").alias("list"), F.sum("n").alias("nodes"), F.count("*").alias("files")).where(F.col("nodes") >= least)
    out = sizes.join(seen, "subsystem", "left").fillna(0, ["twice", "external_edges"]).crossJoin(F.broadcast(total))
    internal = (F.col("twice") / 2).cast("long")
    share = F.when(F.col("all") > 0, F.col("twice") / F.col("all") - F.pow((F.col("twice") + F.col("external_edges")) / F.col("all"), 2)).otherwise(0.0)
    cohesion = F.when(internal + F.col("external_edges") > 0, internal / (internal + F.col("external_edges"))).otherwise(1.0)
    return out.select("subsystem", subsystem_name(F.col("list")).alias("name"), "files", "nodes", internal.alias("internal_edges"), "external_edges", F.round(cohesion, 6).alias("cohesion"), F.round(share, 6).alias("share"))


def subsystem_couplings(graph: Graph, owners: DataFrame) -> DataFrame:
    """(subsystem_a, subsystem_b, edge_count, coupling_strength): records between two subsystems in either
    direction, also over all records between different files."""
    near = durable(file_weights(graph).where("at < to"))
    a, b = owners.select(F.col("file").alias("at"), F.col("subsystem").alias("sa")), owners.select(F.col("file").alias("to"), F.col("subsystem").alias("sb"))
    pairs = near.join(a, "at").join(b, "to").where("sa <> sb").groupBy(F.least("sa", "sb").alias("subsystem_a"), F.greatest("sa", "sb").alias("subsystem_b")).agg(F.sum("w").alias("edge_count"))
    total = near.agg(F.sum("w").alias("all"))
    return pairs.crossJoin(F.broadcast(total)).select("subsystem_a", "subsystem_b", "edge_count", F.round(F.col("edge_count") / F.col("all"), 6).alias("coupling_strength"))
