"""Point lookups, searches and filters over nodes and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, last_segment


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob; ``*`` crosses slashes, ``[...]`` is a set."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += re.sub(r"([^\w\s])", r"\\\1", c)
        i += 1
    return f"(?s)^{out}$"


def matches(column: Column | str, pattern: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).rlike(glob_regex(pattern))


def get_node(graph: Graph, node_id: str) -> DataFrame:
    return graph.described().where(F.col("id") == node_id)


def nodes_in_file(graph: Graph, file: str) -> DataFrame:
    return graph.described().where(F.col("file") == file)


def node_ids(graph: Graph) -> DataFrame:
    return graph.nodes.select("id").orderBy("id")


def callers_of(graph: Graph, node_id: str) -> DataFrame:
    """One row for each edge record into the node."""
    return graph.edges.where(F.col("target") == node_id).select(F.col("source").alias("caller_id"), "edge_type", "confidence")


def callees_of(graph: Graph, node_id: str) -> DataFrame:
    return graph.edges.where(F.col("source") == node_id).select(F.col("target").alias("callee_id"), "edge_type", "confidence")


def nodes_at_layer(graph: Graph, layer: int) -> DataFrame:
    """Annotated nodes of a layer, sorted."""
    return graph.annotations.where(F.col("layer") == layer).select("id").orderBy("id")


def nodes_in_arch_layer(graph: Graph, arch_layer: str) -> DataFrame:
    return graph.described().where(F.col("arch_layer") == arch_layer)


def tests_of(graph: Graph, node_id: str, test_layer: int = 4) -> DataFrame:
    """Sources of test edges into a node, or nodes of the test layer that refer to it."""
    return test_pairs(graph, test_layer).where(F.col("node_id") == node_id).select("test_id").distinct()


def nodes_of_test(graph: Graph, test_id: str, test_layer: int = 4) -> DataFrame:
    return test_pairs(graph, test_layer).where(F.col("test_id") == test_id).select("node_id").distinct()


def test_pairs(graph: Graph, test_layer: int = 4) -> DataFrame:
    """(test_id, node_id): edges of type test, and edges from nodes of the test layer to others."""
    tests = graph.described().where(F.col("layer") == test_layer).select(F.col("id").alias("source"), F.lit(True).alias("is_test"))
    e = graph.edges.join(tests, "source", "left").where((F.col("edge_type") == "test") | F.col("is_test"))
    return e.select(F.col("source").alias("test_id"), F.col("target").alias("node_id")).distinct()


def like_pattern(pattern: str) -> str:
    """A LIKE pattern for a glob; without wildcards the pattern may stand anywhere."""
    quoted = re.sub(r"([\\%_])", r"\\\1", pattern)
    return quoted.replace("*", "%").replace("?", "_") if re.search(r"[*?]", pattern) else f"%{quoted}%"


def search_nodes(graph: Graph, pattern: str, limit: int = 100) -> DataFrame:
    """Ids that match a glob without regard to case, sorted, at most ``limit``."""
    return graph.nodes.where(F.col("id").ilike(like_pattern(pattern))).select("id").orderBy("id").limit(limit)


def suggest(graph: Graph, text: str, limit: int = 5) -> DataFrame:
    """Ids like a mistyped one: those that begin with it, else that hold it, else whose last segment
    holds its last segment; only the first kind that finds any."""
    low, tail = text.lower(), text.rsplit("::", 1)[-1].lower()
    name = F.lower("id")
    stage = F.when(name.startswith(low), 0).when(name.contains(low), 1).when(F.lower(last_segment("id")).contains(tail), 2)
    found = graph.nodes.select("id", stage.alias("stage")).where("stage is not null")
    first = found.agg(F.min("stage").alias("stage"))
    return found.join(F.broadcast(first), "stage").select("id").orderBy("id").limit(limit)


def resolve(graph: Graph, needle: str, limit: int = 100) -> DataFrame:
    """The id itself; else ids that end with ``::needle``; else ids that hold it."""
    found = graph.nodes.where(F.col("id").ilike(like_pattern(needle)))
    stage = F.when(F.col("id") == needle, 0).when(F.col("id").endswith("::" + needle), 1).otherwise(2)
    staged = found.select("id", stage.alias("stage"))
    return staged.join(F.broadcast(staged.agg(F.min("stage").alias("stage"))), "stage").select("id").orderBy("id").limit(limit)


def modifiable(graph: Graph) -> DataFrame:
    """Nodes with whether their layer may be changed (project or test)."""
    return graph.described().select("id", "layer", F.col("layer").isin(3, 4).alias("modifiable"))


#: Method names, prefixes and patterns by which edges are noise.
DUNDERS = ("__init__", "__repr__", "__str__", "__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__", "__hash__", "__bool__", "__len__", "__contains__", "__iter__", "__next__", "__getitem__", "__setitem__", "__delitem__")
DATACLASS_METHODS = ("__init__", "__repr__", "__eq__", "__hash__", "__lt__", "__le__", "__gt__", "__ge__", "__post_init__")
STDLIB_PREFIXES = ("os.path.", "os.", "sys.", "pathlib.", "shutil.", "subprocess.", "tempfile.", "glob.", "fnmatch.", "re.", "json.", "csv.", "io.", "collections.", "itertools.", "functools.", "operator.", "builtins.", "typing.", "abc.", "collections.abc.")
LOGGING = r"(?i)(^|::)(logging\.|logger\.|print$|pprint$|pprint\.)"
HARNESS = r"(?i)(conftest|fixture|setup_module|teardown_module|setup_function|teardown_function|setup_method|teardown_method|setup_class|teardown_class|pytest_|_pytest)"


def _either(test) -> Column:
    return test("source") | test("target")


def dunder_edges() -> Column:
    return _either(lambda c: last_segment(c).isin(*DUNDERS))


def logging_edges() -> Column:
    return F.col("target").rlike(LOGGING)


def stdlib_edges() -> Column:
    """Targets of layer 0 (column t_layer) or with a prefix of the standard library."""
    prefix = F.lit(False)
    for p in STDLIB_PREFIXES:
        prefix = prefix | F.col("target").startswith(p) | F.col("target").contains("::" + p)
    return prefix | F.coalesce(F.col("t_layer") == 0, F.lit(False))


def dataclass_edges(classes: list[str]) -> Column:
    owner = lambda c: F.regexp_extract(c, r"(?s)^(.*)::", 1)
    return _either(lambda c: last_segment(c).isin(*DATACLASS_METHODS) & owner(c).isin(*classes))


def harness_edges() -> Column:
    return _either(lambda c: F.col(c).contains("::") & last_segment(c).rlike(HARNESS) & ~last_segment(c).startswith("test_"))


def low_layer_edges(least: int = 3) -> Column:
    """Edges with an end below a layer (columns s_layer and t_layer)."""
    return (F.coalesce("s_layer", F.lit(3)) < least) | (F.coalesce("t_layer", F.lit(3)) < least)


def filter_edges(graph: Graph, filters: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Edges that no filter takes, and (filter, removed) counts; an edge counts for the first filter
    that takes it. All filters run in one pass."""
    first = F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in filters))
    marked = graph.ends("layer").withColumn("__by", first)
    counts = marked.where("__by is not null").groupBy(F.col("__by").alias("filter")).agg(F.count("*").alias("removed"))
    return marked.where("__by is null").select(graph.edges.columns), counts


def has_effect(effect_type: str) -> Column:
    return F.exists("side_effects", lambda e: e["effect_type"] == effect_type)


def has_action(action_type: str) -> Column:
    return F.exists("actions", lambda a: a["action_type"] == action_type)


def has_tag(tag: str) -> Column:
    return F.array_contains("domain_tags", tag)


#: Semantic node filters by name, over a table of the SEMANTICS schema.
SEMANTIC_FILTERS = {
    "effects": lambda: F.size("side_effects") > 0,
    "pure": lambda: F.size("side_effects") == 0,
    "guards": lambda: F.size("guards") > 0,
    "unguarded": lambda: F.size("guards") == 0,
    "risky": lambda: (F.size("side_effects") > 0) & (F.size("guards") == 0),
    "sql": lambda: F.size("sql_operations") > 0,
    "library": lambda: F.size("library_calls") > 0,
}
