"""The query language: text to a tree of frozen nodes, and a tree to a DataFrame.

    query   = term { OR term }
    term    = factor { AND factor | NOT factor }        A NOT B: A without B; AND NOT too
    factor  = NOT factor | "(" query ")" | select | call
    call    = name [ "(" [ argument { "," argument } ] ")" ] | name value
    select  = SELECT target [ WHERE condition { AND condition } ] | SELECT target IN subsystem(root)
    condition = name "(" text ")" | name op value | name

Words in quotes are text, whatever they are. Conditions of a SELECT bind stronger than boolean words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import components, lookup, metrics, policy, traverse


class QueryError(ValueError):
    """The text is no query, or asks for something unknown."""


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    options: tuple = ()

    def option(self, name: str, default=None):
        return dict(self.options).get(name, default)


@dataclass(frozen=True)
class Condition:
    name: str
    op: str = ""
    value: object = None


@dataclass(frozen=True)
class Select:
    target: str
    conditions: tuple = ()
    root: str | None = None


@dataclass(frozen=True)
class Combine:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Complement:
    of: object


TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op><=|>=|!=|=|<|>)|(?P<mark>[(),])|(?P<word>[^\s()=<>!,"']+))""")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"cannot read {text[at:]!r}")
        kind = m.lastgroup
        value = re.sub(r"\\(.)", r"\1", m[kind][1:-1]) if kind == "text" else m[kind]
        out.append((kind, value))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if (kind and k != kind) or (value and v.upper() != value):
            raise QueryError(f"expected {value or kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def is_word(self, *words: str) -> bool:
        k, v = self.peek()
        return k == "word" and v.upper() in words

    def parse(self):
        if not self.items:
            raise QueryError("empty query")
        out = self.query()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return out

    def query(self):
        left = self.term()
        while self.is_word("OR"):
            self.take()
            left = Combine("or", left, self.term())
        return left

    def term(self):
        left = self.factor()
        while self.is_word("AND", "NOT"):
            word = self.take().upper()
            if word == "AND" and self.is_word("NOT"):
                word = self.take().upper()
            left = Combine("and" if word == "AND" else "not", left, self.factor())
        return left

    def factor(self):
        if self.is_word("NOT"):
            self.take()
            return Complement(self.factor())
        if self.peek() == ("mark", "("):
            self.take()
            inner = self.query()
            self.take("mark", ")")
            return inner
        return self.select() if self.is_word("SELECT") else self.call()

    def value(self):
        k, v = self.peek()
        if k not in ("text", "word"):
            raise QueryError(f"expected a value, found {v or 'the end'}")
        self.at += 1
        return v if k == "text" else int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d*\.\d+", v) else v

    def call(self) -> Call:
        name = self.take("word")
        args, options = [], []
        if self.peek() == ("mark", "("):
            self.take()
            while self.peek() != ("mark", ")"):
                if self.peek()[0] == "word" and self.peek(1) == ("op", "="):
                    key = self.take()
                    self.take()
                    options.append((key, self.value()))
                else:
                    args.append(self.value())
                if self.peek() == ("mark", ","):
                    self.take()
                elif self.peek() != ("mark", ")"):
                    raise QueryError("expected , or )")
            self.take()
        elif self.peek()[0] in ("text", "word") and not self.is_word("AND", "OR", "NOT"):
            args.append(self.value())
        return Call(name.lower(), tuple(args), tuple(options))

    def select(self) -> Select:
        self.take("word", "SELECT")
        target = self.take("word").lower()
        if self.is_word("IN"):
            self.take()
            inside = self.call()
            if inside.name != "subsystem" or len(inside.args) != 1:
                raise QueryError("expected subsystem(root)")
            return Select(target, (), str(inside.args[0]))
        found = []
        if self.is_word("WHERE"):
            self.take()
            found.append(self.condition())
            while self.is_word("AND") and self.peek(1)[0] == "word" and self.peek(1)[1].upper() not in ("NOT", "SELECT") and self.peek(2)[0] == "op":
                self.take()
                found.append(self.condition())
        return Select(target, tuple(found))

    def condition(self) -> Condition:
        name = self.take("word")
        k, v = self.peek()
        if (k, v) == ("mark", "("):
            self.take()
            value = self.value()
            self.take("mark", ")")
            return Condition(name, "()", value)
        if k == "op":
            self.take()
            return Condition(name, v, self.value())
        return Condition(name)


def parse(text: str):
    return Parser(text).parse()


def render(tree) -> str:
    """A normal form of a tree; equal queries have equal ones."""
    if isinstance(tree, Combine):
        return f"({render(tree.left)} {tree.op.upper()} {render(tree.right)})"
    if isinstance(tree, Complement):
        return f"(NOT {render(tree.of)})"
    if isinstance(tree, Call):
        return f"{tree.name}({', '.join([*map(repr, tree.args), *(f'{k}={v!r}' for k, v in sorted(tree.options))])})"
    where = " AND ".join(f"{c.name}{c.op}{c.value!r}" for c in tree.conditions)
    return f"SELECT {tree.target}" + (f" IN subsystem({tree.root!r})" if tree.root else f" WHERE {where}" if where else "")


COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
#: Tokens in an id by which a node without annotation has an architecture layer.
LAYER_TOKENS = (("controller", ("controller", "route", "handler")), ("service", ("service",)), ("repository", ("repository", "repo", "dao")), ("domain", ("domain", "model", "entity")))


@dataclass
class Engine:
    """Queries over a graph and, if given, tables of runtime edges, semantics, imports and rules.
    Answers are kept by the normal form of their query for the life of the engine."""

    graph: Graph
    runtime_edges: DataFrame | None = None
    semantics: DataFrame | None = None
    imports: DataFrame | None = None
    subsystem_modules: DataFrame | None = None
    forbidden: tuple = ()
    kept: dict = field(default_factory=dict)

    def run(self, text: str, limit: int | None = None) -> DataFrame:
        """One column, id, sorted and without repeats; the limit holds for the whole query."""
        out = self.bind(parse(text)).distinct().orderBy("id")
        return out if limit is None else out.limit(limit)

    def run_batch(self, texts: list[str]) -> dict[str, DataFrame | QueryError | PySparkException]:
        """Each query's answer or its error, also one that Spark finds in its plan."""
        out = {}
        for t in texts:
            try:
                out[t] = self.run(t)
            except (QueryError, PySparkException) as error:
                out[t] = error
        return out

    def bind(self, tree) -> DataFrame:
        key = render(tree)
        if key not in self.kept:
            self.kept[key] = self._bind(tree)
        return self.kept[key]

    def _bind(self, tree) -> DataFrame:
        if isinstance(tree, Combine):
            left, right = self.bind(tree.left), self.bind(tree.right)
            return left.intersect(right) if tree.op == "and" else left.union(right).distinct() if tree.op == "or" else left.subtract(right)
        if isinstance(tree, Complement):
            return self.graph.nodes.select("id").subtract(self.bind(tree.of))
        return self.call(tree) if isinstance(tree, Call) else self.select(tree)

    def one(self, call: Call) -> str:
        if not call.args:
            raise QueryError(f"{call.name} needs an argument")
        return str(call.args[0])

    def need(self, name: str) -> DataFrame:
        found = getattr(self, name)
        if found is None:
            raise QueryError(f"the graph has no {name}")
        return found

    def call(self, c: Call) -> DataFrame:
        g, depth = self.graph, c.option("depth")
        if depth is not None and (not isinstance(depth, int) or depth < 0):
            raise QueryError("depth must be a whole number")
        ids = lambda df, name="id": df.select(F.col(name).alias("id"))
        if c.name in ("callers", "callees"):
            return ids((traverse.callers if c.name == "callers" else traverse.callees)(g, self.one(c), depth or 1))
        if c.name == "dependencies":
            return ids(traverse.dependencies(g, self.one(c), depth))
        if c.name == "dependents":
            return ids(traverse.dependents(g, self.one(c), depth))
        if c.name == "path":
            if len(c.args) != 2:
                raise QueryError("path needs two arguments")
            return traverse.path(g, str(c.args[0]), str(c.args[1]), depth or 50).select(F.explode("path").alias("id"))
        if c.name == "orphans":
            return traverse.orphans(g, int(c.args[0]) if c.args else c.option("layer"))
        if c.name == "layer":
            return lookup.nodes_at_layer(g, int(self.one(c)))
        if c.name == "tests":
            return ids(lookup.tests_of(g, self.one(c)), "test_id")
        if c.name == "search":
            return lookup.search_nodes(g, self.one(c))
        if c.name == "impact":
            seeds = g.nodes.where(F.col("id") == self.one(c)).select(F.col("id").alias("node"))
            return ids(traverse.impacted_tests(g, seeds), "test_id")
        if c.name == "imports":
            found = traverse.reach(traverse.arcs(self.need("imports")), traverse.seeds_of(g.nodes.sparkSession, [self.one(c)]), depth)
            return ids(found, "node")
        if c.name in lookup.SEMANTIC_FILTERS:
            return ids(self.need("semantics").where(lookup.SEMANTIC_FILTERS[c.name]()))
        if c.name == "domain":
            return ids(self.need("semantics").where(lookup.has_tag(self.one(c))))
        if c.name == "actions":
            s = self.need("semantics")
            return ids(s.where(lookup.has_action(str(c.args[0])) if c.args else F.size("actions") > 0))
        if c.name == "subsystem":
            return ids(traverse.subsystem_slice(g, self.one(c)))
        raise QueryError(f"unknown function {c.name}")

    def layered(self) -> DataFrame:
        low = F.lower("id")
        guess = F.coalesce(*(F.when(low.rlike("|".join(words)), layer) for layer, words in LAYER_TOKENS), F.lit(""))
        return self.graph.described().withColumn("in_layer", F.when(F.col("arch_layer") != "", F.col("arch_layer")).otherwise(guess))

    def select(self, s: Select) -> DataFrame:
        g = self.graph
        conditions = {c.name.lower(): c for c in s.conditions}

        def given(name: str, default=None):
            return str(conditions[name].value) if name in conditions else default

        if s.root is not None:
            inside = traverse.subsystem_slice(g, s.root).select("id")
            if s.target == "nodes":
                return inside
            if s.target == "cycles":
                e = g.edges.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi")
                return self.cycle_names(Graph(g.nodes.join(inside, "id", "left_semi"), e))
            raise QueryError(f"cannot select {s.target} in a subsystem")
        if s.target == "services":
            wanted = lookup.resolve(g, given("depends_on", ""))
            seeds = wanted.select(F.col("id").alias("origin"), F.col("id").alias("node"))
            reached = traverse.reach(traverse.arcs(g.edges, reverse=True), seeds).select(F.col("node").alias("id")).distinct()
            return self.graph.described().where((F.col("arch_layer") == "service") | F.col("id").endswith("Service")).join(reached, "id", "left_semi").select("id")
        if s.target == "frontend_components":
            route = given("calls_api", "")
            calls = self.need("runtime_edges").where(F.col("edge_type").isin("fetch", "axios", "http_call", "frontend_to_backend") & F.col("target").contains(route))
            files = calls.select(F.col("source_file").alias("file")).distinct()
            return g.nodes.where(F.lower("file").rlike(r"frontend|component|\.(tsx|jsx|vue)$")).join(files, "file", "left_semi").select("id")
        if s.target == "modules":
            return self.layered().where(F.col("in_layer") == given("in_layer", "service")).select("id")
        if s.target == "cycles":
            layer = given("in_layer")
            if layer is None:
                return self.cycle_names(g)
            inside = self.layered().where(F.col("in_layer") == layer).select("id")
            e = g.edges.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi")
            return self.cycle_names(Graph(g.nodes.join(inside, "id", "left_semi"), e))
        if s.target == "events":
            kinds = ("event", "event_produce", "mq_publish", "websocket_event")
            return self.need("runtime_edges").where(F.col("edge_type").isin(*kinds) & F.col("source_node").contains(given("produced_by", ""))).select(F.concat_ws(" -> ", "source_node", "target").alias("id"))
        if s.target == "smells":
            found = metrics.architecture_smells(g, list(self.forbidden))
            kind = given("type")
            return (found if kind is None else found.where(F.col("smell") == kind)).select(F.concat_ws(": ", "smell", "subject").alias("id"))
        if s.target == "violations":
            found = policy.layer_violations(g)
            for c in s.conditions:
                column = {"source": "source", "target": "target", "layer": "s_layer"}.get(c.name)
                if column is None or c.op not in COMPARE:
                    raise QueryError(f"violations have no {c.name}")
                found = found.where(COMPARE[c.op](F.col(column), F.lit(c.value)))
            return found.select(F.concat_ws(" -> ", "source", "target").alias("id"))
        if s.target == "subsystems":
            found = metrics.subsystem_graph(g, metrics.infer_subsystem("file"))
            for c in s.conditions:
                if c.name not in found.columns or c.op not in COMPARE:
                    raise QueryError(f"subsystems have no {c.name}")
                found = found.where(COMPARE[c.op](F.col(c.name), F.lit(c.value)))
            return found.select(F.col("subsystem").alias("id"))
        if s.target == "nodes":
            found = self.layered().join(metrics.degrees(g), "id")
            if "drift" in conditions:
                drift = policy.layer_violations(g)
                c = conditions["drift"]
                score = drift.agg((F.count("*")).alias("v")).crossJoin(g.edges.select("source", "target").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))).select((F.col("v") / F.col("n")).alias("drift"))
                ends = drift.select(F.explode(F.array("source", "target")).alias("id")).distinct()
                found = found.join(ends, "id", "left_semi").crossJoin(F.broadcast(score))  # one row
                if c.op not in COMPARE:
                    raise QueryError("drift needs a comparison")
            for c in s.conditions:
                if c.name not in found.columns:
                    raise QueryError(f"nodes have no {c.name}")
                if c.op in COMPARE:
                    found = found.where(COMPARE[c.op](F.col(c.name), F.lit(c.value)))
                elif c.op == "()":
                    found = found.where(lookup.matches(c.name, str(c.value)))
                else:
                    found = found.where(F.col(c.name).cast("string").isNotNull() & (F.col(c.name).cast("string") != ""))
            return found.select("id")
        raise QueryError(f"unknown target {s.target}")

    def cycle_names(self, graph: Graph) -> DataFrame:
        """Cycles as ``a -> b -> a``, self-loops among them, a hundred at most."""
        found = components.cycles(graph, self_loops=True)
        return found.select(F.concat_ws(" -> ", "members", "cycle_id").alias("id")).limit(100)
