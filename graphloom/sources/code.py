"""Source code as a graph: files are scanned by Spark, parsed in batches, and calls resolved by joins.

A parser takes (path, text) and returns rows of kind, values; parsers are registered by extension.
Python files go through the ast module, JavaScript and TypeScript through patterns.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.lookup import glob_regex

from .ignore import kept, read_rules

SCHEMA = "kind string, id string, file string, type string, line int, body_hash string, name string, detail string"
PARSERS: dict[str, Callable[[str, str], list[tuple]]] = {}
#: Fixed value: folders that are never scanned.
SKIPPED = r"(^|/)(\.[^/]+|node_modules|venv|__pycache__)(/|$)"


def parser(*extensions: str):
    """Registers a parser for files with these extensions."""

    def register(run):
        PARSERS.update({e: run for e in extensions})
        return run

    return register


def scan(spark: SparkSession, root: str, ignore: list[str] = (), gitignore: bool = True) -> DataFrame:
    """(path, content) of text files under a folder, paths relative to it, without skipped folders and
    those that the project's ``.gitignore`` files or an ignore glob leave out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    top = root.rstrip("/").split("/")[-1]
    path = F.regexp_extract(F.col("_metadata.file_path"), rf"/{re.escape(top)}/(.*)$", 1)
    out = files.select(path.alias("path"), F.col("value").alias("content"))
    out = out.where(~F.col("path").rlike(SKIPPED))
    if gitignore:
        out = kept(out, read_rules(spark, root))
    for pattern in ignore:
        inner = glob_regex(pattern.rstrip("/"))[5:-1]
        out = out.where(~F.col("path").rlike(f"(^|/){inner}(/|$)"))
    return out


class _Python(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.rows, self.stack, self.imports = path, [], [], {}

    @property
    def scope(self) -> str:
        return "::".join([self.path, *self.stack])

    def _define(self, node, kind: str) -> None:
        body = [n for n in node.body if not (isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) and n is node.body[0])]
        digest = hashlib.sha256("".join(ast.dump(n) for n in body).encode()).hexdigest()
        method = kind == "function" and bool(self.kinds) and self.kinds[-1] == "class"
        self.stack.append(node.name)
        self.rows.append(("node", self.scope, self.path, "method" if method else kind, node.lineno, digest, node.name, ""))
        self.kinds.append(kind)
        self.generic_visit(node)
        self.kinds.pop()
        self.stack.pop()

    kinds: list[str]

    def visit_Module(self, node) -> None:
        self.kinds = []
        module = re.sub(r"(/__init__)?\.py$", "", self.path)
        self.rows.append(("node", module, self.path, "module", 1, hashlib.sha256(ast.dump(node).encode()).hexdigest(), module.split("/")[-1], ""))
        self.generic_visit(node)

    def visit_FunctionDef(self, node) -> None:
        self._define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self._define(node, "class")

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.rows.append(("import", self.scope, self.path, "", node.lineno, "", a.asname or a.name.split(".")[0], a.name))

    def visit_ImportFrom(self, node) -> None:
        for a in node.names:
            self.rows.append(("import", self.scope, self.path, "", node.lineno, "", a.asname or a.name, f"{'.' * node.level}{node.module or ''}:{a.name}"))

    def visit_Assign(self, node) -> None:
        if not self.stack:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.rows.append(("global", self.scope, self.path, "constant" if t.id.isupper() else "variable", node.lineno, "", t.id, ""))
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            kind, name, on = ("dynamic" if f.id == "getattr" else "name"), f.id, ""
        elif isinstance(f, ast.Attribute):
            on = f.value.id if isinstance(f.value, ast.Name) else "super" if isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name) and f.value.func.id == "super" else ""
            kind, name = "attribute", f.attr
        else:
            kind, name, on = "dynamic", "*", ""
        self.rows.append(("call", self.scope, self.path, kind, node.lineno, "", name, on))
        self.generic_visit(node)


@parser("py")
def parse_python(path: str, text: str) -> list[tuple]:
    visitor = _Python(path)
    visitor.visit(ast.parse(text))
    return visitor.rows


JS_FUNCTION = re.compile(r"(?:^|\n)\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)|(?:^|\n)\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>|(?:^|\n)\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)")
JS_CALL = re.compile(r"(?<![\w.])(?:(\w+)\.)?(\w+)\s*\(")
JS_IMPORT = re.compile(r"import\s+(?:([\w*]+)|\{([^}]*)\})\s*(?:as\s+\w+\s+)?from\s+['\"]([^'\"]+)['\"]")
JS_WORDS = {"if", "for", "while", "switch", "return", "function", "catch", "typeof", "await", "new", "import", "super"}


@parser("js", "jsx", "ts", "tsx")
def parse_javascript(path: str, text: str) -> list[tuple]:
    line = lambda at: text.count("\n", 0, at) + 1
    module = re.sub(r"\.\w+$", "", path)
    rows = [("node", module, path, "module", 1, hashlib.sha256(text.encode()).hexdigest(), module.split("/")[-1], "")]
    found = [(m.end(), next(g for g in m.groups() if g), "class" if m[3] else "function") for m in JS_FUNCTION.finditer(text)]
    for i, (at, name, kind) in enumerate(found):
        body = text[at : found[i + 1][0] if i + 1 < len(found) else len(text)]
        own = f"{path}::{name}"
        rows.append(("node", own, path, kind, line(at), hashlib.sha256(body.encode()).hexdigest(), name, ""))
        rows += [("call", own, path, "attribute" if m[1] else "name", line(at + m.start()), "", m[2], m[1] or "") for m in JS_CALL.finditer(body) if m[2] not in JS_WORDS]
    for m in JS_IMPORT.finditer(text):
        names = [m[1]] if m[1] else [n.split(" as ")[-1].strip() for n in m[2].split(",") if n.strip()]
        rows += [("import", path, path, "", line(m.start()), "", n, f"{m[3]}:{n}") for n in names]
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Rows of nodes, calls, imports, globals and errors of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, text in zip(pdf["path"], pdf["content"], strict=True):
                parse = PARSERS.get(path.rsplit(".", 1)[-1])
                if parse is None:
                    continue
                try:
                    rows += parse(path, text or "")
                except (SyntaxError, ValueError, RecursionError) as error:
                    rows.append(("error", path, path, type(error).__name__, 0, "", "", str(error)[:200]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def resolve_calls(rows: DataFrame) -> DataFrame:
    """Edges (source, target, edge_type, confidence) of calls. Candidates are tried in order: a method of
    the same class through self, a function in the same scope, one in the same file, one by import, and
    the only method of that name; the first by priority, then by id, is taken. super calls have none."""
    nodes = rows.where("kind = 'node'").select(F.col("id").alias("target"), "name", F.col("file").alias("t_file"), "type")
    calls = rows.where("kind = 'call'").select(F.col("id").alias("source"), "file", F.col("type").alias("how"), "name", F.col("detail").alias("on"), "line")
    calls = calls.where("`on` <> 'super'").withColumn("owner", F.regexp_extract("source", r"(?s)^(.*)::[^:]+$", 1))
    same_file = calls.join(nodes, "name").where("t_file = file")
    by_self = same_file.where("`on` in ('self', 'cls', 'this')").where(F.col("target") == F.concat_ws("::", "owner", "name")).withColumn("p", F.lit(1))
    in_scope = same_file.where("how = 'name'").where((F.col("target") == F.concat_ws("::", "source", "name")) | (F.col("target") == F.concat_ws("::", "owner", "name"))).withColumn("p", F.lit(2))
    in_file = same_file.where("how = 'name' and type <> 'method'").withColumn("p", F.lit(3))
    imports = rows.where("kind = 'import'").select("file", F.col("name").alias("alias"), F.split_part("detail", F.lit(":"), F.lit(1)).alias("module"), F.split_part("detail", F.lit(":"), F.lit(2)).alias("real"))
    tail = F.regexp_replace(F.regexp_replace("module", r"^[./]+", ""), r"\.", "/")
    imports = imports.withColumn("module_path", tail)
    direct = calls.where("how = 'name'").join(imports, ["file"]).where(F.col("alias") == F.col("name"))
    direct = direct.withColumn("wanted", F.when(F.col("real") != "", F.col("real")).otherwise(F.col("name")))
    through = calls.where("how = 'attribute'").join(imports, ["file"]).where(F.col("alias") == F.col("on")).withColumn("wanted", F.col("name"))
    targets = nodes.select(F.col("target"), F.col("name").alias("wanted"), F.regexp_replace("t_file", r"(/__init__)?\.\w+$", "").alias("t_module"))
    fits = (F.col("module_path") != "") & (F.col("t_module").endswith(F.col("module_path")) | F.concat(F.col("module_path"), F.lit("/"), F.col("real")).endswith(F.col("t_module")))
    by_import = direct.unionByName(through).join(targets, "wanted").where(fits).withColumn("p", F.lit(4))
    only = nodes.where("type = 'method'").groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    by_name = calls.where("how = 'attribute'").join(only, "name").withColumn("p", F.lit(5))
    key = ["source", "name", "on", "line"]
    every = by_self.select(*key, "target", "p")
    for part in (in_scope, in_file, by_import, by_name):
        every = every.unionByName(part.select(*key, "target", "p"))
    w = Window.partitionBy(*key).orderBy("p", "target")
    best = every.withColumn("r", F.row_number().over(w)).where("r = 1")
    edges = best.select("source", "target", F.lit("call").alias("edge_type"), F.lit("static").alias("confidence"))
    loose = rows.where("kind = 'call' and type = 'dynamic'").select(F.col("id").alias("source"), F.concat("file", F.lit("::*")).alias("target"), F.lit("dynamic").alias("edge_type"), F.lit("ai_inferred").alias("confidence"))
    return edges.unionByName(loose).distinct()


def graph_of(files: DataFrame) -> Graph:
    rows = extract(files)
    nodes = rows.where("kind = 'node'").select("id", "file", "type", "line", "body_hash")
    return Graph(nodes, resolve_calls(rows))


def imports_of(rows: DataFrame) -> DataFrame:
    """(source, target, name) of imports, by file and module path."""
    module = F.regexp_replace(F.regexp_replace(F.split_part("detail", F.lit(":"), F.lit(1)), r"^[./]+", ""), r"\.", "/")
    return rows.where("kind = 'import'").select(F.col("file").alias("source"), module.alias("target"), "name")


#: Patterns of HTTP routes; the groups are the path.
ROUTES = r"@\w+\.(?:route|get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]|(?:app|router)\.(?:get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)['\"`]"

def routes(files: DataFrame) -> DataFrame:
    """(file, route) of declared HTTP routes."""
    each = F.explode(F.concat(F.regexp_extract_all("content", F.lit(ROUTES), F.lit(1)), F.regexp_extract_all("content", F.lit(ROUTES), F.lit(2))))
    return files.select(F.col("path").alias("file"), each.alias("route")).where("route <> ''").distinct()


def normal_route(route: Column | str) -> Column:
    """A route in which parameters of any syntax are ``{}`` and a last slash is gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(route, r"\$?\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*", "{}"), r"^https?://[^/]+", ""), r"(?<=.)/$", "")


def route_shape(route: Column | str) -> Column:
    """The segments of a normal route."""
    return F.split(F.regexp_replace(normal_route(route), r"^/", ""), "/")


def route_links(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """(source_file, target_file, route, kind): calls(source_file, target) joined to routes: exact, else
    equal in normal form, else with values in the places of parameters. Routes are joined by their
    number of segments and first fixed one, and compared segment by segment."""
    named = lambda x: F.filter(x, lambda s: s != "{}")
    c, d = calls.withColumn("c", route_shape("target")), declared.withColumn("d", route_shape("route"))
    same = c.join(d.withColumn("c", F.col("d")), "c").withColumn("kind", F.when(F.col("target") == F.col("route"), 0).otherwise(1))
    keyed = d.where(F.exists("d", lambda s: s == "{}")).withColumns({"n": F.size("d"), "key": F.coalesce(F.get(named(F.col("d")), F.lit(0)), F.lit(""))})
    parts = c.withColumn("n", F.size("c")).withColumn("key", F.explode(F.array_distinct(F.concat(F.col("c"), F.array(F.lit(""))))))
    fits = F.forall(F.zip_with("c", "d", lambda x, y: (x == y) | (y == "{}")), lambda ok: ok) & (F.col("c") != F.col("d"))
    filled = parts.join(keyed, ["n", "key"]).where(fits).withColumn("kind", F.lit(2))
    columns = ["source_file", "target", F.col("file").alias("target_file"), "route", "kind"]
    j = same.select(*columns).unionByName(filled.select(*columns))
    w = Window.partitionBy("source_file", "target").orderBy("kind", "target_file", "route")
    best = j.withColumn("r", F.row_number().over(w)).where("r = 1")
    kind = F.element_at(F.array(F.lit("exact"), F.lit("normalised"), F.lit("parameter")), F.col("kind") + 1)
    return best.select("source_file", "target_file", "route", kind.alias("kind"))


#: Files that name packages, and the pattern of a package in each.
BUILD_FILES = (("requirements.txt", r"(?m)^([A-Za-z0-9_.\-]+)\s*(?:[=<>~!]=?.*)?$"), ("package.json", r'"([@\w/.\-]+)"\s*:\s*"[\^~]?\d'), ("Dockerfile", r"(?m)^FROM\s+(\S+)"))


def build_edges(files: DataFrame) -> DataFrame:
    """(source, target, edge_type) from build files to what they name."""
    out = None
    for name, pattern in BUILD_FILES:
        found = files.where(F.col("path").endswith(name)).select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("target"), F.lit("build").alias("edge_type"))
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def covered_nodes(coverage: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): nodes one of whose lines ran, for coverage(file, executed_lines) with paths that end with the
    file of the node; a node ends where the next one of its file begins."""
    end = F.lead("line").over(Window.partitionBy("file").orderBy("line", "id"))
    spans = nodes.where("type <> 'module'").select("id", F.col("file").alias("node_file"), "line", F.coalesce(end - 1, F.lit(1 << 30)).alias("last"), F.element_at(F.split("file", "/"), -1).alias("base"))
    lines = coverage.select("file", F.element_at(F.split("file", "/"), -1).alias("base"), F.explode("executed_lines").alias("ran"))
    return lines.join(spans, "base").where(F.col("file").endswith(F.col("node_file")) & F.col("ran").between(F.col("line"), F.col("last"))).select("id").distinct()
