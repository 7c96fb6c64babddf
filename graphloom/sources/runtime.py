"""Runtime interactions in source code: what a function sends to, reads from or waits for.

Python is parsed; a call is held against RULES by the name of its method and what it is called on, and
belongs to the innermost function around it. JavaScript and TypeScript go through patterns, a file being
the source. Files that do not parse have no interactions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "source_file string, source_node string, edge_type string, target string, details map<string,string>"


def _constant(call: ast.Call) -> str | None:
    return str(call.args[0].value) if call.args and isinstance(call.args[0], ast.Constant) else None


def first_argument(call: ast.Call) -> str:
    return _constant(call) or "<dynamic>"


def sql_table(call: ast.Call) -> str:
    """The first table that an SQL text names, else the beginning of the text."""
    text = _constant(call)
    if text is None:
        return "<dynamic>"
    named = re.search(r"\b(?:from|into|update|join)\s+(\w+)", text, re.IGNORECASE)
    return named[1] if named else text[:80]


def channel(call: ast.Call) -> str:
    """The queue, topic, key or exchange given by name."""
    return next((str(k.value.value) for k in call.keywords if k.arg in ("queue", "topic", "routing_key", "exchange") and isinstance(k.value, ast.Constant)), "<dynamic>")


@dataclass(frozen=True)
class Rule:
    """Calls of ``methods`` are interactions of ``kinds``. ``on`` looks for words in what the method is
    called on, ``only`` wants its last name to be one of some, ``never`` rules names out."""

    kinds: tuple[str, ...]
    methods: tuple[str, ...]
    target: Callable[[ast.Call], str]
    on: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


#: Methods of runtime interactions by kind.
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
DB_METHODS = ("execute", "executemany", "fetchone", "fetchall", "fetchmany", "cursor", "query")
MQ_PUBLISH_METHODS = ("publish", "basic_publish")
MQ_SUBSCRIBE_METHODS = ("subscribe", "send_message", "receive_message", "basic_consume")
EVENT_METHODS = ("emit", "publish", "dispatch", "dispatch_event", "send_event", "socket_emit")
EVENT_CONSUMER_METHODS = ("subscribe", "on", "add_listener", "consume_event", "handle_event")
QUEUE_METHODS = ("enqueue", "dequeue", "put", "get")
WORKER_METHODS = ("delay", "apply_async")
RPC_METHODS = ("rpc_call", "call", "invoke", "request")
WEBSOCKET_METHODS = ("send", "send_json", "send_text")
ASYNC_METHODS = ("create_task", "gather", "wait", "wait_for")

RULES = (
    Rule(("http_call",), HTTP_METHODS, first_argument, never=("environ", "os", "dict", "self")),
    Rule(("db_query",), DB_METHODS, sql_table),
    Rule(("mq_publish", "event_produce"), MQ_PUBLISH_METHODS, channel),
    Rule(("mq_subscribe",), MQ_SUBSCRIBE_METHODS, channel),
    Rule(("event_produce",), EVENT_METHODS, first_argument),
    Rule(("event_consume",), EVENT_CONSUMER_METHODS, first_argument),
    Rule(("queue", "queue_task"), QUEUE_METHODS, lambda c: _constant(c) or "<runtime>", on=("queue", "celery", "broker", "channel", "worker")),
    Rule(("worker", "queue_task"), WORKER_METHODS, lambda c: _constant(c) or "<runtime>"),
    Rule(("rpc_call",), RPC_METHODS, lambda c: "<rpc>", only=("grpc", "rpc", "client", "stub", "channel")),
    Rule(("websocket_event",), WEBSOCKET_METHODS, first_argument, on=("socket", "ws")),
    Rule(("websocket_event",), ("emit",), first_argument),
    Rule(("async_workflow",), ASYNC_METHODS, lambda c: c.func.attr.lower(), only=("asyncio",)),
)
#: Patterns of calls in JavaScript by kind; the group is the target.
SCRIPT_PATTERNS = (
    ("fetch", re.compile(r"\bfetch\(\s*['\"`]([^'\"`]+)['\"`]")),
    ("axios", re.compile(r"\baxios(?:\.\w+)?\(\s*['\"`]([^'\"`]+)['\"`]")),
    ("websocket_event", re.compile(r"\bsocket\.(?:on|emit)\(\s*['\"`]([^'\"`]+)['\"`]")),
)


def _last_name(node: ast.expr) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def interactions(call: ast.Call) -> Iterator[tuple[str, str]]:
    """(kind, target) of what a call does."""
    if not isinstance(call.func, ast.Attribute):
        return
    method, receiver = call.func.attr.lower(), call.func.value
    name, whole = _last_name(receiver).lower(), ast.unparse(receiver).lower()
    if (whole, method) in (("os", "getenv"), ("os.environ", "get")):
        if _constant(call):
            yield "env_var", _constant(call)
        return
    for rule in RULES:
        if method not in rule.methods or name in rule.never or (rule.only and name not in rule.only):
            continue
        if rule.on and not any(w in whole for w in rule.on):
            continue
        for kind in rule.kinds:
            yield kind, rule.target(call)


def of_python(path: str, text: str) -> Iterator[tuple[str, str, str, str]]:
    """(source node, kind, target, operation) of the calls of a module, in the order of a stack."""
    todo: list[tuple[ast.AST, str, str]] = [(ast.parse(text), "", "<module>")]
    while todo:
        node, owner, function = todo.pop()
        if isinstance(node, ast.ClassDef):
            owner = node.name
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            function = node.name
        elif isinstance(node, ast.Call):
            for kind, target in interactions(node):
                yield "::".join(x for x in (path, owner, function) if x), kind, target, node.func.attr
        elif isinstance(node, ast.Subscript) and ast.unparse(node.value) == "os.environ" and isinstance(node.slice, ast.Constant):
            yield "::".join(x for x in (path, owner, function) if x), "env_var", str(node.slice.value), "environ"
        todo += [(child, owner, function) for child in ast.iter_child_nodes(node)]


def of_script(path: str, text: str) -> Iterator[tuple[str, str, str, str]]:
    for kind, pattern in SCRIPT_PATTERNS:
        for found in pattern.finditer(text):
            yield path, kind, found[1], kind


READERS = {"py": of_python, "js": of_script, "jsx": of_script, "ts": of_script, "tsx": of_script}


def runtime_edges(files: DataFrame) -> DataFrame:
    """(source_file, source_node, edge_type, target, details) of files (path, content), one row for each
    different interaction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["content"], strict=True):
                read = READERS.get(path.rsplit(".", 1)[-1])
                try:
                    found = list(read(path, text or "")) if read else []
                except (SyntaxError, ValueError, RecursionError):
                    found = []
                rows += [(path, node, kind, target, {"operation": operation}) for node, kind, target, operation in dict.fromkeys(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)
