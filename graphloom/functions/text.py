"""Column functions over names, paths and source text: layers, verbs, effects, tags, contracts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs and the kind of action that a name beginning with them stands for, tried in order.
VERBS = {
    "read": ("get", "fetch", "load", "read", "find", "lookup", "search"),
    "query": ("query", "select"),
    "write": ("set", "put", "save", "store", "write", "insert"),
    "create": ("create", "add", "new", "build", "make", "init", "initialize"),
    "delete": ("delete", "remove", "drop", "destroy", "clear"),
    "update": ("update", "modify", "patch", "change", "edit"),
    "validate": ("validate", "check", "verify", "assert", "ensure", "is_valid"),
    "transform": ("transform", "convert", "map"),
    "parse": ("parse", "decode", "deserialize"),
    "format": ("format", "encode", "serialize", "render"),
    "send": ("send", "post", "publish", "emit"),
    "dispatch": ("dispatch", "notify"),
    "receive": ("receive", "consume"),
    "subscribe": ("subscribe", "listen"),
    "compute": ("compute", "calculate", "process", "run", "execute"),
    "authorize": ("authorize", "authenticate", "login", "permit"),
    "log": ("log",),
    "configure": ("configure", "setup"),
    "cache": ("cache", "memoize"),
    "retry": ("retry",),
}
#: Patterns in source text, the side effect that each shows, and what it is called.
EFFECTS = (
    (r"\.execute\(", "database_write", "SQL execute"),
    (r"\.executemany\(", "database_write", "SQL executemany"),
    (r"\.commit\(", "database_write", "DB commit"),
    (r"\.cursor\(", "database_read", "DB cursor"),
    (r"session\.(add|delete|merge|flush)", "database_write", "ORM write"),
    (r"session\.query", "database_read", "ORM query"),
    (r"requests\.(get|post|put|delete|patch|head)", "network_call", "HTTP request"),
    (r"httpx\.", "network_call", "HTTP request"),
    (r"urllib", "network_call", "URL request"),
    (r"aiohttp", "network_call", "Async HTTP"),
    (r"socket\.", "network_call", "Socket"),
    (r"open\(", "file_write", "File open"),
    (r"\.write\(", "file_write", "File write"),
    (r"\.read\(", "file_read", "File read"),
    (r"Path\(.*\)\.(write_text|write_bytes)", "file_write", "Path write"),
    (r"Path\(.*\)\.(read_text|read_bytes)", "file_read", "Path read"),
    (r"shutil\.", "file_write", "File copy/move"),
    (r"os\.(remove|unlink|rmdir|makedirs|rename)", "file_write", "OS file op"),
    (r"subprocess\.", "process_spawn", "Subprocess"),
    (r"os\.system\(", "process_spawn", "OS system call"),
    (r"os\.exec", "process_spawn", "OS exec"),
    (r"os\.environ", "environment_read", "Env var access"),
    (r"os\.getenv", "environment_read", "Env var read"),
    (r"logger\.", "logging", "Logging"),
    (r"logging\.", "logging", "Logging"),
    (r"print\(", "logging", "Print output"),
    (r"cache\.(get|set|delete|clear)", "cache_write", "Cache op"),
    (r"@(lru_cache|cache|cached)", "cache_read", "Cache decorator"),
    (r"\.(publish|send_message|enqueue)", "message_publish", "Message publish"),
    (r"\.(subscribe|consume|dequeue)", "message_consume", "Message consume"),
)
#: Words in a name or path and the domain that each shows.
DOMAINS = {
    "auth": ("auth", "login", "logout", "permission", "role", "token", "jwt", "oauth", "session"),
    "database": ("db", "database", "sql", "query", "migration", "orm", "model", "repository"),
    "api": ("api", "endpoint", "route", "handler", "controller", "rest", "graphql"),
    "ui": ("ui", "view", "template", "render", "component", "widget", "form", "page"),
    "config": ("config", "setting", "environment", "option", "preference"),
    "logging": ("log", "logger", "audit", "trace", "monitor", "metric"),
    "testing": ("test", "fixture", "mock", "stub", "assert", "expect"),
    "io": ("file", "path", "stream", "read", "write", "download", "upload"),
    "network": ("http", "request", "response", "socket", "url", "client"),
    "serialization": ("json", "xml", "yaml", "csv", "serialize", "deserialize", "parse", "encode"),
    "security": ("encrypt", "decrypt", "hash", "sign", "verify", "sanitize", "escape"),
    "cache": ("cache", "memoize", "ttl", "invalidate"),
    "messaging": ("queue", "message", "event", "publish", "subscribe", "notification"),
    "scheduling": ("schedule", "cron", "task", "job", "worker", "celery"),
    "validation": ("validate", "schema", "constraint", "rule", "check"),
}
#: Words that make an intent vague.
VAGUE = r"(?i)\b(helper|utility|misc|stuff|data processing|wrapper|handle|do)\b"
SQL_OPERATIONS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")


def action_of(name: Column | str) -> Column:
    """The kind of action by the first verb that the name begins with, leading underscores aside."""
    low = F.regexp_replace(F.lower(name), "^_+", "")
    return F.coalesce(*(F.when(low.startswith(v), kind) for kind, verbs in VERBS.items() for v in verbs), F.lit("unknown"))


def _where(pairs) -> Column:
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in pairs)))


def effect_rows(source: Column | str) -> Column:
    """(effect_type, target, description) of the side effects in a source, each kind and name once; the
    target is the text that shows it, up to 50 characters."""
    text = F.col(source) if isinstance(source, str) else source
    rows, before = [], {}
    for pattern, kind, name in EFFECTS:
        hit = text.rlike(pattern)
        for earlier in before.setdefault((kind, name), []):
            hit = hit & ~text.rlike(earlier)
        before[kind, name].append(pattern)
        rows.append(F.when(hit, F.struct(F.lit(kind).alias("effect_type"), F.substring(F.regexp_extract(text, pattern, 0), 1, 50).alias("target"), F.lit(name).alias("description"))))
    return F.array_compact(F.array(*rows))


def effects_of(source: Column | str) -> Column:
    """The kinds of side effects in a source."""
    return F.array_distinct(F.transform(effect_rows(source), lambda e: e["effect_type"]))


def domains_of(text: Column | str) -> Column:
    return domains_in(F.lower(text))


def domains_in(low: Column | str) -> Column:
    """The domains whose words, which are plain letters, a text in lower case contains; words that contain
    another of the same domain decide nothing. Long texts are put in lower case in a step before, as every
    use here would do it again."""
    at = F.col(low) if isinstance(low, str) else low
    fewest = {k: [w for w in words if not any(x in w for x in words if x != w)] for k, words in DOMAINS.items()}
    return _where((k, reduce(or_, (at.contains(w) for w in words))) for k, words in fewest.items())


def sql_operations_of(source: Column | str) -> Column:
    text = F.col(source) if isinstance(source, str) else source
    return _where((op, text.rlike(rf"(?i)\b{op}\s+")) for op in SQL_OPERATIONS)


def behaviour_hash(*parts: Column) -> Column:
    """A hash of arrays that does not depend on the order in them."""
    return F.sha2(F.array_join(F.array_sort(F.concat(*parts)), "|"), 256)


def semantic_confidence(actions: Column, guards: Column, effects: Column, flow: Column) -> Column:
    known = F.exists(actions, lambda a: a != "unknown")
    score = F.when(F.size(actions) > 0, F.when(known, 0.3).otherwise(0.1)).otherwise(0.0) + F.when(F.size(guards) > 0, 0.2).otherwise(0.0) + F.when(F.size(effects) > 0, 0.2).otherwise(0.0) + F.when(flow, 0.3).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def intent_quality(intent: Column | str) -> Column:
    """fail for none, warn for a short or vague one, else ok."""
    text = F.trim(intent)
    few = (F.length(text) < 10) | (F.size(F.split(text, r"\s+")) < 3)
    return F.when(F.coalesce(text, F.lit("")) == "", "fail").when(few | text.rlike(VAGUE), "warn").otherwise("ok")


def layer_of_path(path: Column | str, internal: list[str] = ()) -> Column:
    """1 for installed packages, 2 for internal libraries, 4 for tests, else 3."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(p, "/"), -1)
    own = F.lit(False)
    for prefix in internal:
        own = own | p.startswith(prefix)
    test = name.startswith("test_") | (name == "conftest.py") | name.endswith("_test.py") | F.lower(p).rlike(r"(^|/)tests?/")
    return F.when(p.rlike(r"(site|dist)-packages"), 1).when(own, 2).when(test, 4).otherwise(3)


def contract_name(name: Column | str) -> Column:
    """A type name without the suffixes of its layer, in lower case."""
    return F.lower(F.regexp_replace(name, r"(DTO|Dto|Model|Schema)$", ""))


def normal_module(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\.py$", ""), r"[/\\]", ".")


def host_of(url: Column | str) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def table_names(sql: Column | str) -> Column:
    """Words after FROM, INTO, UPDATE and JOIN."""
    return F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:from|into|update|join)\s+([\w.]+)"), F.lit(1))
