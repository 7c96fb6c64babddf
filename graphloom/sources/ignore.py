"""Which paths of a project are its own: the rules of its ``.gitignore`` files as column expressions.

Rules are ordered, the last that matches decides, ``!`` takes back, and what lies in an ignored folder is
ignored whatever later rules say. A rule with a slash inside or in front counts from the folder of its
file, others at any depth below it; one that ends with a slash is for folders only. ``*`` and ``?`` do not
cross slashes, ``**`` does. Files deeper in the tree come later, so their rules decide. Brackets are plain
characters and case matters. Rules are few and become regular expressions of the plan; paths are judged
where they are listed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import file_system, read_text

#: Folders below the root in which rule files are looked for.
DEEPEST = 8


@dataclass(frozen=True)
class Rule:
    regex: str
    folders_only: bool
    negated: bool


def glob_part(glob: str, crosses: bool) -> str:
    """A regular expression for a glob; ``crosses`` says whether ``**`` may hold slashes."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and crosses:
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + (".*" if crosses else "[^/]*"), i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.sub(r"([^\w\s])", r"\\\1", glob[i])
            i += 1
    return out


def parse_rules(text: str, folder: str = "") -> list[Rule]:
    """The rules of a file in a folder, which is given as ``a/b/`` from the root, or empty."""
    rules = []
    for line in map(str.strip, text.splitlines()):
        negated = line.startswith("!")
        body = line[negated:]
        glob = body.rstrip("/")
        anchored = "/" in glob
        glob = glob.lstrip("/")
        if glob and not line.startswith("#"):
            below = re.sub(r"([^\w\s])", r"\\\1", folder)
            rules.append(Rule(f"(?s)^{below}{'' if anchored else '(?:.*/)?'}{glob_part(glob, anchored)}$", body.endswith("/"), negated))
    return rules


def read_rules(spark: SparkSession, root: str) -> list[Rule]:
    """The rules of all ``.gitignore`` files under a folder, outermost first. Spark's own listings pass
    over names that begin with a dot, so they are asked for by name."""
    found = []
    for depth in range(DEEPEST + 1):
        fs, where = file_system(spark, root.rstrip("/") + "/*" * depth + "/.gitignore")
        found += [str(s.getPath().toString()) for s in fs.globStatus(where) or []]
    fs, top = file_system(spark, root)
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    rules = []
    for path in sorted(found, key=lambda p: (p.count("/"), p)):
        rules += parse_rules(read_text(spark, path), path[path.index(base) + len(base) :].removesuffix(".gitignore"))
    return rules


def _last_word(path: Column, folder: Column, rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        hit = path.rlike(r.regex)
        out = F.when(hit & folder if r.folders_only else hit, F.lit(not r.negated)).otherwise(out)
    return out


def ignored(path: Column, rules: list[Rule], folder: Column | None = None) -> Column:
    """True for paths from the root that the rules, or those of a folder above, leave out; ``folder`` is
    true for paths of folders. Null for null paths."""
    folder = F.lit(False) if folder is None else folder
    if not rules:
        return F.when(path.isNotNull(), F.lit(False))
    parts = F.split(path, "/")
    above = F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = F.exists(above, lambda p: _last_word(p, F.lit(True), rules))
    return F.when(path.isNotNull(), inside | _last_word(path, folder, rules))


def kept(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """The files (path, ...) that no rule leaves out."""
    return files.where(~ignored(F.col("path"), rules))
