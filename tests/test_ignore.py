"""Ignore rules against git itself."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.sources import code, ignore

RULES = """# comment
*.log
!keep.log
out/
/top.txt
doc/**
**/made/*.py
x/**/y.py
 tmp*
!tmpl/
pic?.svg
lib/*.so
!doc/again
we[i]rd
"""
PATHS = """a.log keep.log deep/b.log deep/keep.log out/a.py in/out/a.py outer/a.py out top.txt deep/top.txt doc/a.md doc/again doc/again/b made/q.py r/made/q.py r/made/s/q.py x/y.py x/a/b/y.py x/y
 tmp1 tmpl/a tmpfile/a deep/tmpl/c pic1.svg pic12.svg deep/pic2.svg lib/a.so lib/b/a.so weird we[i]rd plain.py made.py out.log/keep.log""".split()


def judge(spark, rules, paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r["path"] for r in df.where(ignore.ignored(F.col("path"), rules)).collect()}


def git_says(folder, files, paths):
    git = shutil.which("git")
    if git is None:
        pytest.skip("git is not installed")
    subprocess.run([git, "init", "-q", str(folder)], check=True)
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    run = subprocess.run([git, "-C", str(folder), "check-ignore", "--no-index", "--stdin"], input="\n".join(paths), capture_output=True, text=True)
    assert run.returncode in (0, 1)
    return {line.strip('"') for line in run.stdout.splitlines()}


def test_rules_are_those_of_git(spark, tmp_path):
    paths = [p for p in PATHS if "[" not in p and p != "weird"]
    text = RULES.replace("we[i]rd\n", "").replace(" tmp*", "tmp*")
    assert judge(spark, ignore.parse_rules(text), paths) == git_says(tmp_path, {".gitignore": text}, paths)


def test_brackets_are_plain_and_lines_are_stripped(spark):
    rules = ignore.parse_rules(RULES)
    assert judge(spark, rules, ["weird", "we[i]rd", "tmp1", "a/tmp2"]) == {"we[i]rd", "tmp1", "a/tmp2"}
    assert judge(spark, [], ["a"]) == set()
    nulls = spark.createDataFrame([(None,)], "path string").select(ignore.ignored(F.col("path"), rules).alias("x")).first()
    assert nulls["x"] is None


def test_random_rules_are_those_of_git(spark, tmp_path):
    rng = random.Random(5)
    names = ["a", "b", "ab", "c.py", "d.log"]
    paths = sorted({"/".join(rng.choices(names[:3], k=rng.randrange(3)) + [rng.choice(names)]) for _ in range(60)})
    paths = [p for p in paths if not any(o.startswith(p + "/") for o in paths)]
    for k in range(25):
        part = lambda: rng.choice(["a", "b", "*", "a*", "?", "**", "*.py", "ab"])
        lines = [rng.choice(["", "", "!"]) + rng.choice(["", "/", "**/"]) + "/".join(part() for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "/"]) for _ in range(6)]
        lines = [x for x in lines if "***" not in x and "a**" not in x and "**a" not in x]
        nested = "\n".join(rng.sample(["*.py", "!c.py", "/b", "d.log", "!*", "ab/"], 2)) + "\n"
        files = {".gitignore": "\n".join(lines) + "\n", "a/.gitignore": nested}
        rules = ignore.parse_rules(files[".gitignore"]) + ignore.parse_rules(nested, "a/")
        assert judge(spark, rules, paths) == git_says(tmp_path / str(k), files, paths), files


def test_scanning_reads_the_rule_files_of_a_project(spark, tmp_path):
    files = {".gitignore": "made/\n*.tmp.py\n", "pkg/.gitignore": "!x.tmp.py\n/local.py\n", "pkg/a.py": "def f(): pass\n", "pkg/x.tmp.py": "", "y.tmp.py": "", "made/b.py": "", "pkg/local.py": "", "pkg/sub/local.py": "", "node_modules/m.py": ""}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text + " ")
    seen = {r["path"] for r in code.scan(spark, str(tmp_path)).collect()}
    assert seen == {"pkg/a.py", "pkg/x.tmp.py", "pkg/sub/local.py"}
    assert "made/b.py" in {r["path"] for r in code.scan(spark, str(tmp_path), gitignore=False).collect()}
