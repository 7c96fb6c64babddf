"""The corpus pipeline, stage by stage and as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import catalog

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_narrow_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, last.values.tolist())) == sorted(map(tuple, whole.values.tolist()))


def test_an_empty_table_passes_through_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
GERMAN = "der Hund und die Katze liegen vor dem Haus und warten auf das Essen"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, one without letters, a null id, repeated rows, a very long text."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d", None, None, None), (3, GERMAN, "de", "s", 9), (3, GERMAN, "de", "s", 9)]
    rows += [(4, "12 34", "de", "s", 5), (5, " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i % 7}" for i in range(40_000)), "de", None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    return df.withColumns({"component": F.lit(1), "lang_pred": F.lit("clash"), "score": F.lit(2), "n_dropped": F.lit(3)})


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x or 0))


def test_odd_rows_in_each_stage(spark, odd):
    columns = odd.columns
    out = stage("language")(spark, odd, SF)
    assert out.columns == columns and ids(out) == [3, 3, 5, None]
    assert {r["lang"] for r in out.collect()} == {"de"} and {r["lang_pred"] for r in out.collect()} == {"clash"}
    out = stage("lines")(spark, odd, SF)
    assert out.columns == columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    out = stage("near_duplicates")(spark, odd, SF)
    assert out.columns == columns and ids(out) == [1, 2, 3, 4, 5, None]
    out = stage("benchmark")(spark, odd, SF)
    assert out.columns == columns and ids(out) == ids(odd)
    out = stage("tokens")(spark, odd, SF)
    assert ids(out) == ids(odd) and {r["n_tokens"] for r in out.where("doc_id < 3").collect()} == {0}


def test_stages_keep_further_columns_of_any_name(spark, odd):
    names = {"__id": F.lit(1), "__lang": F.lit("x"), "__text": F.lit("y"), "__row": F.lit(2), "row": F.lit(3), "lines": F.lit(4), "parts": F.lit(5), "h1": F.lit(6), "best": F.lit(7), "a.b": F.lit(8)}
    docs = odd.withColumns(names)
    for name, run in corpus_pipeline.STAGES[:-1]:
        bench = run(spark, docs, SF)
        assert bench.columns == docs.columns, name
        assert {(r["__id"], r["__lang"], r["row"], r["best"], r["a.b"]) for r in bench.collect()} == {(1, "x", 3, 7, 8)}, name


def test_recurring_lines_go_and_near_copies_go(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    notice = " ".join(word() for _ in range(30))
    rows = [(100 + i, " ".join(word() for _ in range(80)) + "\n" + notice, "en", "s", None) for i in range(6)] + [(200, notice, "en", "s", 7)]
    base = [word() for _ in range(90)]
    rows += [(300 + i, " ".join(base[:i] + [word()] + base[i + 1 :]), "en", "s", None) for i in range(0, 90, 9)]
    out = stage("lines")(spark, spark.createDataFrame(rows[:7], COLUMNS), SF)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [notice in kept[100 + i] for i in range(6)] == [True] + [False] * 5 and 200 not in kept
    assert ids(stage("near_duplicates")(spark, spark.createDataFrame(rows, COLUMNS), SF)) == [*range(100, 106), 200, 300]


def test_one_row_of_a_group_stays_also_without_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(None, a), (None, near), (None, a), (7, near), (None, b), (None, b), (9, c), (9, c), (9, d), (3, d), (11, None), (None, None), (None, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], COLUMNS)
    out = [(r["doc_id"], r["text"]) for r in stage("near_duplicates")(spark, docs, SF).collect()]
    assert sorted(out, key=str) == sorted([(7, near), (None, b), (9, c), (3, d), (11, None), (None, None), (None, ""), (9, "")], key=str)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in catalog.QUERIES if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
