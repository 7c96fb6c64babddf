"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Between stages a table is written and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, jaccard, langid, linededup
from graphloom.llm.common import cut, table

#: Where the vocabulary of the last stage is.
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): each row as a struct, in which no column can clash with those of a stage."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from its packed rows, those in ``changed`` anew."""
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; ``lang`` becomes the predicted one.

    Null and empty texts and texts without a letter have none. Very long texts are parsed whole. Ties go
    to the first language by name. Repeated rows are treated alike, an empty table stays empty, and
    further columns of any name are kept. Without a labelled text all documents go."""
    known = langid.identify(packed(docs).select("row", "text"), langid.fit(docs))
    return unpacked(known.where(F.col("lang_pred") != langid.UNDETERMINED), docs, lang=F.col("lang_pred"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; n_chars follows. A document of
    which nothing is left goes.

    Null and empty texts stay as they are, so do rows without a doc_id. Lines of a very long text are
    treated like others. Of documents that share a template the one of smallest doc_id keeps it; rows
    that repeat a doc_id are treated alike. An empty table stays empty, and further columns of any name
    are kept."""
    out = linededup.drop_recurring(packed(docs))
    out = out.where(F.col("text").isNull() | (F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    changed = F.col("n_dropped") > 0
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(out, docs, n_chars=n_chars, text=F.when(changed, F.col("text")).otherwise(F.col("row.text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of smallest doc_id; five words, 0.8.

    Null and empty texts stay. A text of fewer than five words is compared as a whole, a very long one by
    all its shingles. Rows without a doc_id are compared like others and come last in their group. Of rows
    that repeat the doc_id that stays one stays. An empty table stays empty, and further columns are kept."""
    return jaccard.keep_one(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts and rows without a doc_id stay, as does everything if there is no benchmark.
    Very long texts are searched whole. Repeated rows go or stay together. An empty table stays empty,
    and further columns are kept."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded documents.

    Null and empty texts have no ids. Very long texts are encoded whole. Each row has a row, repeated
    ones and those without a doc_id too; an empty table gives an empty result. Other columns are not
    read."""
    return bpe.digests(docs, bpe.Vocabulary.load(TOKENIZER))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: Language ID and byte-pair merges cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
