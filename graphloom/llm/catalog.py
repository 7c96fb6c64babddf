"""Queries of the corpus operators, one ``opN_<name>`` each, and SQL equivalents where SQL can say it."""

from __future__ import annotations

from importlib import import_module

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, langid, linededup, neighbours, pii, quality, runs, shards, sql, warc, whiten
from .common import held_out, table

#: Where the vocabulary of op6 is; a parameter of the query, never copied.
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), 40)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=20)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, and one more whose texts look like the template."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


def op6_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.Vocabulary.load(tokenizer))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_recurring(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(table(spark, sf_dir, "documents"), repeat_tails=True)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py``, the script at the top of the repository."""
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_neighbours": op3_neighbours,
    "op4_langid": op4_langid,
    "op5_chat": op5_chat,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_pii": op11_pii,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}
ORACLE_SQL = {
    "op3_neighbours": sql.NEIGHBOURS,
    "op5_chat": sql.CHAT,
    "op7_warc": sql.WARC,
    "op8_line_dedup": sql.LINE_DEDUP,
    "op9_decontamination": sql.DECONTAMINATION,
    "op13_periodic_runs": sql.PERIODIC_RUNS,
}
