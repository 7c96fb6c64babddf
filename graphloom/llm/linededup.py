"""Line dedup through a log-template tree of fixed depth.

A line is parsed down a tree: first by its number of tokens, then by its LEADING leading tokens, a
token with a digit counting as a variable field. The rest of the line is dealt into SEGMENTS stretches,
of one token each in short lines. In a leaf, a segment is counted by the documents that have it at its
place. A segment that half as many documents have as the middle one of the line's segments, or fewer,
is a variable field of the line and generalised to a wildcard; the others are the line's template, so
fields may vary anywhere in up to half of the segments. What other lines are in a leaf does not matter
to a template, as long as they do not share most of its segments.

A template recurs if the fixed tokens that it repeats, those of a line in all documents but one, are at
least REPEATED; a line of which more than half are variable fields is data and has none. Its lines are
dropped from all documents but the one of smallest doc_id, which keeps them, so that nothing is lost
from the corpus.

Segments and templates are known by hashes of their place in the tree; documents count them once each,
so counts are summed before they are shuffled and no leaf is ever gathered in a task. Joins read written
tables on both sides, so that Spark can split the rows of a line that is everywhere.

Null and blank lines are kept and never counted. Null and empty texts come out as they are; a very long
text is as many lines as it has. Rows that repeat a doc_id count as one document and are treated alike;
without a doc_id a row counts as one and is not changed. An empty table gives an empty result. Other
columns pass through, whatever their names, but for ``n_dropped``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LEADING, SEGMENTS, REPEATED = 2, 8, 50


#: A token with a digit, found from its beginning and without going back; and what stands for it.
FIELD, VARIABLE = r"(?<![^ \t\r\f])[^ \t\r\f0-9]*+[0-9][^ \t\r\f]*+", "0"


def tokens(line: Column) -> Column:
    """The tokens of a line, VARIABLE for a variable field. Most lines have neither a digit nor any blank but
    the space; they are split without patterns, which are slow."""
    parsed = F.split(F.regexp_replace(F.lower(line), FIELD, VARIABLE), r"[ \t\r\f]+")
    return F.array_remove(F.when(line.rlike(r"[0-9\t\r\f]"), parsed).otherwise(F.split(F.lower(line), " ")), "")


def segments(f: Column, n: Column, leaf: Column) -> Column:
    """Hashes of the stretches of a line with fields ``f``, each with its place in the tree; a line of
    LEADING tokens or fewer is one."""
    rest = F.greatest(n - LEADING, F.lit(0))
    k = F.greatest(F.lit(1), F.least(rest, F.lit(SEGMENTS)))
    begin = lambda i: LEADING + F.call_function("div", rest * i, k).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.xxhash64(leaf, i, F.slice(f, begin(i) + 1, begin(i + 1) - begin(i))))


def parse(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n, fixed, leaf, parts): lines with tokens, their number in the text from 0, and how
    many tokens they have in all and without a digit."""
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    # a filter on the tokens would make them twice
    split = lines.where(F.col("content").rlike(r"[^ \t\r\f]")).select("doc_id", "line", tokens(F.col("content")).alias("f"))
    sized = split.select("doc_id", "line", "f", F.size("f").alias("n"), F.size(F.array_remove("f", VARIABLE)).alias("fixed"))
    placed = sized.withColumn("leaf", F.xxhash64("n", F.slice("f", 1, LEADING)))
    return placed.select("doc_id", "line", "n", "fixed", "leaf", segments(F.col("f"), F.col("n"), F.col("leaf")).alias("parts"))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of the lines to drop."""
    lines = cut(parse(docs), "lines")
    leaves = lines.groupBy("leaf").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    some = cut(lines.join(cut(leaves.select("leaf"), "leaves"), "leaf", "left_semi").drop("leaf"), "candidates")
    parts = some.select("doc_id", "line", F.explode("parts").alias("part"))
    counts = parts.select("part", "doc_id").distinct().groupBy("part").agg(F.count("*").alias("docs")).where("docs > 1")
    counted = parts.join(cut(counts, "counts"), "part")
    seen = counted.groupBy("doc_id", "line").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("part", "docs")))).alias("seen"))
    lined = some.join(cut(seen, "seen"), ["doc_id", "line"])
    lined = lined.withColumn("docs", F.transform("parts", lambda p: F.coalesce(F.element_at("seen", p), F.lit(1))))
    middle = F.element_at(F.array_sort("docs"), F.floor((F.size("docs") + 1) / 2).cast("int"))
    constant = F.zip_with("parts", "docs", lambda p, d: F.when(2 * d > F.col("middle"), p))
    found = lined.withColumn("middle", middle).where("2 * fixed >= n").select("doc_id", "line", "n", "fixed", F.xxhash64(F.transform(constant, lambda p: F.coalesce(p, F.lit(0)))).alias("template"))
    found = cut(found, "templates")
    in_doc = found.groupBy("template", "doc_id").agg(F.max("fixed").alias("fixed"))
    totals = in_doc.groupBy("template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("fixed").cast("long").alias("fixed"))
    recurring = cut(totals.where((F.col("docs") > 1) & ((F.col("docs") - 1) * F.col("fixed") >= REPEATED)).select("template", "first"), "recurring")
    return found.join(recurring, "template").where("doc_id <> first").select("doc_id", "line")


def drop_recurring(docs: DataFrame) -> DataFrame:
    """The documents with their recurring lines dropped, and ``n_dropped``."""
    drops = recurring_lines(docs).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    # the row is packed, so that no column of it can clash
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long"), F.split("text", "\n").alias("parts"))
    joined = packed.join(drops, "doc_id", "left")
    # hashed once, so that a long text costs no more than its lines
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "lines")
    text = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_dropped"]
    return joined.select(*columns, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"))
