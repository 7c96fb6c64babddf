"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits. At every token position each fixed
mask of MASKS selects some of the next tokens and ignores the others; equal hashes of selected
tokens in a document and in a benchmark item are a hit and give an alignment of the two. Around hits
the aligned tokens are compared: a document is contaminated by an item if some WINDOW aligned tokens
in a row hold at most MISSES unequal ones (items of SHORT to WINDOW - 1 tokens: all their tokens, one
unequal). The masks are such that every such window has a hit, so the rule alone decides.

Items of 1 to SHORT - 1 tokens match, with ``short_items``, where all their tokens stand in a row; the
query and the pipeline ask for it. In scripts written without
blanks each letter is a token. Null and empty texts match nothing. Items of equal tokens are compared once and reported each. Repeated rows change
nothing; a row without a doc_id is not reported. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Selected offsets of each mask.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8))
WINDOW, MISSES, SHORT = 13, 2, 9
#: Benchmark seeds up to which they are broadcast (24 bytes each); with more, both sides are shuffled.
BROADCAST_SEEDS = 2_000_000


#: A letter of a script that is written without blanks.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}])"


def token_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(text), UNSPACED, " $1 "), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, *carried: str) -> DataFrame:
    """(carried, at, seed) of each position and mask for rows with tokens ``h``."""
    span = 1 + min(max(m) for m in MASKS)
    at = rows.where(F.size("h") >= span).select(*carried, "h", F.explode(F.sequence(F.lit(0), F.size("h") - span)).alias("at"))
    seeds = [F.when(F.col("at") + max(m) < F.size("h"), F.xxhash64(F.lit(i), *(F.get("h", F.col("at") + k) for k in m))) for i, m in enumerate(MASKS)]
    return at.select(*carried, "h", "at", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _short_matches(tokens: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """(doc_id, item, matched) of the items of fewer than SHORT tokens that documents hold whole."""
    spans = F.array(*(F.when(F.col("at") + n <= F.size("h"), F.slice("h", F.col("at") + 1, n)) for n in range(1, SHORT)))
    at = tokens.where(F.size("h") > 0).select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("at"))
    held = at.select("doc_id", F.explode(spans).alias("h")).where("h is not null")
    return held.join(F.broadcast(items) if small else items, "h").select("doc_id", "item", F.size("h").cast("long").alias("matched")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """(doc_id, item_id, matched): most equal tokens in a window, for documents (doc_id, text) and
    items (item_id, text) that share a passage."""
    named = cut(benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), token_hashes(F.col("text")).alias("h")).where(F.size("h") > 0), "items")
    every = cut(named.groupBy("h").agg(F.min("item_id").alias("item")), "items")
    items, short = every.where(F.size("h") >= SHORT), every.where(F.size("h") < SHORT)
    seeds = cut(_seeds(items, "item").groupBy("seed", "item", F.col("at").alias("item_at"), F.size("h").alias("n")).agg(F.lit(1).alias("one")).drop("one"), "seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    tokens = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), token_hashes(F.col("text")).alias("h"))
    begin = F.col("at") - F.col("item_at")
    passage = F.slice("h", F.greatest(begin, F.lit(0)) + 1, F.col("n") + F.least(begin, F.lit(0)))
    if small:
        hits = _seeds(tokens, "doc_id").join(F.broadcast(seeds), "seed")
        hits = hits.select("doc_id", "item", begin.alias("begin"), passage.alias("passage")).distinct()
    else:
        hits = _seeds(tokens, "doc_id").drop("h").join(seeds, "seed").select("doc_id", "item", "n", begin.alias("begin")).distinct()
        at, item_at = F.greatest("begin", F.lit(0)), F.greatest(-F.col("begin"), F.lit(0))
        hits = hits.join(tokens, "doc_id").select("doc_id", "item", "begin", F.slice("h", at + 1, F.col("n") - item_at).alias("passage"))
    both = hits.join(F.broadcast(items) if small else items, "item")
    part = F.slice("h", F.greatest(-F.col("begin"), F.lit(0)) + 1, F.size("h"))
    equal = F.zip_with("passage", part, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    width = F.least(F.size("h"), F.lit(WINDOW))
    both = both.select("doc_id", "item", "h", width.alias("width"), equal.alias("equal")).where("size(equal) >= width")
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1), lambda i: F.aggregate(F.slice("equal", i, F.col("width")), F.lit(0), lambda a, b: a + b))
    need = F.when(F.col("width") < WINDOW, F.col("width") - 1).otherwise(WINDOW - MISSES)
    found = both.select("doc_id", "item", F.array_max(sums).alias("matched"), need.alias("need")).where("matched >= need")
    best = found.groupBy("doc_id", "item").agg(F.max("matched").cast("long").alias("matched"))
    n_short = short.count() if short_items else 0
    if n_short:
        best = best.unionByName(_short_matches(tokens, short, n_short <= BROADCAST_SEEDS // SHORT))
    groups = named.join(every, "h").select("item", "item_id").distinct()
    return best.join(groups, "item").select("doc_id", "item_id", "matched")


def clean(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """The documents that no benchmark item contaminates."""
    bad = contaminated(docs, benchmark, short_items).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
