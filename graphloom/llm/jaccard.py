"""N-gram Jaccard join by parity sketches.

Shingles are XOR-hashed into the buckets of a sketch: a bucket holds the XOR of the 64-bit hashes
of the shingles dealt to it, so each shingle of the symmetric difference of two sets changes one
bucket at most and the number of differing buckets is a lower bound of that difference. Sets in one
size band that reach the threshold differ in at most ``t`` shingles (:func:`band_shape`), so with more
than ``t`` buckets one of them is equal in both: equal buckets are the join keys. A set needs one key
more than buckets can differ, not all of them. Thin buckets, empty or of one shingle, tell little and
would bring all texts with one common line together, so its keys are of the buckets of most shingles.
Equal buckets have equally many, so before the first one that is equal in both, either set has none
but those that differ, and it is a key of both: no pair over the threshold is missed.

In large bands each set has some keys more than it needs, in all sets of a band equally many. Linked
sets then share that many keys more, and each set does without as many again: those that most sets
have go (prefix filtering: of the keys that two linked sets share, the one that fewest sets have stays
in both). These are the keys made of passages that many unlike texts share.

Each text is read once for its set and keys; keys are written as one list for each set and spread out
from there.

A candidate pair is first held against bit sketches, the parities of shingle hashes modulo a power
of two, whose Hamming distance is a lower bound of the symmetric difference as well; what is left is
verified on the texts.

Pairs are not spread out within a group. Each key names as its pivot the set that shares most keys
with others; members are verified against their pivots, links are contracted to components, and
only members that fell outside the component of their pivot are compared with the rest of the
group, by their bit sketches and in blocks. At the end every pair of a group is either verified or in
one component, so the components are those of the full join.

Groups may hold any share of the rows. Aggregations are partial before they are shuffled; joins on a
key of theirs read written tables on both sides, so that Spark can split a large partition of one.

Nulls and empty texts have no shingles and are linked with nothing. Equal sets are one class before
any comparison, named by a number of its own, so that rows without a doc_id and rows that repeat one with
another text link like all others. Each row gives its own output row; a component without any doc_id has
none as its name. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import M2, cut, mix, small_batches, with_text_ids
from .components import contract
from .shingles import WordHashes, shingle_set, shingle_sets, unlike_last

#: Ratio of the largest to the smallest set size of a band, its spare buckets and the spare keys of a set in
#: each one that may differ.
BAND, SLACK, SPARE = 2, 0.25, 0.15
#: Members of a group that share one copy of their pivot's text, and parts into which they are dealt.
SHARE, SALTS = 256, 64
#: Members of a group, and bytes of their sketches, that are compared with one another in one piece;
#: pairs that come out of a piece at once.
BLOCK, BLOCK_BYTES, PIECE = 1024, 8 << 20, 100_000
#: Sets that a partition remembers in order to pass over copies.
SEEN = 100_000
#: Classes that may be told apart as large by name, and keys as hot: keys of about HOT_ROWS sets and
#: more, as judged by one text in PART. Both lists are bounded, whatever they leave out goes the
#: common way, and the result is the same.
LARGE, HOT_KEYS, HOT_ROWS, PART = 10_000, 50_000, 512, 64


def band_of(n: int) -> int:
    return int(math.log(n) / math.log(BAND) + 1e-9)


@lru_cache(256)
def band_shape(band: int, percent: int) -> tuple[int, int, int]:
    """Most differing shingles of two linked sets of a band, its number of buckets, and how many keys more
    than it needs a set has: linked sets differ in at most (100 - p) / (100 + p) of the sum of their sizes."""
    largest = math.ceil(BAND ** (band + 1))
    t = (100 - percent) * 2 * largest // (100 + percent)
    return t, t + 1 + (0 if t == 0 else 1 if t < 4 else 1 + math.ceil(SLACK * (t + 1))), int(SPARE * (t + 1))


def most_differing(n: int, band: int, percent: int) -> int:
    """Most differing shingles of a set of n and a linked one of the band."""
    other = min(math.ceil(BAND ** (band + 1)), n * 100 // percent)
    return (100 - percent) * (n + other) // (100 + percent)


def bands(n: int, percent: int) -> list[int]:
    """The set's own band, and the next one if a linked set may be there."""
    own = band_of(n)
    return [own] if band_of(n * 100 // percent + 1) == own else [own, own + 1]


@lru_cache(64)
def _bucket_names(band: int, buckets: int) -> np.ndarray:
    return mix(np.arange(buckets, dtype=np.uint64) * M2 + np.uint64(band + 1))


def join_keys(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Keys of a set, hashes of (band, bucket, XOR of the bucket), and how many of them are of its own band.
    Those of each band are of the buckets of most shingles."""
    out, mixed = [], mix(shingles)
    for band in bands(len(shingles), percent):
        _, buckets, spare = band_shape(band, percent)
        at = ((shingles >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)  # rises, as shingles do
        starts = np.flatnonzero(unlike_last(at))
        keys = np.zeros(buckets, np.uint64)
        keys[at[starts]] = np.bitwise_xor.reduceat(mixed, starts)
        keys = mix(keys ^ _bucket_names(band, buckets))
        over = buckets - (most_differing(len(shingles), band, percent) + 1 + spare)
        if over > 0:
            thick = np.minimum(np.bincount(at, minlength=buckets), 255).astype(np.uint64)
            keys = keys[np.argpartition(thick << np.uint64(56) | keys >> np.uint64(8), over)[over:]]
        out.append(keys)
    return np.concatenate(out).view(np.int64), len(out[0])


def bit_sketch(shingles: np.ndarray, percent: int) -> bytes:
    """Parity of the shingles at each bit; more bits than four times the differing shingles that two
    linked sets of this size may have, at least 1024, a power of two. Sets that share nothing differ in
    half of the bits, so in twice as many as linked ones at least."""
    bits = 1 << max(10, (8 * len(shingles) * (100 - percent) // (100 + percent)).bit_length())
    at = ((shingles >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, a: bytes, m: int, b: bytes, percent: int) -> bool:
    """False only if sets of n and m shingles with these sketches cannot be linked."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    x, y, i, j = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a), len(b)
    while i > j:
        i //= 2
        x = (x >> (8 * i)) ^ (x & ((1 << (8 * i)) - 1))
    while j > i:
        j //= 2
        y = (y >> (8 * j)) ^ (y & ((1 << (8 * j)) - 1))
    return (x ^ y).bit_count() * (100 + percent) <= (100 - percent) * (n + m)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (x >> 64) - (1 << 63), (x & (2**64 - 1)) - (1 << 63)


def _describe(width: int, percent: int):
    """Size and hash of each set, its band and its keys. Copies that follow in a partition have no keys."""

    def run(batches):
        seen = set()
        for batch in batches:
            sizes, ids, of, own, keys = [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), width):
                ident = set_hash(s)
                k, n = np.empty(0, np.int64), 0
                if len(s) and ident not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(ident)
                    k, n = join_keys(s, percent)
                sizes.append(len(s))
                ids.append(ident)
                of.append(band_of(len(s)) if n else 0)
                own.append(n)
                keys.append(k)
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            h1, h2 = (pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1))
            numbers = pa.array(sizes, pa.int64()), h1, h2, pa.array(of, pa.int32()), pa.array(own, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, lists], ["doc_id", "n_shingles", "h1", "h2", "band", "own", "keys"])

    return run


def _with_sets(width: int):
    """Adds the hash of the set of shingles to each text."""

    def run(batches):
        for pdf in batches:
            ids = [set_hash(s) for s in shingle_sets(pdf["text"], width)]
            yield pdf.assign(h1=[a for a, _ in ids], h2=[b for _, b in ids])

    return run


def _verify(width: int, percent: int):
    def run(batches):
        hashes = WordHashes()
        last: tuple = (None, None)
        for pdf in batches:
            linked = []
            for pivot, a, b in zip(pdf["b"], pdf["a_text"], pdf["b_text"], strict=True):
                if last[0] != pivot:
                    last = (pivot, shingle_set(b, width, hashes))
                s = shingle_set(a, width, hashes)
                both = len(np.intersect1d(s, last[1], assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(s) + len(last[1]) - both))
            yield pdf.loc[linked, ["a", "b"]]

    return run


def _sketch(width: int, percent: int):
    """Texts of an id with several texts are of the class alone whose set they have."""

    def run(batches):
        for pdf in batches:
            sets = list(shingle_sets(pdf["text"], width))
            own = [set_hash(s) == c for s, c in zip(sets, zip(pdf["h1"], pdf["h2"], strict=True), strict=True)]
            sets = [s for s, o in zip(sets, own, strict=True) if o]
            yield pdf.loc[own, ["node", "text"]].assign(size=[len(s) for s in sets], bits=[bit_sketch(s, percent) for s in sets])

    return run


def _sift(percent: int):
    def run(batches):
        for pdf in batches:
            yield pdf.loc[[may_link(*x, percent) for x in zip(pdf["a_size"], pdf["a_bits"], pdf["b_size"], pdf["b_bits"], strict=True)], ["a", "b"]]

    return run


def _beside(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """``pairs(a, b)`` with the columns of ``nodes`` for either, a_ and b_ before their names. The
    row of b is copied for every ``share`` pairs, so that no task gets all pairs of a hot one."""
    counts = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / share).cast("int").alias("copies")), "copies")
    columns = [c for c in nodes.columns if c != "node"]
    pivots = nodes.join(counts, nodes.node == counts.b).select("b", "copies", *(F.col(c).alias("b_" + c) for c in columns))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    # how often a hot row is copied has to reach all its pairs, which are dealt over SALTS tasks for that
    hot = counts.where("copies > 1").withColumnRenamed("copies", "own").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("a", F.lit(7)), F.lit(SALTS)).cast("int"))
    salted = dealt.join(hot, ["b", "deal"], "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("own", F.lit(1))).cast("int"))
    members = salted.join(nodes.select(F.col("node").alias("a"), *(F.col(c).alias("a_" + c) for c in columns)), "a")
    return members.join(pivots, ["b", "salt"])


def _verified(close: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones of ``close(a, b)``. Only texts of those are shuffled."""
    ends = cut(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    texts = texts.join(ends, "node", "left_semi")
    return _beside(close, texts, SHARE).select("a", "b", "a_text", "b_text").mapInPandas(_verify(width, percent), "a long, b long")


def close_pairs(cell: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of a cell that may link: of different components, not both in that of the pivot,
    and of the two blocks of the cell if it has two. Each table has PIECE pairs at most."""
    words = [np.frombuffer(x, np.uint64) for x in cell["bits"]]
    least = min(map(len, words))
    bits = np.array([np.bitwise_xor.reduce(w.reshape(-1, least)) for w in words])
    node, size, component, outside, block = (cell[c].to_numpy() for c in ("node", "size", "component", "outside", "block"))
    two = bool(cell["low"].iloc[0] != cell["high"].iloc[0])
    left = np.flatnonzero(outside == 1)
    step = max(1, min(PIECE, 2_000_000 // least) // len(cell))
    for at in range(0, len(left), step):
        i = left[at : at + step, None]
        apart = np.bitwise_count(bits[i] ^ bits[None]).sum(2, dtype=np.int64)
        may = apart * (100 + percent) <= (100 - percent) * (size[i] + size[None])
        may &= (component[i] != component[None]) & ((outside[None] == 0) | (node[i] < node[None]))
        if two:
            may &= block[i] != block[None]
        x, y = np.nonzero(may)
        for part in range(0, len(x), PIECE):
            yield pd.DataFrame({"a": node[i[x[part : part + PIECE], 0]], "b": node[y[part : part + PIECE]]})


def _compare_cells(percent: int):
    """Cells come sorted, a cell may go on in the next batch."""

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            keys = pdf[["key", "low", "high"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for b, e in zip(starts[:-1], starts[1:], strict=True):
                yield from close_pairs(pdf.iloc[b:e], percent)
            held = pdf.iloc[starts[-1] :].copy()
        if held is not None:
            yield from close_pairs(held, percent)

    return run


def _open_pairs(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that may link among rows (key, node, component, outside) of the same key.
    A group is dealt into blocks of about BLOCK members and BLOCK_BYTES of sketches at most, and every
    two blocks are a cell of their own, so that no task holds more than two blocks; sketches are
    compared inside, pairs that cannot link never leave a cell."""
    rows = cut(rows.join(sketches, "node"), "members")
    least = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("bits")) / BLOCK_BYTES)).cast("int")
    dealt = rows.join(cut(rows.groupBy("key").agg(least.alias("blocks")), "blocks"), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
    cells = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return cells.mapInPandas(_compare_cells(percent), "a long, b long").distinct()


def _shared_keys(sets: DataFrame) -> DataFrame:
    """(key, band, h1) of the keys that several of ``sets(band, own, keys, h1)`` have. Most keys are of
    one set alone and go after one shuffle by key. The rows of a large group of similar sets would
    meet in one task: which keys have many is told by a part of the sets, at most HOT_KEYS, and their
    rows all stay and are dealt over SALTS tasks."""
    part = sets.where(F.pmod(F.xxhash64("h1", F.lit(9)), F.lit(PART)) == 0).select("h1", F.explode("keys").alias("key"))
    counts = part.distinct().groupBy("key").count().where(F.col("count") >= HOT_ROWS // PART)
    hot = cut(counts.orderBy(F.desc("count"), "key").limit(HOT_KEYS).select("key", F.lit(True).alias("hot")), "hot")
    rows = sets.select("band", "own", "h1", F.posexplode("keys").alias("at", "key"))
    rows = rows.select("key", F.when(F.col("at") < F.col("own"), F.col("band")).otherwise(F.col("band") + 1).alias("band"), "h1")
    rows = rows.join(F.broadcast(hot), "key", "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("h1", F.lit(7)), F.lit(SALTS))).otherwise(0).cast("int"))
    together = Window.partitionBy("key", "salt")
    rows = rows.withColumns({"low": F.min("h1").over(together), "high": F.max("h1").over(together)})
    return rows.where("hot or low <> high").select("key", "band", "h1")


def _without_spare(named: DataFrame, percent: int) -> DataFrame:
    """(key, node) without the keys (key, node, band) that a set has to spare, those of most sets
    first."""
    sizes = cut(named.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1"), "sizes")
    place = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("sets"), "key"))
    spare = F.array(*(F.lit(band_shape(band, percent)[2]) for band in range(band_of(2**40))))
    return named.join(sizes, "key").withColumn("place", place).where(F.col("place") > spare[F.col("band")]).select("key", "node")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """For documents (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id that links
    reach). Two documents link if 100 * intersection >= percent * union."""
    return _components(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, h1, h2, component) of each row: the hash of its set, and a
    number for the component that also those without a doc_id have; null without shingles."""
    docs = with_text_ids(docs)
    sets = docs.mapInArrow(_describe(width, percent), "doc_id string, n_shingles long, h1 long, h2 long, band int, own int, keys array<long>")
    sets = cut(sets.withColumns({"doc_id": F.col("doc_id").cast("long"), "row": F.monotonically_increasing_id()}), "sets")
    meta = sets.select("doc_id", "n_shingles", "h1", "h2")
    # one doc_id may be the first of several classes, so a class has the number of a row that has its keys
    node = F.max(F.when(F.col("own") > 0, F.col("row"))).alias("node")
    classes = sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), node)
    classes = cut(classes, "classes")
    # no more than LARGE classes have more than this share of all rows
    large = classes.where(F.col("copies") > max(SHARE, meta.count() // LARGE)).select("h1", "h2", "node")
    classes = classes.drop("copies")

    # of a large class one row alone has keys
    held = sets.where("own > 0").join(F.broadcast(large), ["h1", "h2"], "left").where("node is null or node = row")
    shared = cut(_shared_keys(held.select("band", "own", "keys", "h1")), "keys")
    # two classes of one h1 have each other's keys too, which loses none
    named = cut(shared.join(classes.select("h1", "node"), "h1").select("key", "node", "band").distinct(), "named")
    named = cut(_without_spare(named, percent), "kept")
    groups = cut(named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    named = cut(named.join(groups, "key"), "named")
    score = cut(named.groupBy("node").agg(F.sum("n").alias("score")), "scores")
    named = named.drop("n")
    pivots = named.join(score, "node").groupBy("key").agg(F.max(F.struct("score", F.negative("node").alias("minus"))).alias("top"))
    named = cut(named.join(cut(pivots.select("key", (-F.col("top.minus")).alias("pivot")), "pivots"), "key"), "placed")

    pairs = cut(named.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    wanted = classes.join(named.select("node").distinct(), "node")
    texts = docs.join(wanted, docs.doc_id.cast("long") == wanted["first"]).select("node", "h1", "h2", "text")
    unnamed = docs.where("doc_id is null").select("text").mapInPandas(_with_sets(width), "text string, h1 long, h2 long")
    texts = texts.unionByName(unnamed.join(wanted.where("first is null"), ["h1", "h2"]).select("node", "h1", "h2", "text"))
    texts = texts.mapInPandas(_sketch(width, percent), "node long, text string, size long, bits binary")
    texts = cut(texts.groupBy("node").agg(F.min(F.struct("text", "size", "bits")).alias("x")).select("node", "x.*"), "texts")
    texts, sketches = texts.select("node", "text"), texts.select("node", "size", "bits")
    close = cut(_beside(pairs, sketches, 20_000).mapInPandas(_sift(percent), "a long, b long"), "close")
    links = cut(_verified(close, texts, width, percent), "links")
    comp = contract(links)
    placed = cut(named.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    own = F.max(F.when(F.col("node") == F.col("pivot"), F.col("component")))
    # a group in one component leaves no pair open, nor do the pivot and one outside it
    groups = placed.groupBy("key").agg(own.alias("own"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    groups = cut(groups.where("low <> high and n > 2").select("key", "own"), "groups")
    outside = (F.col("component") != F.col("own")).cast("int").alias("outside")
    rest = placed.where("node <> pivot").join(groups, "key").select("key", "node", "component", outside)
    more = cut(_open_pairs(rest, sketches, percent), "close")
    links = cut(links.unionByName(_verified(more, texts, width, percent)), "links")
    comp = contract(links)
    placed = classes.join(comp.withColumnRenamed("id", "node"), "node", "left").select("h1", "h2", "first", F.coalesce("component", "node").alias("component"))
    named = placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("component", F.col("component_id").alias("smallest"))
    placed = placed.join(named, "component", "left").select("h1", "h2", "component", F.coalesce("smallest", "first").alias("component_id"))
    placed = cut(placed, "components")
    # the rows of a large class stay where they are, those without shingles are not joined at all
    of_large = F.broadcast(large.select("h1", "h2").join(placed, ["h1", "h2"]))
    some = meta.where("n_shingles > 0")
    out = some.join(of_large, ["h1", "h2"]).unionByName(some.join(of_large, ["h1", "h2"], "left_anti").join(placed, ["h1", "h2"], "left"))
    bare = meta.where("n_shingles = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    return out.unionByName(bare).withColumn("component_id", F.coalesce("component_id", "doc_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that of smallest doc_id, and of rows that repeat this id the
    first text. Rows without a doc_id come last, so one of them stays where a component has no other.
    Documents without shingles stay."""
    every = cut(_components(docs, width, percent), "found")
    found = every.where("component is not null")
    order = lambda: F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")
    stays = found.groupBy("component").agg(F.min(order()).alias("best"), F.count("*").alias("rows"))
    stays = cut(stays.where("rows > 1").select("component", "best"), "stays")
    grouped = cut(found.join(stays, "component").select("doc_id", "h1", "h2", (order() == F.col("best")).alias("best")), "grouped")
    times = every.groupBy("doc_id").agg(F.count("*").alias("n"))
    several = cut(times.where("n > 1 or doc_id is null").select("doc_id"), "several")
    gone = grouped.where("not best").join(several, "doc_id", "left_anti").select("doc_id").where("doc_id is not null")
    # an id alone does not tell such rows apart: their sets are made again, and one row of the best is taken
    id_of = F.col("doc_id").cast("long")
    odd = (docs.where("doc_id is null"), docs.where("doc_id is not null").join(several.where("doc_id is not null"), "doc_id", "left_semi"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    odd = [x.select(id_of.alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row")) for x in odd]
    odd = small_batches(odd[0].unionByName(odd[1])).withColumn("set", _set_of(width)("text")).select("doc_id", "set.*", "text", "row")
    known = grouped.join(several, grouped.doc_id.eqNullSafe(several.doc_id), "left_semi").distinct()
    same = odd.doc_id.eqNullSafe(known.doc_id) & (odd.h1 == known.h1) & (odd.h2 == known.h2)
    one = odd.join(known.where("best"), same, "left_semi").groupBy("doc_id", "h1", "h2").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row"))
    rest = odd.join(known, same, "left_anti")
    plain = docs.where("doc_id is not null").join(several.where("doc_id is not null").unionByName(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    return plain.unionByName(one.select("row.*")).unionByName(rest.select("row.*"))


def _set_of(width: int):
    @F.pandas_udf("h1 long, h2 long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([set_hash(s) for s in shingle_sets(texts, width)], columns=["h1", "h2"], dtype="int64")

    return run
