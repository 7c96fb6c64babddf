"""Quality scores: ridge regression on random Fourier features of document statistics.

Each whole text gives the statistics of :func:`statistics`. Random cosines of the standardised
statistics approximate a Gaussian kernel; every partition sums its part of the normal equations, whose
size depends on the number of features alone, and the driver solves them. Scores are calibrated by
isotonic regression on labelled documents that the fit has not seen: a histogram of raw scores is
summed in Spark and pooled on the driver.

Labels come from rows that are not held out: documents with remainder 0 or 1 fit, those with
remainder 3 calibrate. At most about FIT_ROWS labelled rows are used, chosen by a hash of their
statistics; the rest of the work covers all rows. A document with several labels counts as 1 if their
mean is at least a half. Null and empty texts have statistics like any other text (all 0). Without
labels of both kinds every score is their mean, or 0.5. Repeated rows each give a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, small_batches

FEATURES, WIDTH, RIDGE, SEED, BINS = 256, 6.0, 1e-3, 20, 2000
FIT_ROWS, FIT_PARTS = 2_000_000, 32
THRESHOLD = 0.7
SYMBOLS = b"#$%&*|<>{}[]=_~^\\/@+"
PUNCTUATION = b".,;:!?'\"()-"


def statistics(text: str | None) -> list[float]:
    """Length, word shapes, repetition, character classes and line structure of a text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, chars = len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    lowered = [w.lower() for w in counts]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = Counter(zip(words, words[1:], strict=False))
    repeated = sum(v - 1 for v in pairs.values() if v > 1)
    table = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = table[table > 0] / chars
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower, digits = table[65:91].sum(), table[97:123].sum(), table[48:58].sum()
    symbols = sum(int(table[b]) for b in SYMBOLS)
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    ends = np.isin(last, np.frombuffer(PUNCTUATION, np.uint8)).mean()
    odd = np.isin(last, np.frombuffer(SYMBOLS, np.uint8)).mean()
    return [
        np.log1p(chars), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths == 1).mean(), (lengths <= 3).mean(),
        len(counts) / n, len(counts) / n**0.7, top / n, same / n, repeated / n, len(set(lowered)) / max(1, len(lowered)),
        lower / chars, upper / chars, digits / chars, symbols / chars, table[124] / chars, table[128:].sum() / chars, sum(int(table[b]) for b in PUNCTUATION) / chars,
        -(p * np.log2(p)).sum(), ends, odd, table[33] / chars, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(chars / max(1, len(lines))),
    ]


N_STATISTICS = 27


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every document."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[float(v) for v in statistics(t)] for t in texts])

    return small_batches(docs).select(F.col("doc_id").cast("long"), run(F.col("text").cast("string")).alias("x"))


class Model:
    """Standardisation, random directions, ridge weights, and steps of the calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(size=(N_STATISTICS, FEATURES)) / WIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.raw, self.level = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.cos(z @ self.directions + self.phases) * np.sqrt(2 / FEATURES), np.ones(len(z))]

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_scores(x), self.raw, self.level), 0.0, 1.0)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(-1, N_STATISTICS)


def partition_sums(rows: DataFrame, of) -> np.ndarray | None:
    """The sum over rows (x, y) of the array that ``of(x, y)`` gives for a batch. Each of at most
    FIT_PARTS partitions sends one array."""

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                part = of(matrix(pdf["x"]), pdf["y"].to_numpy(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"sums": [total.astype("<f8").tobytes()], "shape": [",".join(map(str, total.shape))]})

    found = rows.coalesce(FIT_PARTS).mapInPandas(run, "sums binary, shape string").collect()
    arrays = [np.frombuffer(r["sums"], "<f8").reshape([int(v) for v in r["shape"].split(",")]) for r in found]
    return sum(arrays[1:], arrays[0]) if arrays else None


def pool(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the ascending means closest to y / n with weights n."""
    blocks: list[list[float]] = []
    for total, weight in zip(y, n, strict=True):
        blocks.append([total, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    return np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])


def fit(described: DataFrame, labels: DataFrame) -> Model:
    """Learns from (doc_id, x) and labels (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    rows = described.join(known, "doc_id").where(~held_out())
    rows = cut(rows.select("x", "y", (F.crc32(F.col("doc_id").cast("string")) % 4 == 3).alias("calibrate")), "labelled")
    n = rows.count()
    if n > FIT_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < int((1 << 20) * FIT_ROWS / n))
    moments = partition_sums(rows, lambda x, y: np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    mean = moments[1] / moments[0]
    model = Model(mean, np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 0)) + 1e-6)

    def normal(x, y):
        z = model.features(x)
        return np.c_[z.T @ z, z.T @ y]

    sums = partition_sums(rows.where("not calibrate"), normal)
    if sums is None:
        sums = partition_sums(rows, normal)
    a, b = sums[:, :-1], sums[:, -1]
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) / FEATURES * np.eye(len(a)), b)

    def histogram(x, y):
        at = np.clip(((model.raw_scores(x) + 0.5) * BINS / 2).astype(np.int64), 0, BINS - 1)
        return np.stack([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS).astype(float)])

    counts = partition_sums(rows.where("calibrate"), histogram)
    if counts is None:
        counts = partition_sums(rows, histogram)
    used = counts[1] > 0
    model.raw = (np.flatnonzero(used) + 0.5) * 2 / BINS - 0.5
    model.level = pool(counts[0][used], counts[1][used])
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    described = cut(describe(docs), "statistics")
    model = fit(described, labels)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(matrix(x)))

    out = described.select("doc_id", held_out().alias("held_out"), run("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
