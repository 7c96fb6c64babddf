"""Embedding whitening from an exact scatter matrix, by residues.

Each entry c of a vector becomes the whole number x = floor(SCALE * c) + SHIFT. A first pass counts the
vectors and sums each dimension. In a second one the numbers, less the whole part of their mean, are
taken modulo several primes; every partition multiplies its residues with float matrix products that
stay below 2**53, so they are exact, and sums the products modulo each prime. The sums of the partitions
are added by Spark, and Chinese remaindering makes whole numbers of them: the product of the primes is
over twice the largest scatter that these vectors can have. What is left of the means is taken off in
whole numbers too, so the covariance is exact before it is rounded to doubles once, and its eigenvectors
are those of the exact matrix to double precision. Nothing depends on how rows are dealt or in which order
they are added.

What comes to the driver is of the size of the scatter matrix, whatever the number of rows; no row is
shuffled. Vectors are read again for the whitened values, which a third pass holds against the identity.

A vector that is null, empty, or holds null or non-finite entries is dropped, as is one whose length is
not the one that most vectors have (ties: the longer). Rows without a vec_id and repeated rows count like
others and have their own results. Entries beyond 2**62 count as 2**62. A deviation beyond the range of a
long is null. Components without variance (an eigenvalue that is not over RANK of the largest) have null
whitened values; vectors of fewer dimensions than components have as many components as dimensions. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS, RANK = 1024, 100_000, 8, 1e-13
#: Rows that are multiplied at once, and the bound of the primes: BLOCK * TOP**2 is 2**53.
BLOCK, TOP = 1 << 13, 1 << 20
LIMIT, LOW = 1 << 62, (1 << 31) - 1

OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, e) of the rows that take part, except for their length."""
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.coalesce(fine, F.lit(False)))


def whole_numbers(column: pa.Array) -> np.ndarray:
    """The entries of a column of equally long vectors as whole numbers, a row for each vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        x = np.floor(np.clip(flat * SCALE, -LIMIT + 2 * SHIFT, LIMIT - 2 * SHIFT)).astype(np.int64) + SHIFT
    return x.reshape(len(column), -1)


def primes(bound: int) -> list[int]:
    """The largest primes below TOP, as many as have a product over ``bound``."""
    out, product, p = [], 1, TOP
    while product <= bound:
        p -= 1
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
    return out


def remainder(residues: dict[int, int]) -> int:
    """The whole number nearest 0 with these residues (prime: residue)."""
    product = 1
    for p in residues:
        product *= p
    x = sum(r * (product // p) * pow(product // p, -1, p) for p, r in residues.items()) % product
    return x - product if 2 * x > product else x


def sums(rows: DataFrame) -> dict[int, Row]:
    """For each dimension the sum, least and largest of the whole numbers, exactly."""

    def run(batches):
        low = high = least = most = None
        for b in batches:
            if not b.num_rows:
                continue
            x = whole_numbers(b.column("e"))
            a, c = (x & LOW).sum(0), (x >> 31).sum(0)  # no sum of a partition overflows
            low, high = (a, c) if low is None else (low + a, high + c)
            least = x.min(0) if least is None else np.minimum(least, x.min(0))
            most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(low), dtype=np.int32), "low": low, "high": high, "least": least, "most": most})

    parts = rows.select("e").mapInArrow(run, "i int, low long, high long, least long, most long")
    exact = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("low", "high")]
    return {r["i"]: r for r in parts.groupBy("i").agg(*exact, F.min("least").alias("least"), F.max("most").alias("most")).collect()}


def products(rows: DataFrame, mean: np.ndarray, moduli: list[int]) -> list[list[int]]:
    """The exact sum of y y' over all vectors, y being the numbers less ``mean``."""
    d = len(mean)

    def run(batches):
        totals = [np.zeros((d, d), np.int64) for _ in moduli]
        for b in batches:
            y = whole_numbers(b.column("e")) - mean
            for at in range(0, len(y), BLOCK):
                for total, p in zip(totals, moduli, strict=True):
                    r = (y[at : at + BLOCK] % p).astype(np.float64)
                    total += (r.T @ r).astype(np.int64) % p
        i, j = np.triu_indices(d)
        for total, p in zip(totals, moduli, strict=True):
            yield pa.RecordBatch.from_pydict({"p": np.full(len(i), p, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "r": total[i, j] % p})

    parts = rows.select("e").mapInArrow(run, "p int, i int, j int, r long")
    residues: dict[tuple[int, int], dict[int, int]] = {}
    for r in parts.groupBy("p", "i", "j").agg(F.sum("r").alias("r")).collect():
        residues.setdefault((r["i"], r["j"]), {})[r["p"]] = r["r"] % r["p"]
    out = [[0] * d for _ in range(d)]
    for (i, j), of in residues.items():
        out[i][j] = out[j][i] = remainder(of)
    return out


@dataclass
class Whitening:
    """The number of vectors, exact sums, and the leading components; ``scale`` is nan without variance."""

    n: int
    total: list[int]
    vectors: np.ndarray
    scale: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(n: int, total: list[int], scatter: list[list[int]], components: int) -> Whitening:
        """From the exact n * sum((x - S/n)(x - S/n)')."""
        v = np.array([[c / (n * n) for c in row] for row in scatter])
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        trace = sum(scatter[i][i] for i in range(len(total))) / (n * n)
        seen = values > RANK * max(values[0], 0)
        explained = np.where(seen, values / (trace or 1.0), 0.0)
        return Whitening(n, total, vectors, np.where(seen, 1 / np.sqrt(np.where(seen, values, 1)), np.nan), explained)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n, rounded once, and the exact sum of the squares of n*x - S (-1: no long)."""
        n, total = self.n, self.total
        far = max(max((abs(n * int(v) - t) for v in (x[:, i].min(), x[:, i].max())), default=0) for i, t in enumerate(total)) if len(x) else 0
        if far < 1 << 53:
            d = n * (x - [t // n for t in total]) - [t % n for t in total]
            squares = d**2 if far * far * len(total) < 1 << 63 else d.astype(object) ** 2
            return d / n, np.array([s if s < 1 << 63 else -1 for s in squares.sum(1).tolist()], np.int64)
        d = x.astype(object) * n - np.array(total, object)
        exact = np.array([[c / n for c in row] for row in d.tolist()])
        return exact.reshape(x.shape), np.array([s if s < 1 << 63 else -1 for s in (d**2).sum(1).tolist()], np.int64)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return deviations @ self.vectors * self.scale


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(vec_id, e) of the vectors that take part, and their whitening; None without any."""
    rows = usable(vectors)
    length = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    if length is None:
        return rows, None
    d, n = length["d"], length["count"]
    rows = rows.where(F.size("e") == d)
    of = sums(rows)
    total = [(int(of[i]["high"]) << 31) + int(of[i]["low"]) for i in range(d)]
    mean = np.array([t // n for t in total], np.int64)
    far = max(max(abs(int(of[i]["least"]) - int(mean[i])), abs(int(of[i]["most"]) - int(mean[i]))) for i in range(d))
    y = products(rows, mean, primes(2 * n * far * far + 1))
    left = [t - n * int(m) for t, m in zip(total, mean, strict=True)]
    scatter = [[n * y[i][j] - left[i] * left[j] for j in range(d)] for i in range(d)]
    return rows, Whitening.of(n, total, scatter, min(components, d))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, components without variance
    left out."""
    k = len(w.scale)

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                z = w.whitened(w.deviations(whole_numbers(b.column("e")))[0])
                total += z.T @ z
        i, j = np.indices((k, k)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "s": total.reshape(-1)})

    parts = rows.select("e").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max((abs(r["s"] / w.n - (r["i"] == r["j"])) for r in parts if np.isfinite(r["s"])), default=0.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For embeddings (vec_id, embedding) a row for each vector that takes part and each component: the
    whitened value, the component's share of the variance, the vector's exact deviation from the mean, and
    how far the whitened vectors are from unit covariance."""
    rows, w = fit(vectors, components)
    if w is None:
        return vectors.sparkSession.createDataFrame([], OUTPUT)
    error, k = identity_error(rows, w), len(w.scale)

    def run(batches):
        for b in batches:
            deviations, squares = w.deviations(whole_numbers(b.column("e")))
            z, m = w.whitened(deviations), b.num_rows
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(pa.array(at)),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                "n": np.full(m * k, w.n),
                "deviation": pa.array(squares[at], mask=squares[at] < 0),
                "whitened": pa.array(z.reshape(-1), mask=np.isnan(z.reshape(-1))),
                "explained": np.tile(w.explained, m),
                "identity_error": np.full(m * k, error),
            })

    return rows.mapInArrow(run, OUTPUT)
