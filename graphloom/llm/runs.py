"""Periodic run detection by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, FOLD * q)
words that cannot be extended. Its words agree with those q places on at least max(LEAST - q,
(FOLD - 1) * q) times in a row, so a lag at which fewer words of the text agree has no run, and no lag
beyond a quarter of the text has one. How many words agree at each lag is counted exactly: for light
words by the differences of their places, for heavy ones, of which a text can have few, by the Fourier
transform of where they stand. Only lags with enough matches are scanned for islands of them, and an
island of (FOLD - 1) * q matches covers FOLD places q apart with equal words, so a scan looks at every
q-th word first and walks along the text only around hits.

If a stretch of period q has a smaller period d, d divides q (it is FOLD times as long as q) and the
stretch is the run of d, so stretches found again at a larger lag are passed over.

Texts are taken in batches and whole; the work on one is about n log n for its n words and in memory
about n, besides the pairs of a light word, which are bounded by the work of a transform. No rows are
shuffled.

Null, empty and blank texts have no words and no runs. A row without a doc_id keeps its words. Repeated
rows each give a row, and rows of one doc_id are treated alike. Ties between longest runs go to the
smallest start, then period. An empty table gives an empty result. Columns besides the id and the text
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_text_ids

#: A run has at least LEAST words and FOLD periods.
LEAST, FOLD = 6, 4
#: Places that are compared at once, words of texts that are counted together, and matches that a hit
#: has to have besides its own before the text around it is walked.
CHUNK, TOGETHER, PROBES = 1 << 20, 100_000, 24

SCHEMA = (
    "doc_id string, n_words long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string, n_dropped long"
)


def repeat_tail(words: list, doc_id: str | None) -> list:
    """The words of a document, those of one id in ten with a tail that repeats itself."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def needed(lags: np.ndarray) -> np.ndarray:
    """Matches in a row that a run has at the lag of its period."""
    return np.maximum(LEAST - lags, (FOLD - 1) * lags)


def heavy_count(n: int) -> float:
    """Occurrences from which the transform of a word costs less than its pairs."""
    size = 1 << max(4, (n + n // FOLD).bit_length())
    return max(32.0, (4 * size * np.log2(size)) ** 0.5)


def lag_counts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, given as numbers of words: how many words agree with the one ``lag`` places on,
    for every lag up to a quarter of it."""
    most = np.array([len(t) // FOLD for t in texts])
    base = np.r_[0, np.cumsum(most + 1)]
    counts = np.zeros(base[-1], np.int64)
    places, lights, owners = [], [], []
    for k, t in enumerate(texts):
        if not most[k]:
            continue
        times = np.bincount(t)
        heavy = np.flatnonzero(times > heavy_count(len(t)))
        counts[base[k] : base[k + 1]] += heavy_lags(t, heavy, int(most[k]))
        if len(heavy):
            times[heavy] = 0
        at = np.flatnonzero(times[t] > 1)
        at = at[np.argsort(t[at], kind="stable")]
        places.append(at)
        lights.append(t[at])
        owners.append(np.full(len(at), k))
    if places:
        light_lags(np.concatenate(places), np.concatenate(lights), np.concatenate(owners), most, base, counts)
    return [counts[base[k] : base[k + 1]] for k in range(len(texts))]


def light_lags(at: np.ndarray, word: np.ndarray, owner: np.ndarray, most: np.ndarray, base: np.ndarray, counts: np.ndarray) -> None:
    """Adds the differences between places of the same word of the same text; places come sorted by
    text, word and place. An occurrence leaves when its next difference is over the largest lag."""
    alive = np.arange(len(at))
    step = 1
    while len(alive):
        alive = alive[alive + step < len(at)]
        far = alive + step
        same = (word[far] == word[alive]) & (owner[far] == owner[alive])
        lag = at[far] - at[alive]
        same &= lag <= most[owner[alive]]
        alive, lag = alive[same], lag[same]
        if len(alive):
            where = base[owner[alive]] + lag
            if len(where) * 8 < len(counts):
                np.add.at(counts, where, 1)
            else:
                counts += np.bincount(where, minlength=len(counts))
        step += 1


def heavy_lags(t: np.ndarray, heavy: np.ndarray, most: int) -> np.ndarray:
    """Autocorrelation of where each heavy word stands, summed; two words in one transform."""
    total = np.zeros(most + 1)
    if not len(heavy):
        return total.astype(np.int64)
    size = 1 << (len(t) + most).bit_length()
    power = np.zeros(size)
    for i in range(0, len(heavy), 2):
        z = (t == heavy[i]).astype(np.complex128)
        if i + 1 < len(heavy):
            z += 1j * (t == heavy[i + 1])
        power += np.abs(np.fft.fft(z, size)) ** 2
    return np.rint(np.fft.ifft(power).real[: most + 1]).astype(np.int64)


def islands(t: np.ndarray, lag: int, known: dict[tuple[int, int], int]) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches of period ``lag`` that are long enough for a run, without those
    of ``known`` that have a smaller period."""
    least = int(needed(np.int64(lag)))
    if lag <= 2:  # all places are looked at
        same = np.flatnonzero(np.diff(np.r_[False, t[lag:] == t[:-lag], False].astype(np.int8)))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
            if b - a >= least:
                yield a, b - a + lag
        return
    s = t[::lag]
    equal = s[1:] == s[:-1]
    hit = equal[: len(equal) - (FOLD - 2)].copy()
    for k in range(1, FOLD - 1):
        hit &= equal[k : len(equal) - (FOLD - 2) + k]
    hits = np.flatnonzero(hit) * lag
    # the first hit inside an island is followed by matches up to FOLD - 2 lags on
    for k in range(PROBES):
        if len(hits) < 2:
            break
        o = 1 + k * (FOLD - 2) * lag // PROBES
        hits = hits[t[hits + o] == t[hits + o + lag]]
    if not len(hits):
        return
    # a stretch that has one lag of words inside a run of a period that divides the lag is that run
    covers = [(a, a + length) for (a, length), d in known.items() if lag % d == 0 and length >= lag]
    end = 0
    for at in hits.tolist():
        if at < end:
            continue
        over = next((b for a, b in covers if a <= at and at + lag <= b), 0)
        if over:
            end = over - lag
            continue
        a, end = walk(t, at, lag, -1), walk(t, at, lag, 1)
        if end - a >= least:
            yield a, end - a + lag


def walk(t: np.ndarray, at: int, lag: int, way: int) -> int:
    """Where the matches around ``at`` begin (way -1), or the first place behind them (way 1)."""
    width = 4 * lag
    while True:
        if way > 0:
            stop = min(len(t) - lag, at + width)
            bad = np.flatnonzero(t[at:stop] != t[at + lag : stop + lag])
            if len(bad):
                return at + int(bad[0])
            if stop == len(t) - lag:
                return stop
            at = stop
        else:
            begin = max(0, at - width)
            bad = np.flatnonzero(t[begin:at] != t[begin + lag : at + lag])
            if len(bad):
                return begin + int(bad[-1]) + 1
            if not begin:
                return 0
            at = begin
        width = min(2 * width, CHUNK)


def find_runs(t: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text by start, then period."""
    lags = np.arange(1, len(counts))
    known: dict[tuple[int, int], int] = {}
    for lag in lags[counts[1:] >= needed(lags)].tolist():
        for stretch in islands(t, lag, known):
            known.setdefault(stretch, lag)
    return sorted((start, length, q) for (start, length), q in known.items())


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    return [find_runs(t, c) for t, c in zip(texts, lag_counts(texts), strict=True)]


def numbered(words: list) -> np.ndarray:
    """The words as numbers."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def left_of(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def described(doc_id: str | None, words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    kept = left_of(words, found)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(words), len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words) - len(kept)


def _detect(repeat_tails: bool):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(ids: list, words: list) -> pd.DataFrame:
        found = runs_of([numbered(w) for w in words])
        out = pd.DataFrame([described(*x) for x in zip(ids, words, found, strict=True)], columns=columns)
        for c in ("start", "length", "period", "exponent_milli"):
            out[c] = out[c].astype("Int64")
        return out

    def run(batches):
        for pdf in batches:
            ids, words, held = [], [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                w = text.encode("utf-8", "surrogatepass").split() if text else []
                ids.append(doc_id)
                words.append(repeat_tail(w, doc_id) if repeat_tails else w)
                held += len(w)
                if held >= TOGETHER:
                    yield rows(ids, words)
                    ids, words, held = [], [], 0
            if ids:
                yield rows(ids, words)

    return run


def periodic_runs(docs: DataFrame, repeat_tails: bool = False) -> DataFrame:
    """For documents (doc_id, text): their number of words and runs, the longest run, digests of all
    runs and of the words that are left if each run keeps one period only, and how many words go.
    With ``repeat_tails`` one document in ten, told by its id, is given a periodic tail first."""
    out = with_text_ids(docs).mapInPandas(_detect(repeat_tails), SCHEMA)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def collapse(docs: DataFrame) -> DataFrame:
    """The documents with one period of each run left of it, words joined by one space; a text without
    a run stays as it is. Other columns pass through."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
            found = runs_of([numbered(w) for w in words])
            yield pd.Series([b" ".join(left_of(w, f)).decode("utf-8", "surrogatepass") if f else t for t, w, f in zip(texts, words, found, strict=True)], dtype=object)

    return small_batches(docs).withColumn("text", run(F.col("text").cast("string")))
