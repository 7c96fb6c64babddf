"""Word shingles of a text as a sorted array of distinct 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import xxhash

from .common import M1, mix

#: Words that are hashed at once, or those of one text.
CHUNK = 30_000
NO_SHINGLES = np.empty(0, np.uint64)


class WordHashes(dict):
    """Hash of each word seen, kept between texts; emptied at ``limit`` words to bound memory."""

    def __init__(self, limit: int = 50_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case. Each run of
    ``width`` words is a shingle; a shorter text has its whole sequence as one, none if empty."""
    words = words_of(text)
    if not words:
        return NO_SHINGLES
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return distinct(windows(h, min(width, len(h))))


def shingle_sets(texts: Iterable[str | None], width: int) -> Iterator[np.ndarray]:
    """The set of each text, as :func:`shingle_set` has it, the words of many texts at once. A word is
    hashed wherever it stands: to look up words that were seen takes longer."""
    held, n = [], 0
    for text in texts:
        held.append(words_of(text))
        n += len(held[-1])
        if n >= CHUNK:
            yield from _sets(held, width)
            held, n = [], 0
    yield from _sets(held, width)


def _sets(texts: list[list[bytes]], width: int) -> Iterator[np.ndarray]:
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(texts))), ">u8").astype(np.uint64)
    every = windows(h, width) if len(h) >= width else NO_SHINGLES
    at = 0
    for words in texts:
        n = len(words)
        yield distinct(every[at : at + n - width + 1]) if n >= width else windows(h[at : at + n], n) if n else NO_SHINGLES
        at += n


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def windows(h: np.ndarray, span: int) -> np.ndarray:
    """A hash of each ``span`` successive ones."""
    n = len(h) - span + 1
    out = np.full(n, span, np.uint64)
    for k in range(span):
        out = mix((out + M1) ^ h[k : k + n])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """What ``np.unique`` returns, which takes longer on whole numbers."""
    x = np.sort(x)
    return x[unlike_last(x)]


def unlike_last(x: np.ndarray) -> np.ndarray:
    """Whether each number is unlike the one before; true for the first."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out
