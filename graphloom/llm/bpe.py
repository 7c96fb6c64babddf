"""BPE encoding and decoding through a table of distinct words.

Texts are split into words once. A block of texts, BLOCK_CHARS long, has a table of its distinct words,
each encoded once; occurrences are codes into that table, and their ids are put back by position. One
table for all blocks was measured first: invented and rare words make most of a table, so that sending
them and the codes to a common place took more disk than the texts and saved few encodings (README).
:func:`decode` joins ids with the id-to-piece table, whose size is that of the vocabulary. The digests
of texts and ids look pieces up in that table where the ids are made, for the same reason (README).

Null and empty texts have no ids and decode to the empty text. Strings of added tokens inside a text
become those tokens, as in the library's own encode. Repeated rows each give a row; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built_once, with_text_ids

#: Fixed value: the pattern by which byte-level BPE vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 5_000_000


class Vocabulary:
    """What encoding and decoding need of a tokenizer file; pickles as the file's text."""

    def __init__(self, spec: str):
        self.spec = spec

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def key(self) -> str:
        return "pieces-" + hashlib.sha256(self.spec.encode()).hexdigest()

    def added(self) -> list[str]:
        return [t["content"] for t in json.loads(self.spec)["added_tokens"]]

    def tokenizer(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.spec)
        t.no_truncation()
        t.no_padding()
        return t

    def word_encoder(self):
        """A function from a word to its ids: the merges of the vocabulary, applied to the characters
        that stand for the word's bytes."""
        model = self.tokenizer().model
        known = {t["content"]: [t["id"]] for t in json.loads(self.spec)["added_tokens"]}
        shown = str.maketrans({chr(b): c for b, c in self.characters().items()})

        def encode(word: str) -> list[int]:
            if word in known:
                return known[word]
            return [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(shown))]

        return encode

    @staticmethod
    def characters() -> dict[int, str]:
        """How the file writes each byte: as its own character if that is visible in Latin-1, and else
        as the next unused character from U+0100 on."""
        plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
        other = (b for b in range(256) if b not in plain)
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}

    def pieces(self) -> list[bytes]:
        """Bytes of each id."""
        shown = {c: b for b, c in self.characters().items()}
        model = json.loads(self.spec)
        out = {i: bytes(shown[c] for c in piece) for piece, i in model["model"]["vocab"].items() if all(c in shown for c in piece)}
        out |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        return [out.get(i, b"") for i in range(max(out) + 1)]


class Words(dict):
    """Code of each word, in order of first appearance."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def splitter(added: list[str]):
    """A function from a text to its words; strings of added tokens are words of their own."""
    find = regex.compile(PATTERN).findall
    if not added:
        return find
    mark = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        if not any(a in text for a in added):
            return find(text)
        out: list[str] = []
        for i, part in enumerate(mark.split(text)):
            out += [part] if i % 2 else find(part)
        return out

    return split


def encode_block(texts: list[str | None], split, encode_word) -> list[np.ndarray]:
    """Ids of each text: every distinct word of the block is encoded once, and its ids are gathered
    into the places of the word."""
    words = Words()
    coded = [np.fromiter(map(words.__getitem__, found), np.int64, len(found)) for found in (split(t) if t else () for t in texts)]
    ids = list(map(encode_word, words))
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    start = np.cumsum(size) - size
    flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(size.sum()))
    out = []
    for codes in coded:
        n = size[codes]
        at = np.arange(n.sum()) + np.repeat(start[codes] - (np.cumsum(n) - n), n)
        out.append(flat[at])
    return out


def _encoded(vocabulary: Vocabulary, columns):
    """Rows of ``columns(ids of each text)`` for blocks of texts."""

    def run(batches):
        split, encode_word = splitter(vocabulary.added()), vocabulary.word_encoder()
        ids, texts, chars = [], [], 0

        def flush():
            return pd.DataFrame({"doc_id": ids} | columns(encode_block(texts, split, encode_word)))

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids.append(doc_id)
                texts.append(text)
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield flush()
                    ids, texts, chars = [], [], 0
        if ids:
            yield flush()

    return run


def _with_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) for documents (doc_id, text); ids is binary, 4 bytes an id."""
    run = _encoded(vocabulary, lambda ids: {"ids": [x.tobytes() for x in ids]})
    return _with_ids(with_text_ids(docs).mapInPandas(run, "doc_id string, ids binary"))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, text) for the result of :func:`encode`: a join of every id with the id-to-piece
    table, whose rows are put together again by position. Bytes that are no UTF-8 become U+FFFD."""
    spark = encoded.sparkSession
    pieces = spark.createDataFrame([(i, p.hex()) for i, p in enumerate(vocabulary.pieces())], "id long, piece string")
    rows = encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))

    @F.pandas_udf("array<long>")
    def numbers(x: pd.Series) -> pd.Series:
        return x.map(lambda b: np.frombuffer(b, "<u4").astype(np.int64))

    placed = rows.select("row", F.posexplode(numbers("ids")).alias("position", "id")).join(F.broadcast(pieces), "id")
    hexes = placed.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"]), "").alias("hex"))
    text = F.make_valid_utf8(F.unhex(F.coalesce("hex", F.lit(""))).cast("string"))
    return rows.join(hexes, "row", "left").select("doc_id", "ids", text.alias("text"))


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encode and decode return."""

    def columns(ids: list[np.ndarray]) -> dict[str, list]:
        pieces = built_once(vocabulary.key(), vocabulary.pieces)
        texts = (b"".join(map(pieces.__getitem__, x.tolist())).decode("utf-8", "replace").encode() for x in ids)
        return {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
        }

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _with_ids(with_text_ids(docs).mapInPandas(_encoded(vocabulary, columns), schema))
