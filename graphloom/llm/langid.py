"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut greedily into the
longest phrases that occur in that text (Ziv-Merhav cross-parsing); the language whose text explains
it in the fewest phrases, each weighted with the bits that a position in the language's text costs,
wins. Texts are parsed whole, in windows of WINDOW characters whose boundary ends a phrase in every
language alike; the windows of many texts advance through the transition tables together.

Labels are learnt from a bounded sample of rows: per language the SAMPLE_DOCS different texts that come
first by hash, of any length. Texts are cut into passages of PASSAGE characters, all of each text, and of
the passages of a language's sample those that come first by hash are learnt, SAMPLE_CHARS characters or
a passage more. How often a text is repeated, how long it is and how many rows other languages have makes
no difference, and a language with any text that has a letter is learnt. Texts that are null or have no letter are ``und`` with
score 0. Ties go to the first language by name. Repeated rows each give a row; other columns than
doc_id, text and, for learning, lang are not read. Without any labelled text all are ``und``.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import built_once, cut, held_out, small_batches

SAMPLE_CHARS, SAMPLE_DOCS, PASSAGE, WINDOW, SHARPNESS = 20_000, 400, 1000, 512, 8.0
#: Letters of a language that have a column in its transition table, its most frequent ones, the space
#: among them. Transitions by its other letters are looked up in a sorted list.
ALPHABET = 200
UNDETERMINED = "und"


def normal(text: str) -> str:
    return text.lower()


class Automaton:
    """The suffix automaton of a text; state 0 has no transitions and means that the phrase ends."""

    def __init__(self, symbols: list[int]):
        following: list[dict[int, int]] = [{}, {}]
        link, longest = [0, 0], [0, 0]
        last = 1
        for s in symbols:
            new = len(following)
            following.append({})
            longest.append(longest[last] + 1)
            link.append(1)
            at = last
            while at and s not in following[at]:
                following[at][s] = new
                at = link[at]
            if at:
                target = following[at][s]
                if longest[target] == longest[at] + 1:
                    link[new] = target
                else:
                    copy = len(following)
                    following.append(dict(following[target]))
                    longest.append(longest[at] + 1)
                    link.append(link[target])
                    while at and following[at].get(s) == target:
                        following[at][s] = copy
                        at = link[at]
                    link[target] = link[new] = copy
            last = new
        self.following = following

    def table(self, letters: int) -> Transitions:
        """Its transitions by symbols 1 to ``letters``, the first ALPHABET of them as columns."""
        width = min(letters, ALPHABET) + 1
        dense, rare = np.zeros((len(self.following), width), np.int32), []
        for state, out in enumerate(self.following):
            for s, target in out.items():
                if s < width:
                    dense[state, s] = target
                else:
                    rare.append((state * (letters + 1) + s, target))
        rare.sort()
        dense[:, 0] = 0
        return Transitions(dense.ravel(), width, letters + 1, np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32))


class Transitions:
    def __init__(self, dense: np.ndarray, width: int, symbols: int, keys: np.ndarray, targets: np.ndarray):
        self.dense, self.width, self.symbols, self.keys, self.targets = dense, width, symbols, keys, targets

    def step(self, state: np.ndarray | int, c: np.ndarray) -> np.ndarray:
        """The states after symbols ``c``, 0 where there is no transition."""
        if not len(self.keys):
            return self.dense[state * self.width + c]
        new = self.dense[state * self.width + np.where(c < self.width, c, 0)]
        rare = np.flatnonzero(c >= self.width)
        if len(rare):
            before = state[rare] if isinstance(state, np.ndarray) else state
            wanted = before * np.int64(self.symbols) + c[rare]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            new[rare] = np.where(self.keys[at] == wanted, self.targets[at], 0)
        return new


class Model:
    """Languages with their texts; tables are built where they are used."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.texts = {k: normal(v) for k, v in texts.items()}

    def key(self) -> str:
        return "langid-" + hashlib.sha256(repr(sorted(self.texts.items())).encode("utf-8", "replace")).hexdigest()

    def build(self) -> Parser:
        return Parser(self)


class Parser:
    def __init__(self, model: Model):
        self.langs = model.langs
        letters = {lang: Counter(c for c in t if c == " " or c.isalpha()) for lang, t in model.texts.items()}
        every = sorted(set().union(*letters.values()))
        kind = np.uint8 if len(every) < 256 else np.int32
        self.code = np.zeros(0x110000, kind)  # 0: ends a phrase, and is one, in every language
        for i, c in enumerate(every):
            self.code[ord(c)] = i + 1
        self.cost, self.own, self.tables = np.zeros(len(self.langs)), [], []
        for k, lang in enumerate(self.langs):
            # a letter that the language's text has not is 0 there, as no phrase of it has the letter
            ranked = sorted(letters[lang], key=lambda c: (-letters[lang][c], c))
            own = np.zeros(len(every) + 1, kind)
            own[[self.code[ord(c)] for c in ranked]] = np.arange(1, len(ranked) + 1)
            symbols = own[self.codes(model.texts[lang])].tolist()
            self.cost[k] = math.log2(max(2, len(symbols)))
            self.own.append(own)
            self.tables.append(Automaton(symbols).table(len(ranked)))

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    def phrases(self, windows: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
        """Phrases in language k of each row of codes, whose first lengths count; rows come longest first."""
        n, root, table = len(windows), 1, self.tables[k]
        state, found = np.full(n, root, np.int32), np.zeros(n, np.int64)
        columns = self.own[k][np.ascontiguousarray(windows.T)]
        live = np.searchsorted(-lengths, -np.arange(windows.shape[1]), side="left")
        for j, most in enumerate(live):
            if not most:
                break
            c = columns[j, :most]
            new = table.step(state[:most], c)
            ended = np.flatnonzero(new == 0)
            if len(ended):
                begun = table.step(root, c[ended])
                found[ended] += state[ended] != root
                found[ended] += begun == 0  # no phrase begins here: the character is one
                new[ended] = np.where(begun == 0, root, begun)
            state[:most] = new
        return found + (state != root)

    def bits(self, texts: list[str]) -> np.ndarray:
        """Bits a character for each text and language."""
        coded = [self.codes(normal(t)) for t in texts]
        owner, parts = [], []
        for i, c in enumerate(coded):
            for at in range(0, len(c), WINDOW):
                owner.append(i)
                parts.append(c[at : at + WINDOW])
        if not parts:
            return np.zeros((len(texts), len(self.langs)))
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        flat = np.zeros((len(parts), int(lengths.max())), self.code.dtype)
        for row, i in enumerate(order):
            flat[row, : lengths[i]] = parts[i]
        who, size = np.array(owner)[order], np.maximum(1, np.array([len(c) for c in coded]))
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            n = np.bincount(who, self.phrases(flat, lengths[order], k), len(texts))
            out[:, k] = n * self.cost[k] / size
        return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)


def fit(docs: DataFrame) -> Model:
    """Learns from documents (doc_id, text, lang) that are not held out, in two scans. SAMPLE_CHARS
    characters per language and little more come to the driver."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text", F.lit(17)).alias("h"))
    # of each language some more texts than needed by a threshold on the hash, so that few are ranked
    share = F.least(F.lit(1.0), 4 * SAMPLE_DOCS / F.approx_count_distinct("h", 0.02))
    limits = cut(known.groupBy("lang").agg(F.floor(share * 2**32 - 2**31).alias("below")), "shares")
    some = known.join(limits, "lang").where(F.shiftright("h", 32) < F.col("below")).select("lang", "text", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = cut(some.withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS).select("lang", "text"), "sample")
    passages = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))
    coded = F.transform(F.filter(passages, lambda p: p.rlike(r"\p{L}")), lambda p: F.struct(F.xxhash64(p, F.lit(18)).alias("h"), p.alias("passage")))
    # all but the last passage of a text are whole, so a text has no more of the first ones
    first = F.slice(F.array_sort(F.array_distinct(coded)), 1, SAMPLE_CHARS // PASSAGE + 2)
    rows = sample.select("lang", F.explode(first).alias("x")).select("lang", "x.*").distinct()
    before = F.sum(F.length("passage")).over(Window.partitionBy("lang").orderBy("h", "passage").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE_CHARS)
    samples: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "before").select("lang", "passage").collect():
        samples.setdefault(r["lang"], []).append(r["passage"])
    return Model({lang: "\n".join(found) for lang, found in samples.items()})


def predictor(model: Model):
    """A function of a text column; gives (lang_pred, score). score is the share of the winner when
    each language weighs 2 to the minus SHARPNESS times its bits a character."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = built_once(model.key(), model.build)
        for batch in batches:
            langs, scores = [UNDETERMINED] * len(batch), [0.0] * len(batch)
            for group in groups_of((i, len(t)) for i, t in enumerate(batch) if t and parser.langs and has_letter(t)):
                b = parser.bits([batch.iloc[i] for i in group])
                weight = np.exp2(-SHARPNESS * (b - b.min(1, keepdims=True)))
                for i, k, w in zip(group, b.argmin(1), 1 / weight.sum(1), strict=True):
                    langs[i], scores[i] = parser.langs[k], float(w)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict.asNondeterministic()  # so that a filter on the result does not run it twice


def groups_of(items: Iterable[tuple[int, int]], most: int = 1_000_000) -> Iterator[list[int]]:
    """Numbers in groups whose sizes add up to ``most`` or little more."""
    group, held = [], 0
    for i, size in items:
        group.append(i)
        held += size
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``, in place of columns of these names."""
    out = small_batches(docs).withColumn("__found", predictor(model)(F.col("text").cast("string")))
    return out.withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")
