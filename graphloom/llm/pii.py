"""Personal data by weak supervision.

Spans of four kinds are proposed: those of the base patterns, which always stay, and looser shapes
(written-out or dotless mail addresses, IPv6 addresses, national phone numbers, card numbers with a
wrong or without a check digit). Labelers vote for, against or not at all on each proposal: three of
them by pattern, one by gazetteers of top-level domains, calling codes, card issuers and reserved
addresses, three by context. Nobody labels anything: how often each labeler votes how on true and on
false spans is estimated by expectation-maximisation, for each kind. That gives each pattern of votes a
probability, on which a logistic classifier of the span's own features is trained. It decides on the
proposals beyond the base ones, also where labelers abstain.

Votes are one of 3**LABELERS codes and features one of 2**FEATURES, so what the estimates need is a
count for each code, summed in Spark over all documents. Only these counts come to the driver, and
nothing depends on the order in which they are summed. Texts are read once; proposals are written to an
intermediate table that holds positions and codes, not texts.

Patterns are matched in time linear in the text, so that long runs of letters or digits do no harm.
Null and empty texts have no spans. Very long texts are searched whole. Spans of different kinds may
overlap, among base ones; an added span overlaps no other span. Spans that start together come in the
order of KINDS. Repeated rows and rows without a doc_id each give a row. An empty table gives an empty
result. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, with_text_ids

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# ---- base patterns

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
HOST = re.compile(r"[A-Za-z0-9-]++")
#: A match cannot begin inside a run of digits: from its beginning it would have failed alike.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMBER = re.compile(r"[0-9](?:[ -]?+[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, base): the characters before each @, and a domain behind it or, where base is
    false, a name without a dot. Found from the @, since the runs of characters before may be long."""
    begin, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > begin and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            domain = DOMAIN.match(text, at + 1)
            if domain:
                yield start, domain.end(), True
                begin = domain.end()
            elif host := HOST.match(text, at + 1):
                yield start, host.end(), False
        at = text.find("@", max(at + 1, begin))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def digits_of(span: str) -> str:
    return "".join(DIGIT.findall(span))


def is_address(span: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in span.split("."))


def is_card(span: str) -> bool:
    return 14 <= len(d := digits_of(span)) <= 19 and luhn(d)


def is_phone(span: str) -> bool:
    return 10 <= len(digits_of(span)) <= 15


#: The looser shapes of each kind; all of bounded length.
SHAPES = (
    (EMAIL, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63} ?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot )| at [A-Za-z0-9-]{1,63} dot ) ?[A-Za-z]{2,12}(?![A-Za-z0-9])")),
    (IP, re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (PHONE, re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{3,6}(?![0-9A-Za-z])(?![ .-][0-9])")),
)
#: What a text must hold for the looser shapes of a kind.
HINTS = {EMAIL: re.compile(r"[\[({]at[\])}]| dot "), IP: re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]"), PHONE: re.compile(r"[0-9][ ./)-]{1,2}[0-9]")}

# ---- labelers

TLDS = frozenset("com org net edu gov mil int info biz name io co app dev de fr es it nl be ch at uk ie us ca mx br ar cl pt pl cz se no fi dk ru ua tr gr il in cn jp kr au nz za eu example test".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "359", "380", "385", "420", "421", "852", "886", "971", "972")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "644", "65", "30", "36", "38", "35", "50", "56", "62", "67")
NEAR = (
    frozenset("email mail mailto contact write courriel correo kontakt adresse address escribir".split()),
    frozenset("ip ips host server address adresse dirección direccion login client peer".split()),
    frozenset("card visa mastercard amex credit debit carte tarjeta karte kreditkarte payment iban paid".split()),
    frozenset("phone tel telephone call fax mobile cell whatsapp téléphone telephon telefon teléfono telefono appel llamar anruf rufen".split()),
)
AWAY = (
    frozenset("import decorator handle commit".split()),
    frozenset("version release build section chapter kernel firmware v".split()),
    frozenset("isbn order invoice serial tracking ticket checksum hash ean upc".split()),
    frozenset("isbn order invoice serial version page pages lines chapter date score".split()),
)
WORD = re.compile(r"[^\W\d_]+")
LABELERS, FEATURES = 7, 12
#: Characters before a span and words of them that are its context; distance to other personal data.
BEFORE, WORDS, BESIDE = 80, 6, 200


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def propose(text: str) -> list[Span]:
    """The base spans of a text, and looser ones that overlap none of them, by start and kind."""
    base: list[Span] = []
    loose: list[Span] = []
    for start, end, sound in emails(text):
        (base if sound else loose).append(Span(EMAIL, start, end, sound))
    if DIGIT.search(text):
        base += [Span(IP, *m.span(), True) for m in ADDRESS.finditer(text) if is_address(m[0])]
        for m in NUMBER.finditer(text):
            if is_card(m[0]):
                base.append(Span(CARD, *m.span(), True))
            elif m.end() - m.start() <= 40 and 13 <= len(digits_of(m[0])) <= 19:
                loose.append(Span(CARD, *m.span(), False))
        base += [Span(PHONE, *m.span(), True) for m in PLUS.finditer(text) if is_phone(m[0])]
    for kind, shape in SHAPES:
        if HINTS[kind].search(text):
            loose += [Span(kind, *m.span(), False) for m in shape.finditer(text)]
    base.sort(key=lambda s: (s.start, s.kind))
    if not loose:
        return base
    taken = np.array([(s.start, s.end) for s in base], np.int64).reshape(-1, 2)
    starts, ends = taken[:, 0], np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    free = []
    for s in loose:
        before = int(np.searchsorted(starts, s.end))  # base spans that begin before the end of s
        if not before or ends[before - 1] <= s.start:
            free.append(s)
    return sorted(base + free, key=lambda s: (s.start, s.kind))


def shape_vote(s: Span, span: str) -> int:
    """By the look of the span itself."""
    if s.kind == EMAIL:
        return 1 if any(c.isalpha() for c in span.partition("@")[0]) or s.base else -1
    if s.kind == IP:
        return 1 if "." in span and not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) or span.count(":") == 7 or "::" in span else -1
    groups = re.split(r"[^0-9]+", span.strip("+()"))
    if s.kind == CARD:
        return 1 if len(groups) == 1 or {len(g) for g in groups[:-1]} == {4} or [len(g) for g in groups] == [4, 6, 5] else -1
    return 1 if span.count("(") == span.count(")") and 7 <= sum(map(len, groups)) <= 15 and span.count("(") < 2 else -1


def gazetteer_vote(kind: int, span: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[^a-z0-9]+", span.lower().rstrip(")]}"))[-1] in TLDS else -1
    if kind == IP:
        if ":" in span:
            return 0
        first = int(span.partition(".")[0])
        return -1 if first in (0, 127) or first >= 224 else 1
    digits = digits_of(span)
    if kind == CARD:
        return 1 if digits.startswith(ISSUERS) else -1
    if span[0] == "+" or digits.startswith("00"):
        return 1 if digits.removeprefix("00").startswith(CALLING) else -1
    return 0


def votes_of(text: str, s: Span, span: str, before: list[str], alone: bool) -> list[int]:
    """Pattern: the base pattern, the look, the borders. Gazetteers. Context: words that point to the
    kind, words that point away, other personal data beside it."""
    left, right = text[s.start - 1 : s.start], text[s.end : s.end + 1]
    glued = left.isalnum() or right.isalnum() or s.kind != EMAIL and left in ("_", "=", "#", "/")
    strict = 1 if s.base else -1 if s.kind == CARD and not luhn(digits_of(span)) else 0
    near, away = not NEAR[s.kind].isdisjoint(before), not AWAY[s.kind].isdisjoint(before)
    return [strict, shape_vote(s, span), -1 if left and glued else 1, gazetteer_vote(s.kind, span), int(near), -int(away), 0 if alone else 1]


def features_of(text: str, s: Span, span: str, before: list[str]) -> list[bool]:
    digits = digits_of(span)
    left, right = text[s.start - 1 : s.start], text[s.end : s.end + 1]
    return [
        s.base, any(c in " .-" for c in span), "(" in span or "[" in span, span.startswith(("+", "00")), any(c.isalpha() for c in span), len(digits) >= 10, len(digits) >= 13,
        not left or left.isspace(), not right or right.isspace() or right in ".,;:!?)", not NEAR[s.kind].isdisjoint(before), not AWAY[s.kind].isdisjoint(before),
        text[max(0, s.start - 2) : s.start].rstrip().endswith((":", "=")),
    ]


def code(values: list, base: int) -> int:
    out = 0
    for v in values:
        out = out * base + int(v)
    return out


def judged(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(kind, start, end, base, votes, features) of the spans that are proposed."""
    spans = propose(text)
    out = []
    for i, s in enumerate(spans):
        span = text[s.start : s.end]
        before = [w.lower() for w in WORD.findall(text[max(0, s.start - BEFORE) : s.start])[-WORDS:]]
        alone = not any(o.base and o.start - s.end < BESIDE and s.start - o.end < BESIDE for o in spans[max(0, i - 1) : i] + spans[i + 1 : i + 2])
        out.append((*s, code([v + 1 for v in votes_of(text, s, span, before, alone)], 3), code(features_of(text, s, span, before), 2)))
    return out


PARTS = ("kind", "start", "end", "base", "votes", "features")
PROPOSED = "doc_id string, spans array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:int>>"


def _propose_all(batches):
    for pdf in batches:
        found = [judged(t) if t else [] for t in pdf["text"]]
        rows = [[dict(zip(PARTS, s, strict=True)) for s in spans] for spans in found]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": rows})


# ---- estimation


def weigh(counts: dict[int, int], rounds: int = 200, prior: float = 10.0) -> dict[int, float]:
    """From counts of vote codes the probability that a span with these votes is true. Votes are taken
    as independent given the truth; ``prior`` pseudo-votes for each labeler say that it is better than
    chance, which also tells the two classes apart."""
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    votes = np.array([[c // 3**k % 3 for k in range(LABELERS)] for c in codes])
    seen = votes[:, :, None] == np.arange(3)
    belief = np.stack([np.array([0.6, 0.3, 0.1]), np.array([0.1, 0.3, 0.6])]) * prior  # false, true: by vote
    true = 1 / (1 + np.exp(-(votes - 1.0).sum(1)))
    for _ in range(rounds):
        weight = np.stack([(1 - true) * n, true * n])
        share = (weight.sum(1) + 1) / (n.sum() + 2)
        rates = np.einsum("yc,clv->ylv", weight, seen) + belief[:, None]
        rates /= rates.sum(2, keepdims=True)
        logs = np.einsum("clv,ylv->yc", seen, np.log(rates)) + np.log(share)[:, None]
        before, true = true, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(true - before).max() < 1e-10:
            break
    return dict(zip(codes, true.tolist(), strict=True))


def unfold(codes: np.ndarray) -> np.ndarray:
    """A row of FEATURES bits and a one for each code."""
    return np.c_[codes[:, None] >> np.arange(FEATURES) & 1, np.ones(len(codes), int)].astype(float)


def train(counts: list[tuple[int, int, int]], ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic classifier from (features, spans, true ones in millionths): Newton steps on
    the counts."""
    rows = np.array(sorted(counts), float)
    x, n, true = unfold(rows[:, 0].astype(int)), rows[:, 1], rows[:, 2] / 1e6
    w = np.zeros(FEATURES + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (true - n * p) - ridge * w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w


#: Probability from which a proposal beyond the base patterns is a span.
THRESHOLD = 0.6


def fit(proposed: DataFrame) -> list[frozenset[int]]:
    """From (doc_id, spans) the feature codes of each kind that the classifier accepts."""
    spark = proposed.sparkSession
    spans = proposed.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    by_votes = spans.groupBy("kind", "votes").count().collect()
    truth = []
    for kind in range(len(KINDS)):
        of = {r["votes"]: r["count"] for r in by_votes if r["kind"] == kind}
        truth += [(kind, v, round(1e6 * p)) for v, p in (weigh(of) if of else {}).items()]
    if not truth:
        return [frozenset()] * len(KINDS)
    table = F.broadcast(spark.createDataFrame(truth, "kind int, votes int, true long"))  # 4 * 3**LABELERS rows at most
    by_features = spans.join(table, ["kind", "votes"]).groupBy("kind", "features").agg(F.count("*").alias("n"), F.sum("true").alias("true")).collect()
    accepted = []
    for kind in range(len(KINDS)):
        rows = [(r["features"], r["n"], r["true"]) for r in by_features if r["kind"] == kind]
        if not rows:
            accepted.append(frozenset())
            continue
        codes = np.array([r[0] for r in rows])
        score = 1 / (1 + np.exp(-unfold(codes) @ train(rows)))
        accepted.append(frozenset(codes[score >= THRESHOLD].tolist()))
    return accepted


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def decide(spans: list, accepted: list[frozenset[int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans); of added ones that overlap the first stays."""
    base, every, end = [], [], 0
    for s in spans:
        x = (s["kind"], s["start"], s["end"])
        if s["base"]:
            base.append(x)
            every.append(x)
        elif s["start"] >= end and s["features"] in accepted[s["kind"]]:
            every.append(x)
            end = s["end"]
    return base, every


def _decide_all(accepted: list[frozenset[int]]):
    def run(batches):
        for pdf in batches:
            rows = [decide(spans, accepted) for spans in pdf["spans"]]
            out = pd.DataFrame({"doc_id": pdf["doc_id"]})
            for k, kind in enumerate(KINDS):
                out["n_" + kind] = [sum(s[0] == k for s in base) for base, _ in rows]
            out["base_sha256"] = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows]
            out["spans"] = [listed(every) for _, every in rows]
            out["n_added"] = [len(every) - len(base) for base, every in rows]
            yield out

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """For documents (doc_id, text): how many base spans of each kind, a digest of them, all spans as
    ``kind:start:end`` in code points, and how many were added to the base ones."""
    proposed = cut(with_text_ids(docs).mapInPandas(_propose_all, PROPOSED), "spans")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    out = proposed.mapInPandas(_decide_all(fit(proposed)), f"doc_id string, {counts}, base_sha256 string, spans string, n_added long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with ``<kind>`` in place of each span; where spans overlap, in place of all of them
    together, by the first. Other columns pass through."""
    accepted = fit(cut(with_text_ids(docs).mapInPandas(_propose_all, PROPOSED), "spans"))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([masked(t, accepted) if t else t for t in texts], dtype=object)

    return small_batches(docs).withColumn("text", run(F.col("text").cast("string")))


def masked(text: str, accepted: list[frozenset[int]]) -> str:
    _, spans = decide([dict(zip(PARTS, s, strict=True)) for s in judged(text)], accepted)
    out, end = [], 0
    for kind, start, stop in spans:
        if start >= end:
            out += [text[end:start], f"<{KINDS[kind]}>"]
        end = max(end, stop)
    return "".join(out) + text[end:]
