"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, read by a deterministic parser:

    conversation = { "<s>" tag " " text " " end-tag "</s>" newline }
    tag = "[INST]" (user) | "[SYS]" (system) | "[OUT]" (assistant) | "[ROLE " quoted role "]"
    end-tag = tag with "/" after "["

A text is first rendered as it is. The rendered conversation is parsed again; a turn that does not
come back as it was is escaped more strongly and the conversation rendered anew, until all turns are
identical. Strength 1 puts ESC before each control string and doubles ESC; strength 2 puts ESC before
every character that could begin one.

Turns are ordered by turn, then role and text; null texts and roles are empty ones. Rows that repeat
are turns each. A row without a conv_id is a conversation of one turn without an id. A conversation is
one record of the result, so its turns have to fit a task together, as in any reader of the result. An
empty table gives an empty result. Other columns are not read. The loss mask of a conversation is the list of spans of its formatted text that
hold assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The tags of the known roles, the control strings, the escape character.
TAGS = {"user": "INST", "system": "SYS", "assistant": "OUT"}
CONTROL = re.compile(r"<s>|</s>|\[/?(?:INST|SYS|OUT|ROLE)\b")
ESC = "␛"
OPENING = re.compile(r"<s>\[(?:(INST|SYS|OUT)|ROLE ([^\]]*))\] ")
ROLES = {v: k for k, v in TAGS.items()}


class Malformed(ValueError):
    """The text is not in the grammar."""


def escape(text: str, strength: int) -> str:
    if strength == 0:
        return text
    if strength == 1:
        return CONTROL.sub(lambda m: ESC + m[0], text.replace(ESC, ESC + ESC))
    return re.sub(f"[{ESC}<\\[]", lambda m: ESC + m[0], text)


def unescape(text: str) -> str:
    return re.sub(f"{ESC}(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], strengths: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and begin and end of each turn's text in it."""
    parts, spans, at = [], [], 0
    for (role, text), strength in zip(turns, strengths, strict=True):
        name = TAGS.get(role) or "ROLE " + quote(role, safe="")
        body = escape(text, strength)
        head, tail = f"<s>[{name}] ", f" [/{name}]</s>\n"
        parts += [head, body, tail]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn; begin and end of the text as it is written."""
    out, at = [], 0
    while at < len(formatted):
        head = OPENING.match(formatted, at)
        if not head:
            raise Malformed(f"no turn begins at {at}")
        name = head[1] or "ROLE " + head[2]
        begin = i = head.end()
        while True:
            stop = re.compile(f"{ESC}|{CONTROL.pattern}").search(formatted, i)
            if not stop:
                raise Malformed(f"the turn at {at} does not end")
            if stop[0] != ESC:
                break
            i = stop.end() + 1  # what follows ESC is text
        tail = f" [/{name}]</s>\n"
        end = stop.start() - 1
        if end < begin or not formatted.startswith(tail, end):
            raise Malformed(f"a control string inside the turn at {at}")
        out.append((ROLES.get(head[1]) if head[1] else unquote(head[2]), unescape(formatted[begin:end]), begin, end))
        at = end + len(tail)
    return out


def round_trip(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and text spans of turns that the parser gives back unchanged."""
    strengths = [0] * len(turns)
    while True:
        formatted, spans = render(turns, strengths)
        if _reads_back(formatted, turns):
            return formatted, spans
        weak = [i for i, t in enumerate(turns) if strengths[i] < 2 and not _reads_back(render([t], [strengths[i]])[0], [t])]
        for i in weak or range(len(turns)):
            strengths[i] = min(2, strengths[i] + 1)


def _reads_back(formatted: str, turns: list[tuple[str, str]]) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse(formatted)] == turns
    except Malformed:
        return False


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) for rows (conv_id, turn, role, text)."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    conv_id = F.col("conv_id").cast("long")
    alone = F.when(conv_id.isNull(), F.monotonically_increasing_id())
    turns = small_batches(rows).select(conv_id.alias("conv_id"), alone.alias("alone"), "turn", "role", "text").groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    @F.pandas_udf("formatted string, loss_spans array<array<long>>")
    def run(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for r, t in zip(roles, texts, strict=True):
            formatted, spans = round_trip(list(zip(r, t, strict=True)))
            out.append((formatted, [list(s) for s, role in zip(spans, r, strict=True) if role == "assistant"]))
        return pd.DataFrame(out, columns=["formatted", "loss_spans"])

    return turns.select("conv_id", run("roles", "texts").alias("out")).select("conv_id", "out.*")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations and their loss masks gets back, as digests."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def run(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        out = []
        for text, mask in zip(texts, masks, strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in mask)
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _, _ in turns)), len(loss), sha(loss), len(text)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", run("formatted", "loss_spans").alias("out")).select("conv_id", "out.*")
